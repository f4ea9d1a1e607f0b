"""Events to journeys: the whole cleaning and aggregation chain."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from functools import cached_property

from pyspark.sql import DataFrame

from wayfarer.operators import attribution, clean, journeys, users
from wayfarer.storage import Scratch

DEFAULT_REMOVAL_PHRASES = ("job", "career", "careers", "apply")


@dataclass(frozen=True)
class JourneyParams:
    goal_event: str
    conversion_page_path: tuple[str, ...]
    brand: tuple[str, ...]
    removal_phrases: tuple[str, ...] = DEFAULT_REMOVAL_PHRASES
    page_repr: str = "page_location"
    strategy: str = "first"
    order_by: str = "name"
    bucket_seconds: int = 3600
    write_clean: bool = True


def _as_tuple(x: Iterable[str], what: str) -> tuple[str, ...]:
    if isinstance(x, str):
        raise TypeError(f"{what} must be a list, not a str")
    return tuple(x)


class JourneyStages:
    """Every intermediate of the chain; each is built when first asked for.

    With ``write_clean`` the cleaned events, and the labelled ones, are stored
    once when something first reads them, since several stages do; ``close``
    drops those tables.  Without it all stages are plain lazy plans, which is
    what a single reader wants.
    """

    def __init__(self, flat: DataFrame, params: JourneyParams):
        self.flat, self.params = flat, params
        self.scratch = Scratch(flat.sparkSession)

    def close(self) -> None:
        self.scratch.close()

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch(df, name) if self.params.write_clean else df

    @cached_property
    def clean(self) -> DataFrame:
        p = self.params
        return self._kept(clean.clean_events(self.flat, p.goal_event, p.brand, p.bucket_seconds), "clean-events")

    @cached_property
    def counts(self) -> DataFrame:
        return users.user_counts(self.clean)

    @cached_property
    def converters(self) -> DataFrame:
        return users.converters(self.clean, self.params.goal_event)

    @cached_property
    def multi(self) -> DataFrame:
        return users.multi_page_events(self.clean, self.counts)

    @cached_property
    def kept(self) -> DataFrame:
        return users.remove_users(self.multi, self.params.removal_phrases)

    @cached_property
    def truncated(self) -> DataFrame:
        """The fused per-user form of band, removal and cut (``multi`` and ``kept`` step by step)."""
        return users.journey_events(self.clean, self.params.removal_phrases, self.params.conversion_page_path)

    @cached_property
    def labelled(self) -> DataFrame:
        return self._kept(journeys.label_events(self.truncated, self.params.page_repr), "journey-events")

    @cached_property
    def mix_long(self) -> DataFrame:
        return attribution.medium_mix_long(self.clean, self.params.strategy, self.params.order_by)

    @cached_property
    def journeys(self) -> DataFrame:
        return journeys.aggregate_journeys(self.labelled)


def journey_stages(flat: DataFrame, params: JourneyParams) -> JourneyStages:
    """The stages of the chain from flat clickstream rows; nothing runs here."""
    return JourneyStages(flat, params)


def build_journeys(flat: DataFrame, goal_event: str, conversion_page_path: Iterable[str],
                   brand: Iterable[str],
                   removal_phrases: Iterable[str] = DEFAULT_REMOVAL_PHRASES,
                   page_repr: str = "page_location", strategy: str = "first",
                   order_by: str = "name", with_mix: bool = True, write_clean: bool = True,
                   mediums: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Return ``(events, journeys)``, both flagged with ``converted``.

    ``events`` are the labelled rows of band users before their first
    conversion page; ``journeys`` hold one row per user with the ordered
    activity list and, when ``with_mix``, one attribution column per medium
    (users without a session start get NULLs there).  ``mediums`` names those
    columns; without it they are looked up.  ``write_clean=False`` stores
    nothing on the way.
    """
    params = JourneyParams(goal_event, _as_tuple(conversion_page_path, "conversion_page_path"),
                           _as_tuple(brand, "brand"),
                           _as_tuple(removal_phrases, "removal_phrases"),
                           page_repr, strategy, order_by, write_clean=write_clean)
    st = journey_stages(flat, params)
    out = st.journeys
    if with_mix:
        wide = attribution.medium_mix_wide(st.mix_long, mediums)
        out = out.join(wide, "user_id", "left")
    events = journeys.flag_converted(st.labelled, st.converters)
    return events, journeys.flag_converted(out, st.converters)
