"""Entry points under the names and signatures users of the original know.

Each takes and returns Spark DataFrames (or Column expressions) and delegates
to the operators.  Event and journey functions are lazy, but for the names of the
wide medium columns where none are given; mining, fits, clustering and topics run
jobs when called.  Differences: ``get_data`` reads
any flat clickstream DataFrame (or a shard root through ``load_export``)
instead of a hosted warehouse, the importance "plot" returns its ranked table,
``converter_review`` returns the review table, and ``analyze_clusters``
returns the topic tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import sequences as S
from wayfarer.operators import attribution, clean, journeys, users
from wayfarer.operators import divergence as D
from wayfarer.operators import importance as IM
from wayfarer.operators import patterns as P
from wayfarer.plans import journey_plan, review
from wayfarer.plans import topics as T
from wayfarer.sources import ga_export

DEFAULT_REMOVAL_PHRASES = journey_plan.DEFAULT_REMOVAL_PHRASES


def query_events(spark, base: str, historical_days: int, as_of_date: dt.date | None = None,
                 include_intraday: bool = False, event_names: list[str] | None = None,
                 snapshot_root: str | None = None) -> DataFrame:
    """Flat events of the shards in the window (``as_of_date`` defaults to today).

    ``event_names`` (session_start, page_view and the goal) is pushed to the
    scan; with ``snapshot_root`` the rows are kept there by shard, and only new or
    changed shards are read from the export.
    """
    day = as_of_date or dt.date.today()
    return ga_export.query_export(spark, base, day, historical_days, include_intraday, event_names,
                                  snapshot_root)


def load_and_clean(flat: DataFrame, goal_event: str, brand: Iterable[str]) -> DataFrame:
    return clean.clean_events(flat, goal_event, brand)


def process_counts(df: DataFrame) -> DataFrame:
    return users.user_counts(df)


def process_converters(df: DataFrame, goal_event: str) -> DataFrame:
    return users.converters(df, goal_event)


def process_multi(df: DataFrame, df_counts: DataFrame) -> DataFrame:
    return users.multi_page_events(df, df_counts)


def process_removals(df: DataFrame, removal_phrases: Iterable[str]) -> DataFrame:
    return users.remove_users(df, removal_phrases)


def process_medium_mix(df: DataFrame, strategy: str = "first",
                       mediums: list[str] | None = None) -> DataFrame:
    return attribution.medium_mix_wide(attribution.medium_mix_long(df, strategy), mediums)


def process_conversion_path(df: DataFrame, conversion_page_path: Iterable[str]) -> DataFrame:
    return users.cut_at_conversion(df, conversion_page_path)


def process_labels(df: DataFrame, page_repr: str = "page_location") -> DataFrame:
    return journeys.label_events(df, page_repr)


def process_aggregation(df: DataFrame, df_attr: DataFrame) -> DataFrame:
    return journeys.aggregate_journeys(df).join(df_attr, "user_id", "left")


def get_data(flat: DataFrame, goal_event: str, conversion_page_path: Iterable[str],
             brand: Iterable[str], removal_phrases: Iterable[str] = DEFAULT_REMOVAL_PHRASES,
             page_repr: str = "page_location", strategy: str = "first"
             ) -> tuple[DataFrame, DataFrame]:
    """``(events, journeys)`` from flat clickstream rows."""
    return journey_plan.build_journeys(flat, goal_event, conversion_page_path, brand,
                                       removal_phrases, page_repr, strategy)


def check_sequence(sequence: Column | str, sub_sequence: Column | str) -> Column:
    return S.contains_in_order(sequence, sub_sequence)


def find_frequent_sequences(sequences: DataFrame, min_freq: int = 3, min_len: int = 3,
                            seq_col: str = "activity_list") -> DataFrame:
    """Closed frequent sequences: ``sequence``, ``freq``."""
    return P.frequent_sequences(sequences, seq_col, min_freq, min_len)


def count_ordered_subset_sequences(target_seq: list[str], all_sequences: DataFrame,
                                   seq_col: str = "activity_list") -> DataFrame:
    return P.count_containing(all_sequences, target_seq, seq_col)


def find_divergence_point(seq1: Column | str, seq2: Column | str) -> dict[str, Column]:
    """Columns ``d`` (divergence index), tails and ``score`` for two array columns."""
    a = F.col(seq1) if isinstance(seq1, str) else seq1
    b = F.col(seq2) if isinstance(seq2, str) else seq2
    d = S.common_prefix_length(a, b)
    return {"d": d, "tail1": F.slice(a, d + 1, F.size(a)), "tail2": F.slice(b, d + 1, F.size(b)),
            "score": S.divergence_score(a, b)}


def plot_important_features_prefixspan(df: DataFrame, top_n: int = 10, min_freq: int = 10,
                                       min_seq_len: int = 3) -> DataFrame:
    """The ranked importance table (the chart itself is not drawn)."""
    return IM.sequence_importance(df, top_n, min_freq, min_seq_len)


def analyze_divergence(df: DataFrame, top_n: int = 10, min_freq: int = 10,
                       min_seq_len: int = 3) -> DataFrame:
    return D.analyze_divergence(df, top_n, min_freq, min_seq_len)


def converter_review(df: DataFrame, top_n: int = 10, reducer: str = "pca") -> DataFrame:
    return review.converter_review(df, top_n, reducer)


def analyze_clusters(df: DataFrame, min_topic_size: int = 100, embedder=None,
                     labeler=None) -> T.TopicResult:
    return T.journey_topics(df, min_topic_size, embedder=embedder, labeler=labeler)
