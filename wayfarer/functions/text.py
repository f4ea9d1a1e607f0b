"""String column functions (all JVM built-ins, no Python UDFs).

Python's ``str.strip``/``\\s``/``\\b`` are Unicode-aware; Java regexes are not
unless ``(?U)`` is given, so every pattern here carries that flag.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: removes all leading/trailing whitespace, tabs too.

    Spark's ``trim`` removes only spaces.
    """
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def strip_lower(c) -> Column:
    return F.lower(strip(c))


def url_path(c) -> Column:
    """Normalise a page URL to a lower-case path with exactly one trailing ``/``.

    Drops the query string / fragment, then a lower-case ``http(s)://host``
    prefix, strips, lower-cases and strips trailing slashes before adding one.
    A host-only URL becomes ``/``.
    """
    x = F.regexp_replace(_col(c), r"[?#].*$", "")
    x = F.regexp_replace(x, r"^https?://[^/]+", "")
    x = strip_lower(x)
    x = F.regexp_replace(x, r"/+$", "")
    return F.concat(x, F.lit("/"))


def title_prefix(c) -> Column:
    """Text before the first `` - `` or `` | `` (whole title when neither)."""
    return F.regexp_extract(F.coalesce(_col(c), F.lit("")),
                            r"(?U)(.*?)(?:\s[-|]\s|$)", 1)


def brand_pattern(brand: Iterable[str]) -> str | None:
    """Alternation of the brand names (kept as regexes, as given)."""
    if isinstance(brand, str):
        raise TypeError("brand must be a list of names, not a str")
    parts = [b.strip().lower() for b in brand]
    parts = [p for p in parts if p]
    return "|".join(parts) if parts else None


def remove_brand(c, brand: Iterable[str]) -> Column:
    """Remove every case-insensitive brand match, then strip."""
    pattern = brand_pattern(brand)
    x = _col(c)
    if pattern is not None:
        x = F.regexp_replace(x, "(?iu)" + pattern, "")
    return strip(x)


def medium_slug(c) -> Column:
    """``medium_`` + non-alphanumeric runs to ``_``, trimmed of spaces/underscores."""
    x = F.regexp_replace(_col(c), r"[^a-zA-Z0-9]+", "_")
    x = F.regexp_replace(x, r"^[ _]+|[ _]+$", "")
    return F.concat(F.lit("medium_"), x)


def join_path(c, sep: str = " -> ") -> Column:
    """Journey / pattern text form: labels joined by `` -> ``."""
    return F.array_join(_col(c), sep)


def phrase_regex(phrases: Iterable[str]) -> str | None:
    """Whole-word, case-insensitive alternation of removal phrases.

    Phrases stay regexes, as in the original; an empty list gives ``None``
    (no-op) instead of a pattern that matches every word.
    """
    if isinstance(phrases, str):
        raise TypeError("removal_phrases must be a list, not a str")
    uniq = list(dict.fromkeys(p for p in phrases if p))
    if not uniq:
        return None
    return r"(?iU)\b(?:" + "|".join(uniq) + r")\b"
