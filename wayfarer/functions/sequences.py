"""Array column functions over journeys / patterns (higher-order built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_in_order(seq, pattern) -> Column:
    """True when ``pattern`` occurs in ``seq`` in order, gaps allowed.

    A greedy scan: the accumulator is the number of pattern items matched so
    far; an empty pattern is always contained.
    """
    s, p = _col(seq), _col(pattern)
    matched = F.aggregate(
        s, F.lit(0),
        lambda i, x: F.when((i < F.size(p)) & x.eqNullSafe(F.get(p, i)), i + 1)
        .otherwise(i))
    return matched == F.size(p)


def common_prefix_length(s1, s2) -> Column:
    """Index of the first unequal position (0-based), or the shorter length."""
    a, b = _col(s1), _col(s2)
    n = F.least(F.size(a), F.size(b))
    eq = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y))
    first_false = F.array_position(eq, False)
    return F.when(first_false == 0, n).otherwise(first_false - 1).cast("int")


def divergence_score_from(d, n1, n2) -> Column:
    """Divergence score from the prefix length ``d`` and the two lengths.

    match = d / min(n1, n2); tail = (n1 - d + n2 - d) / (n1 + n2 - d);
    score = match^2 / (tail + 1).  NULL when a side is empty.
    """
    d, n1, n2 = _col(d).cast("double"), _col(n1).cast("double"), _col(n2).cast("double")
    shorter = F.least(n1, n2)
    match = F.try_divide(d, shorter)              # NULL for an empty side
    tail = F.try_divide(n1 - d + (n2 - d), n1 + n2 - d)
    return (match * match) / (tail + F.lit(1.0))


def divergence_score(s1, s2) -> Column:
    return divergence_score_from(common_prefix_length(s1, s2), F.size(_col(s1)),
                                 F.size(_col(s2)))


def one_item_deletions(seq) -> Column:
    """Array of every copy of ``seq`` with exactly one item removed."""
    s = _col(seq)
    return F.transform(
        F.sequence(F.lit(1), F.size(s)),
        lambda k: F.concat(F.slice(s, 1, k - 1),
                           F.slice(s, k + 1, F.greatest(F.size(s) - k, F.lit(0)))))


def prefixes(seq) -> Column:
    """Array of structs (d, prefix) for d = 0 .. size-1 (proper prefixes)."""
    s = _col(seq)
    return F.transform(
        F.sequence(F.lit(0), F.size(s) - 1),
        lambda d: F.struct(d.alias("d"), F.slice(s, 1, d).alias("prefix"),
                           F.get(s, d).alias("next")))
