"""Frequent closed sequential patterns and their support in other journeys.

Mining uses Spark's distributed ``PrefixSpan`` (projected databases on the
executors).  Closure is an equi anti join: a pattern is not closed exactly when
some frequent pattern one item longer has the same support, i.e. when the
pattern appears among the one-item deletions of equal-support patterns.
"""

from __future__ import annotations

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.sequences import contains_in_order, one_item_deletions
from wayfarer.functions.text import join_path
from wayfarer.operators import trie
from wayfarer.session import materialize

PATTERN_SCHEMA = "sequence array<string>, freq bigint"

# Spark's projected databases larger than this are split further on the
# cluster instead of being finished inside one task.
MAX_LOCAL_PROJ_DB = 8_000_000


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], PATTERN_SCHEMA)


class Miner:
    """Sequences stored once and mined at one support or several."""

    def __init__(self, df: DataFrame, seq_col: str = "activity_list", local_db_size: int = MAX_LOCAL_PROJ_DB):
        # PrefixSpan passes over its input several times: write it once.
        self.items = materialize(df.select(F.transform(seq_col, lambda x: F.array(x)).alias("_items"))
                                 .filter(F.col("_items").isNotNull()))
        stats = self.items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_items")).alias("longest")).first()
        self.n, self.longest, self.local_db_size = stats["n"], stats["longest"] or 0, local_db_size

    def mine(self, min_freq: int) -> DataFrame:
        """(sequence, freq) of all patterns in at least ``min_freq`` rows."""
        if self.n == 0 or min_freq > self.n or self.longest == 0:
            return _empty(self.items)
        # Spark takes ceil(minSupport * n) as the count; the half keeps it exact.
        support = (min_freq - 0.5) / self.n
        found = PrefixSpan(minSupport=support, maxPatternLength=self.longest, maxLocalProjDBSize=self.local_db_size,
                           sequenceCol="_items").findFrequentSequentialPatterns(self.items)
        return found.select(F.flatten("sequence").alias("sequence"), F.col("freq").cast("long"))

    def item_support(self, rank: int) -> int:
        """Rows that hold the ``rank``-th most common item, 0 with fewer items."""
        counts = self.items.select(F.explode(F.array_distinct("_items")).alias("x")).groupBy("x").count()
        top = [r["count"] for r in counts.orderBy(F.desc("count")).limit(rank).select("count").collect()]
        return top[-1] if len(top) == rank else 0


def all_frequent_sequences(df: DataFrame, seq_col: str = "activity_list",
                           min_freq: int = 3, local_db_size: int = MAX_LOCAL_PROJ_DB) -> DataFrame:
    """Every sequence contained (in order, gaps allowed) in >= min_freq rows.

    A projected database of up to ``local_db_size`` items is finished inside one
    task, which holds it in memory (about 100 bytes an item); larger ones are
    split further.  The result is the same.
    """
    if min_freq < 1:
        raise ValueError("min_freq must be >= 1")
    return Miner(df, seq_col, local_db_size).mine(min_freq)


def top_sequences(df: DataFrame, top_n: int, seq_col: str = "activity_list", min_freq: int = 3,
                  min_len: int = 3, closed: bool = True) -> DataFrame:
    """The ``top_n`` most frequent (closed) patterns of length >= min_len: sequence (text), freq, length.

    Equal frequencies go by text.  The support is lowered from that of the
    ``min_len``-th most common item until ``top_n`` patterns reach it (or it is
    ``min_freq``): all patterns of that support or more are known then, those that
    would cover them included, so the rows are those of mining everything, without the
    patterns below half the last one's frequency.
    """
    if min_freq < 1:
        raise ValueError("min_freq must be >= 1")
    miner = Miner(df, seq_col)
    at = max(min_freq, miner.item_support(max(min_len, 1)))
    while True:
        found = miner.mine(at)
        if closed:
            found = closed_only(materialize(found, "mined"))
        found = materialize(found.filter(F.size("sequence") >= min_len), "patterns")
        if at <= min_freq or found.limit(top_n).count() >= top_n:
            return with_text(found).orderBy(F.col("freq").desc(), F.col("sequence").asc()).limit(top_n)
        at = max(min_freq, at // 2)


def closed_only(patterns: DataFrame) -> DataFrame:
    """Keep patterns with no one-item-longer frequent pattern of equal support."""
    covered = (patterns.filter(F.size("sequence") >= 2)
               .select(F.explode(one_item_deletions("sequence")).alias("sequence"), "freq")
               .distinct())
    return patterns.join(covered, ["sequence", "freq"], "left_anti")


def frequent_sequences(df: DataFrame, seq_col: str = "activity_list", min_freq: int = 3,
                       min_len: int = 3, closed: bool = True) -> DataFrame:
    """Frequent (closed) patterns of length >= min_len: sequence, freq."""
    pats = all_frequent_sequences(df, seq_col, min_freq)
    if closed:
        pats = closed_only(pats)
    return pats.filter(F.size("sequence") >= min_len)


def with_text(patterns: DataFrame, col: str = "sequence") -> DataFrame:
    return patterns.select(join_path(col).alias("sequence"), F.col("freq").cast("long"),
                           F.size(col).cast("long").alias("length"))


def containment_pairs(sequences: DataFrame, patterns: DataFrame, id_col: str = "user_id",
                      seq_col: str = "activity_list", pat_col: str = "sequence",
                      pat_id: str | None = None) -> DataFrame:
    """(id, pattern key) for every sequence that contains a pattern in order (``trie``)."""
    key = pat_id or pat_col
    found = trie.matches(sequences, patterns, id_col, seq_col, key, pat_col)
    return found.select(id_col, F.explode("found").alias(key))


def sequence_support(sequences: DataFrame, patterns: DataFrame, id_col: str = "user_id",
                     seq_col: str = "activity_list") -> DataFrame:
    """Number of sequences containing each pattern in order (0 when none)."""
    pats = materialize(patterns.select("sequence").distinct())
    counts = trie.support(sequences, pats, seq_col, "sequence", "sequence")
    return (pats.join(counts, "sequence", "left")
            .select("sequence", F.coalesce("n", F.lit(0)).cast("long").alias("support")))


def count_containing(sequences: DataFrame, target: list[str],
                     seq_col: str = "activity_list") -> DataFrame:
    """How many sequences contain ``target`` in order (one row, ``count``)."""
    pat = F.array(*[F.lit(x) for x in target]).cast("array<string>")
    return sequences.agg(F.sum(contains_in_order(seq_col, pat).cast("long")).alias("count")) \
        .select(F.coalesce("count", F.lit(0)).alias("count"))
