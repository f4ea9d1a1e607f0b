"""Where non-converting patterns diverge from converting ones.

For a pair (n, c) let d be the length of their common prefix.  The pair is
kept when both tails are non-empty (d < |n| and d < |c|); its score is
``(d / min(|n|,|c|))^2 / (1 + (|n|+|c|-2d) / (|n|+|c|-d))`` and its weight
``score * freq(n)``.  The score depends only on (d, |n|, |c|), so pairs fall
into classes (n, d, |c|) whose size is a difference of prefix counts:

    #{c : prefix n[:d], length l} - #{c : prefix n[:d], next item n[d], length l}

The top-N pairs are found by ranking classes (never enumerating all pairs),
then materialising only the first partners of the few winning classes from a
per-(prefix, next item, length) top-N list of converting patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.sequences import divergence_score_from, prefixes
from wayfarer.functions.text import join_path
from wayfarer.operators.patterns import frequent_sequences
from wayfarer.session import materialize

RESULT_COLUMNS = ["conversion_seq", "non_conversion_seq", "diversion", "divergence_score",
                  "non_conv_freq", "weight"]


def split_shared(conv: DataFrame, non_conv: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(converting only, non-converting only, shared) patterns, compared as arrays."""
    conv_only = conv.join(_apart(non_conv.select("sequence")), "sequence", "left_anti")
    non_only = non_conv.join(_apart(conv.select("sequence")), "sequence", "left_anti")
    shared = conv.select("sequence").join(_apart(non_conv.select("sequence")), "sequence", "left_semi")
    return conv_only, non_only, shared


def _prefix_rows(patterns: DataFrame, extra: list[str]) -> DataFrame:
    return patterns.select(*extra, "sequence", F.size("sequence").alias("len"),
                           F.explode(prefixes("sequence")).alias("p")) \
        .select(*extra, "sequence", "len", "p.d", "p.prefix", "p.next")


def _apart(df: DataFrame) -> DataFrame:
    """Joins with ``df`` are shuffled: stored patterns take many times their files' size in memory."""
    return df.hint("merge")


def divergence_classes(non_conv: DataFrame, conv: DataFrame, first: int | None = None) -> DataFrame:
    """One row per (non-converting pattern, d, converting length) with pair count.

    Columns: sequence, freq, n_len, d, prefix, next, c_len, pairs, score, weight.
    ``first`` leaves out the classes that come after ``first`` others by weight, freq
    and text for sure: patterns of one (prefix, next, length) have the same scores, so
    those after the group's first ones by freq and text (equal ones kept).
    """
    cp = _prefix_rows(conv, []).groupBy("prefix", "next", "len").agg(
        F.count(F.lit(1)).alias("same_next"))
    ct = cp.groupBy("prefix", "len").agg(F.sum("same_next").alias("total"))
    nrows = _prefix_rows(non_conv, ["freq"])
    if first is not None:
        rank = Window.partitionBy("prefix", "next", "len").orderBy(F.col("freq").desc(), join_path("sequence").asc())
        nrows = nrows.withColumn("_r", F.rank().over(rank)).filter(F.col("_r") <= first).drop("_r")
    nrows = nrows.withColumnRenamed("len", "n_len")
    cls = (nrows.join(_apart(ct.withColumnRenamed("len", "c_len")), "prefix")
           .join(_apart(cp.withColumnRenamed("len", "c_len")), ["prefix", "next", "c_len"], "left")
           .withColumn("pairs", F.col("total") - F.coalesce("same_next", F.lit(0)))
           .filter(F.col("pairs") > 0))
    score = divergence_score_from("d", "n_len", "c_len")
    return cls.select("sequence", "freq", "n_len", "d", "prefix", "next", "c_len",
                      F.col("pairs").cast("long").alias("pairs"),
                      score.alias("score"), (score * F.col("freq")).alias("weight"))


def divergence_count(non_conv: DataFrame, conv: DataFrame) -> DataFrame:
    """Number of divergent pairs (both tails non-empty), as one row."""
    def counts(patterns: DataFrame, name: str) -> DataFrame:
        return _prefix_rows(patterns, []).groupBy("prefix", "next").agg(F.count(F.lit(1)).alias(name))

    cp = counts(conv, "same_next")
    ct = cp.groupBy("prefix").agg(F.sum("same_next").alias("total"))
    pairs = counts(non_conv, "n").join(_apart(ct), "prefix").join(_apart(cp), ["prefix", "next"], "left").select(
        (F.col("n") * (F.col("total") - F.coalesce("same_next", F.lit(0)))).alias("pairs"))
    return pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("divergent_pairs"))


def top_divergence(non_conv: DataFrame, conv: DataFrame, top_n: int = 10,
                   min_prefix: int = 0) -> DataFrame:
    """The top_n pairs by weight (ties: freq desc, then both texts ascending).

    ``min_prefix=1`` leaves out pairs that differ from the first item (their
    score is 0); by default they are kept, and fill the list when fewer
    positive pairs exist.
    """
    if top_n < 1:
        raise ValueError("top_n must be >= 1")
    cls = divergence_classes(non_conv, conv, top_n).withColumn("n_text", join_path("sequence"))
    if min_prefix > 0:
        cls = cls.filter(F.col("d") >= min_prefix)
    order = [F.col("weight").desc(), F.col("freq").desc(), F.col("n_text").asc()]
    # Each class holds >= 1 pair, so the first top_n classes suffice, plus any
    # class tying with the last one (their partners may sort earlier).
    head = cls.orderBy(*order).limit(top_n).select("weight", "freq", "n_text").collect()
    if not head:
        return _empty_result(non_conv)
    w, f, t = head[-1]["weight"], head[-1]["freq"], head[-1]["n_text"]
    # As many classes as asked for, and those of the last one's text.
    chosen = F.broadcast(materialize(cls.filter(
        (F.col("weight") > w) | ((F.col("weight") == w) & (F.col("freq") > f))
        | ((F.col("weight") == w) & (F.col("freq") == f) & (F.col("n_text") <= t))), "classes"))
    # First top_n converting patterns (by text) per (prefix, next, length) of a chosen class.
    crow = _prefix_rows(conv, []).join(chosen.select("prefix", F.col("c_len").alias("len")), ["prefix", "len"], "left_semi") \
        .withColumn("c_text", join_path("sequence"))
    rank = Window.partitionBy("prefix", "next", "len").orderBy("c_text")
    cand = (crow.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= top_n)
            .select("prefix", F.col("next").alias("c_next"), F.col("len").alias("c_len"),
                    "c_text", F.col("sequence").alias("c_seq")))
    pairs = (cand.join(chosen, ["prefix", "c_len"])
             .filter(F.col("c_next") != F.col("next")))
    out = pairs.select(
        F.col("c_text").alias("conversion_seq"),
        F.col("n_text").alias("non_conversion_seq"),
        F.col("next").alias("diversion"),
        F.col("score").alias("divergence_score"),
        F.col("freq").alias("non_conv_freq"),
        F.col("weight")).dropDuplicates()  # distinct rows (bounded candidate set)
    return out.orderBy(F.col("weight").desc(), F.col("non_conv_freq").desc(),
                       F.col("non_conversion_seq").asc(), F.col("conversion_seq").asc()) \
        .limit(top_n).select(*RESULT_COLUMNS)


def _empty_result(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(
        [], "conversion_seq string, non_conversion_seq string, diversion string, "
            "divergence_score double, non_conv_freq bigint, weight double")


def class_patterns(journeys: DataFrame, min_freq: int, min_len: int,
                   seq_col: str = "activity_list") -> tuple[DataFrame, DataFrame]:
    """Closed frequent patterns of converters and of non-converters."""
    conv = frequent_sequences(journeys.filter(F.col("converted") == 1), seq_col,
                              min_freq, min_len)
    non = frequent_sequences(journeys.filter(F.col("converted") == 0), seq_col,
                             min_freq, min_len)
    return conv, non


def analyze_divergence(journeys: DataFrame, top_n: int = 10, min_freq: int = 10,
                       min_seq_len: int = 3, min_prefix: int = 0) -> DataFrame:
    """Top pairs where a non-converting pattern leaves a converting one."""
    journeys = materialize(journeys.select("activity_list", "converted"))
    conv, non = class_patterns(journeys, min_freq, min_seq_len)
    conv_only, non_only, _ = split_shared(materialize(conv), materialize(non))
    return top_divergence(non_only, conv_only, top_n, min_prefix)
