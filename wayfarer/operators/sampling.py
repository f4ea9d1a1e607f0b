"""Class balancing: all converters plus as many non-converters, chosen by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.quantiles import values_at_ranks


def hash_key(id_col: str, seed: int) -> F.Column:
    """A 60-bit key from ``md5(id:seed)``: same value in any SQL engine with md5."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def balance_classes(journeys: DataFrame, seed: int = 42, id_col: str = "user_id",
                    label_col: str = "converted") -> DataFrame:
    """Converters, then exactly that many non-converters in hash order.

    The pick is "the n smallest hashes": the n-th smallest is found as an exact
    order statistic (no single-task top-n of n rows), then a filter keeps the
    rows under it; rows sharing that exact hash are ordered by id.
    """
    conv = journeys.filter(F.col(label_col) == 1)
    non = journeys.filter(F.col(label_col) == 0).withColumn(
        "_h", hash_key(id_col, seed))
    n = conv.count()
    if n == 0:
        return conv
    cut = values_at_ranks(non, "_h", [n - 1])
    if not cut:  # fewer non-converters than converters: take them all
        return conv.unionByName(non.drop("_h"))
    t = cut[n - 1]
    under = non.filter(F.col("_h") < F.lit(t))
    need = n - under.count()
    tied = non.filter(F.col("_h") == F.lit(t)).orderBy(id_col).limit(need)
    return conv.unionByName(under.unionByName(tied).drop("_h"))
