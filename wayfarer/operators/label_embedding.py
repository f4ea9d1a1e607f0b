"""Label vectors learnt from the company that labels keep.

Labels that stand within ``window`` places of each other in a journey are neighbours.
Their positive pointwise mutual information, max(0, ln(n(a, b) n / (n(a) n(b)))), is a
sparse table (label, neighbour, value); its first axes (``vectors``) give every label a
short vector, and labels that are used alike lie together though they may never meet.
A journey's vector is the mean of its labels' unit vectors.

Counting is one explode of at most 2 ``window`` rows a label and combinable sums; no
table is wider than the vectors.

Null labels are no neighbours and keep no place; a journey without a label that has
neighbours gets the zero vector; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators import vectors
from wayfarer.session import materialize


def neighbour_information(df: DataFrame, seq_col: str = "activity_list", window: int = 2) -> DataFrame:
    """(label, neighbour, w): positive pointwise mutual information of neighbouring labels."""
    if window < 1:
        raise ValueError("the window must be at least 1")
    s = F.filter(seq_col, lambda x: x.isNotNull())
    # Both directions: a pair i < j counts for a and for b.
    pairs = F.flatten(F.transform(F.col("s"), lambda x, i: F.transform(
        F.slice("s", i + 2, F.least(F.lit(window), F.greatest(F.size("s") - i - 1, F.lit(0)))),
        lambda y: F.struct(x.alias("a"), y.alias("b")))))
    met = df.select(s.alias("s")).select(F.explode(pairs).alias("p")).filter("p.a <> p.b")
    once = met.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    counts = materialize(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy(
        "a", "b").agg(F.sum("n").alias("n")), "neighbours")
    own = counts.groupBy("a").agg(F.sum("n").alias("na"))
    total = counts.agg(F.sum("n")).head()[0] or 0
    information = F.log(F.col("n") * F.lit(float(total)) / (F.col("na") * F.col("nb")))
    return counts.join(own, "a").join(own.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b").select(
        F.col("a").alias("label"), F.col("b").alias("neighbour"), information.alias("w")).filter("w > 0")


def label_vectors(df: DataFrame, k: int = 5, seq_col: str = "activity_list", window: int = 2) -> DataFrame:
    """(label, v): unit vectors of at most ``k`` entries of the labels that have neighbours."""
    info = materialize(neighbour_information(df, seq_col, window), "information")
    labels = materialize(info.select("label").distinct(), "labels")
    weights = info.select(F.col("label").alias("id"), F.col("neighbour").alias("label"), "w")
    placed = vectors.fit_axes(labels, weights, k).project(labels, weights, "label", "v")
    v = vectors.as_array("v")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
    return materialize(placed.select("label", F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(
        v).alias("v")), "label-vectors")


def embed_journeys(df: DataFrame, labels: DataFrame, id_col: str = "user_id", seq_col: str = "activity_list",
                   out_col: str = "pca") -> DataFrame:
    """``df`` (one row an id) with the mean of its labels' vectors."""
    width = labels.select(F.max(F.size("v"))).head()[0] or 1
    held = df.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(seq_col)).alias("label")).join(labels, "label")
    mean = held.groupBy("_id").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(width)]).alias("_v"))
    zero = F.array(*[F.lit(0.0)] * width)
    return df.join(mean, F.col(id_col) == F.col("_id"), "left").withColumn(
        out_col, array_to_vector(F.coalesce("_v", zero))).drop("_id", "_v")
