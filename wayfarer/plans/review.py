"""Converter review: non-converters who look like converters, and the odd ones.

Journeys become binary label vectors, standardised and reduced to principal
components, and are clustered by density.  Non-converters in clusters that
hold a converter are the *similar* ones; an isolation forest refit on them
marks the *unusual* ones.  The result lists the most frequent patterns of both
groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators import density, isolation, vectors
from wayfarer.operators.patterns import top_sequences
from wayfarer.session import materialize

REVIEW_SCHEMA = "kind string, sequence string, freq bigint, length bigint"


@dataclass
class ReviewParts:
    clustered: DataFrame   # every journey with its ``cluster``
    similar: DataFrame     # non-converters in converter clusters, with ``anomaly``
    report: DataFrame      # kind, sequence, freq, length


def top_patterns(journeys: DataFrame, kind: str, top_n: int, min_freq: int,
                 min_len: int = 3) -> DataFrame:
    return top_sequences(journeys, top_n, min_freq=min_freq, min_len=min_len).select(
        F.lit(kind).alias("kind"), "sequence", "freq", "length")


def similar_non_converters(clustered: DataFrame) -> DataFrame:
    """Non-converters of the clusters that hold a converter; noise (-1) is no cluster."""
    conv_clusters = (clustered.filter((F.col("converted") == 1) & (F.col("cluster") > -1))
                     .select("cluster").distinct())
    return clustered.filter(F.col("converted") == 0).join(conv_clusters, "cluster", "left_semi")


def review_parts(journeys: DataFrame, top_n: int = 10, reducer: str = "pca",
                 id_col: str = "user_id", k: int = 5, cell_size: float | None = None,
                 min_cluster_size: int = 3, contamination: float = 0.05, seed: int = 42,
                 similar_min_freq: int = 2, unusual_min_freq: int = 3, min_len: int = 3,
                 n_trees: int = 100, sample: int = 256) -> ReviewParts:
    if reducer != "pca":
        raise ValueError("reducer must be 'pca' (UMAP is not available on Spark)")
    spark = journeys.sparkSession
    journeys = materialize(journeys.select(id_col, "activity_list", "converted"))
    reduced = vectors.reduce(journeys, k, id_col=id_col)
    clustered = materialize(density.density_cluster(reduced, cell_size=cell_size,
                                                    min_cluster_size=min_cluster_size))
    similar = similar_non_converters(clustered).drop("pca")
    empty = spark.createDataFrame([], REVIEW_SCHEMA)
    if similar.isEmpty():
        return ReviewParts(clustered, similar.withColumn("anomaly", F.lit(1)), empty)
    # Refit scaling and components on the similar non-converters only; labels
    # that none of them has are constant and add nothing.
    sim_red = vectors.reduce(materialize(similar), k, id_col=id_col)
    scored = materialize(isolation.isolation_scores(sim_red, id_col, "pca", n_trees=n_trees,
                                                    sample=sample, seed=seed))
    flagged = isolation.flag_anomalies(scored, contamination)
    report = top_patterns(flagged, "similar", top_n, similar_min_freq, min_len)
    unusual = flagged.filter(F.col("anomaly") == -1)
    report = report.unionByName(top_patterns(unusual, "unusual", top_n, unusual_min_freq,
                                             min_len))
    return ReviewParts(clustered, flagged, report)


def converter_review(journeys: DataFrame, top_n: int = 10, reducer: str = "pca",
                     **kwargs) -> DataFrame:
    """kind ('similar' | 'unusual'), sequence, freq, length: top_n of each kind."""
    return review_parts(journeys, top_n, reducer, **kwargs).report
