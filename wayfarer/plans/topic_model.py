"""Topics kept as tables and given to journeys that were not there when they were fitted.

A model is a folder of parquet tables: the labels' weights and axes, the distinct
fitted vectors with their topics, keywords and topic info.  Every save makes a new
version beside the earlier ones; the table that describes it is written last, so a
version that was not written to its end is not seen.

A journey takes the topic of the fitted vector nearest to its own (of equally near ones
the smallest), found by grid cells as near pairs are when clusters are made.  A fitted
journey is nearest to itself and gets its own topic back.  Labels that the model does
not know add nothing; a journey without any known label is the vector of none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.operators import points, topics, vectors
from wayfarer.operators.points import Grid, clean_vector
from wayfarer.plans.topics import TopicResult, journey_topics
from wayfarer.session import materialize
from wayfarer.storage import Scratch, store

TABLES = ("idf", "axes", "vectors", "keywords", "info")


@dataclass
class TopicModel:
    idf: DataFrame       # label, idf
    axes: DataFrame      # label, mean, scale, v
    offset: np.ndarray   # projection of the column means
    vectors: DataFrame   # v, topic: the distinct fitted vectors
    keywords: DataFrame  # topic, keyword, weight, rank
    info: DataFrame      # topic, count, name, keywords, representative_docs

    def _reduced(self, journeys: DataFrame, id_col: str) -> DataFrame:
        weights = topics.embed_labels(journeys, id_col=id_col, idf=self.idf)
        return vectors.Axes(self.axes, self.offset).project(journeys, weights, id_col)

    def assign(self, journeys: DataFrame, id_col: str = "user_id") -> DataFrame:
        """(id, topic) of every journey (one row an id, with ``activity_list``)."""
        spark = journeys.sparkSession
        scratch = Scratch(spark)
        reduced = scratch(self._reduced(journeys.select(id_col, "activity_list"), id_col).select(
            id_col, clean_vector("pca").alias("v")), "reduced")
        asked = points.distinct_points(reduced.select("v"), scratch)
        fitted = scratch(self.vectors.select(F.monotonically_increasing_id().alias("id"), "v", "topic").withColumn(
            "weight", F.lit(1).cast("long")), "fitted")
        n = fitted.count()
        if not n:
            scratch.close()
            return journeys.select(id_col, F.lit(-1).alias("topic"))
        grid = Grid(fitted.drop("topic"), scratch)
        near = points.nearest(grid, asked.select("id", "v"), grid.starting_level(n))
        topic = near.join(fitted.select(F.col("id").alias("other"), "topic"), "other").join(
            asked.select("id", "v"), "id").select("v", "topic")
        out, _ = store(reduced.join(topic, "v", "left").select(
            id_col, F.coalesce("topic", F.lit(-1)).cast("int").alias("topic")), "assigned")
        scratch.close()
        return out

    def save(self, path: str) -> int:
        """Write a new version under ``path``; returns its number."""
        spark = self.idf.sparkSession
        version = max(versions(spark, path), default=0) + 1
        where = f"{path.rstrip('/')}/v{version:06d}"
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{where}/{name}")
        spark.createDataFrame([([float(o) for o in self.offset],)], "offset array<double>").write.mode(
            "overwrite").parquet(f"{where}/model")
        return version


def _names(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions under ``path`` that were written to their end."""
    root = path.rstrip("/")
    found = [n for n in _names(spark, root) if n.startswith("v") and n[1:].isdigit()]
    return sorted(int(n[1:]) for n in found if "_SUCCESS" in _names(spark, f"{root}/{n}/model"))


def load_model(spark: SparkSession, path: str, version: int | None = None) -> TopicModel:
    """A version of the model under ``path``, the latest if none is named."""
    there = versions(spark, path)
    if version is None and there:
        version = there[-1]
    if version not in there:
        raise ValueError(f"no topic model {'' if version is None else f'version {version} '}under {path}")
    where = f"{path.rstrip('/')}/v{version:06d}"
    tables = {name: spark.read.parquet(f"{where}/{name}") for name in TABLES}
    offset = spark.read.parquet(f"{where}/model").head()["offset"]
    return TopicModel(offset=np.array(offset, float), **tables)


def fit_topics(journeys: DataFrame, id_col: str = "user_id", k: int = 5, **settings) -> tuple[TopicModel, TopicResult]:
    """``journey_topics`` with the default embedding, and the model that assigns its topics."""
    journeys = materialize(journeys.select(id_col, "activity_list", "activity_list_text"))
    idf = materialize(topics.label_idf(journeys, id_col=id_col), "idf")
    axes = vectors.fit_axes(journeys, topics.embed_labels(journeys, id_col=id_col, idf=idf), k)
    reduced = materialize(axes.project(journeys, topics.embed_labels(journeys, id_col=id_col, idf=idf), id_col))
    result = journey_topics(journeys, id_col=id_col, reduced=reduced, **settings)
    fitted = materialize(reduced.select(id_col, clean_vector("pca").alias("v")).join(
        result.assignments, id_col).groupBy("v").agg(F.max("topic").alias("topic")))
    return TopicModel(idf, axes.table, axes.offset, fitted, materialize(result.keywords, "keywords"),
                      materialize(result.info, "info")), result
