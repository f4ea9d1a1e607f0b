"""Journey vectors over all labels: weights in long form, and their principal components.

A matrix with one column a label is kept as rows (id, label, w), so no label is
left out however many there are.  Components come from a block Krylov basis: with
a block as a table (label, values), one product with the covariance is two grouped
sums over the long rows.  The driver sees only matrices of the basis' width.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.storage import Scratch, store

#: Vectors of a Krylov block; with fewer labels the axes are found at once.
BLOCK = 48
#: Residual of an axis under the covariance, relative to the largest variance.
TOLERANCE = 1e-5


def label_weights(df: DataFrame, id_col: str = "user_id", seq_col: str = "activity_list") -> DataFrame:
    """(id, label, w): 1 for every label that a row's list holds."""
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(seq_col)).alias("label")) \
        .filter(F.col("label").isNotNull()).withColumn("w", F.lit(1.0))


def label_statistics(weights: DataFrame, n: int) -> DataFrame:
    """(label, mean, scale) over ``n`` rows; scale is 1 / sample deviation.

    Constant columns are left out: they become 0 when standardised.
    """
    sums = weights.groupBy("label").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    mean = F.col("s") / n
    variance = (F.col("q") - F.col("s") * mean) / max(n - 1, 1)
    return sums.select("label", mean.alias("mean"), variance.alias("variance")).filter(
        F.col("variance") > 1e-12).select("label", "mean", (1 / F.sqrt("variance")).alias("scale"))


def _sum_arrays(col: str, width: int):
    return F.array(*[F.sum(F.col(col)[i]) for i in range(width)])


def ordered_sum(terms: str, field: str):
    """Sum of a field of the structs of an array, in the array's order: no rounding by how rows are dealt out."""
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t[field])


def _project(weights: DataFrame, axes: DataFrame, offset: np.ndarray, ordered: bool = False) -> DataFrame:
    """(id, y): standardised rows that hold a label, times the axes (label, mean, scale, v).

    ``ordered`` adds up a row's labels in their order, so rows of equal labels and
    weights get equal vectors to the last bit.
    """
    terms = weights.join(axes, "label").withColumn("c", F.transform("v", lambda x: x * F.col("w") * F.col("scale")))
    if ordered:
        listed = terms.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("t"))
        zero = F.array(*[F.lit(0.0)] * len(offset))
        sums = listed.select("id", F.aggregate("t", zero, lambda s, t: F.zip_with(s, t["c"], lambda a, b: a + b)).alias("s"))
    else:
        sums = terms.groupBy("id").agg(_sum_arrays("c", len(offset)).alias("s"))
    return sums.select("id", F.array(*[F.col("s")[i] - float(o) for i, o in enumerate(offset)]).alias("y"))


def _block_sums(df: DataFrame, width: int) -> tuple[np.ndarray, ...]:
    """For the basis v and the block z (``width`` values): v z', z z' and sum of mean * scale * z."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                c = batch.column("mean").to_numpy() * batch.column("scale").to_numpy()
                v, z = (np.array(batch.column(x).to_pylist(), float) for x in ("v", "z"))
                found = np.concatenate([(v.T @ z).ravel(), (z.T @ z).ravel(), c @ z])
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["p"])

    rows = df.select("mean", "scale", "v", "z").mapInArrow(run, "p binary").collect()  # one row a partition
    flat = sum(np.frombuffer(bytes(r[0]), float) for r in rows)
    square = width * width
    cross = flat[:-square - width].reshape(-1, width)
    return cross, flat[-square - width:-width].reshape(width, width), flat[-width:]


def _changed(df: DataFrame, change) -> DataFrame:
    """(label, mean, scale, v, z) with ``change(v, z)``, two matrices of a batch, in their place."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v, z = change(*(np.array(batch.column(x).to_pylist(), float) for x in ("v", "z")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), batch.column("mean"), batch.column("scale"),
                     *(pa.array(list(x), pa.list_(pa.float64())) for x in (v, z))], ["label", "mean", "scale", "v", "z"])

    df = df.select("label", "mean", "scale", "v", "z")
    return df.mapInArrow(run, df.schema)


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """Matrix that turns columns with this Gram matrix into orthonormal ones; fewer if they depend on each other."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    usable = values > max(values.max(), 1e-300) * 1e-13
    return vectors[:, usable] / np.sqrt(values[usable])


def _raised(weights: DataFrame, axes: DataFrame, offset: np.ndarray, n: int) -> DataFrame:
    """``axes`` (label, mean, scale, v, ...) with z: the covariance times the block v.

    ``offset`` is the projection of the column means.  Their share in the second
    product drops out: the projections sum to zero over all rows, those without a
    label included.
    """
    width = len(offset)
    rows = _project(weights, axes, offset)
    raised = weights.join(rows, "id").withColumn(
        "c", F.transform("y", lambda x: x * F.col("w"))).groupBy("label").agg(_sum_arrays("c", width).alias("r"))
    share = F.col("scale") / max(n - 1, 1)
    return axes.join(raised, "label", "left").withColumn(
        "z", F.transform(F.coalesce("r", F.array(*[F.lit(0.0)] * width)), lambda x: x * share)).drop("r")


def principal_axes(weights: DataFrame, n: int, k: int, scratch: Scratch,
                   block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """((label, mean, scale, v), offset): the first ``k`` axes of the standardised columns.

    ``offset`` is the projection of the column means.  A block Krylov basis: every
    round multiplies the newest block by the covariance and adds what is new of it, so
    the best axes within all blocks together settle in few rounds; they are done when
    none is off the covariance's own by ``TOLERANCE``.  Where the blocks come to span
    all labels the axes are exact.
    """
    stats = scratch(label_statistics(weights, n), "label-statistics")
    labels = stats.count()
    k = min(k, labels)
    if k == 0:
        return stats.withColumn("v", F.array().cast("array<double>")), np.zeros(0)
    if labels <= block:  # the labels themselves span everything: one product is enough
        unit = stats.orderBy("label").collect()
        basis = stats.withColumn("v", F.array(*[(F.col("label") == r["label"]).cast("double") for r in unit]))
        offset = np.array([r["mean"] * r["scale"] for r in unit])
        raised = scratch(_raised(weights, basis, offset, n), "axes")
        inside, _, _ = _block_sums(raised, labels)
        _, vectors = np.linalg.eigh((inside + inside.T) / 2)
        vectors = vectors[:, ::-1][:, :k]
        return _signed(_changed(raised, lambda v, z: (v @ vectors, z[:, :0])), offset @ vectors, scratch)
    start = F.array(*[F.xxhash64("label", F.lit(i)) / float(1 << 63) for i in range(block)])
    none = F.array().cast("array<double>")
    held = stats.withColumn("v", none).withColumn("z", start)
    offsets, inner = np.zeros(0), np.zeros((0, 0))  # projections of the means on the basis, basis' covariance basis
    width = block
    while True:
        # What the block adds to the basis: its part inside taken out twice, the rest made orthonormal.
        link = None
        for _ in range(2):
            held = scratch(held, "basis")
            cross, gram, _ = _block_sums(held, width)
            turn = _orthonormal(gram - cross.T @ cross)
            width = turn.shape[1]
            held = _changed(held, lambda v, z, c=cross, t=turn: (v, (z - v @ c) @ t))
            kept = np.linalg.pinv(turn)
            link = kept if link is None else kept @ link
        held = scratch(held, "basis")
        _, _, means = _block_sums(held, width)
        if inner.size:
            values, vectors = np.linalg.eigh((inner + inner.T) / 2)
            values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
            off = np.linalg.norm(link @ vectors[-last:], axis=0).max()
            if off <= TOLERANCE * max(values.max(), 1e-300) or len(inner) + width > labels:
                return _signed(_changed(held, lambda v, z: (v @ vectors, z[:, :0])), offsets @ vectors, scratch)
        new = held.select("label", "mean", "scale", F.col("z").alias("v"), F.col("v").alias("old"))
        raised = _raised(weights, new, means, n)
        held = scratch(raised.select("label", "mean", "scale", F.concat("old", "v").alias("v"), "z"), "basis")
        cross, _, _ = _block_sums(held, width)
        grown = np.zeros((len(cross), len(cross)))
        grown[:len(inner), :len(inner)] = inner
        grown[:, -width:], grown[-width:, :] = cross, cross.T
        inner, offsets, last = grown, np.concatenate([offsets, means]), width


def _signed(axes: DataFrame, offset: np.ndarray, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """Axes turned so that the cubes of each one's entries sum to no less than zero."""
    axes = scratch(axes.select("label", "mean", "scale", "v"), "axes")
    cubes = axes.agg(*[F.sum(F.pow(F.col("v")[i], 3)) for i in range(len(offset))]).head()
    sign = [1.0 if c >= 0 else -1.0 for c in cubes]
    return (axes.withColumn("v", F.array(*[F.col("v")[i] * x for i, x in enumerate(sign)])),
            offset * np.array(sign))


@dataclass
class Axes:
    """Fitted components: ``table`` (label, mean, scale, v), and the column means' projection."""
    table: DataFrame
    offset: np.ndarray

    def project(self, df: DataFrame, weights: DataFrame, id_col: str, out_col: str = "pca") -> DataFrame:
        """``df`` (one row an id) and the components of its weights (id, label, w); other labels add nothing."""
        if not len(self.offset):
            return df.withColumn(out_col, array_to_vector(F.array(F.lit(0.0))))
        rows = _project(weights, self.table, self.offset, True).withColumnRenamed("id", "_id").withColumnRenamed("y", "_y")
        nothing = F.array(*[F.lit(-float(o)) for o in self.offset])
        return df.join(rows, F.col(id_col) == F.col("_id"), "left").withColumn(
            out_col, array_to_vector(F.coalesce("_y", nothing))).drop("_id", "_y")


def fit_axes(df: DataFrame, weights: DataFrame, k: int = 5) -> Axes:
    """The first ``k`` components of the standardised weights over the rows of ``df``, stored."""
    scratch = Scratch(df.sparkSession)
    axes, offset = principal_axes(scratch(weights, "label-weights"), df.count(), k, scratch)
    table, _ = store(axes, "axes")
    scratch.close()
    return Axes(table, offset)


def components(df: DataFrame, weights: DataFrame, k: int = 5, id_col: str = "user_id",
               out_col: str = "pca") -> DataFrame:
    """``df`` (one row an id) and its first ``k`` components of the standardised weights, as a vector.

    With fewer labels than ``k`` the vectors are that much shorter.
    """
    scratch = Scratch(df.sparkSession)
    weights = scratch(weights, "label-weights")
    axes, offset = principal_axes(weights, df.count(), k, scratch)
    got, _ = store(Axes(axes, offset).project(df, weights, id_col, out_col), "components")
    scratch.close()
    return got


def reduce(df: DataFrame, k: int = 5, seq_col: str = "activity_list", reducer: str = "pca",
           id_col: str = "user_id") -> DataFrame:
    """Binary label columns -> standardised -> ``k`` components in column ``pca``.

    All labels of ``df`` take part (one that no row holds is constant and adds 0).
    """
    if reducer != "pca":
        raise ValueError("reducer must be 'pca' (UMAP is not available on Spark)")
    return components(df, label_weights(df, id_col, seq_col), k, id_col)


def standardize(df: DataFrame, in_col: str, out_col: str = "scaled") -> DataFrame:
    """Mean 0 and unit variance per entry of a dense vector; constant entries become 0."""
    model = StandardScaler(inputCol=in_col, outputCol=out_col, withMean=True, withStd=True).fit(df)
    return model.transform(df)


def principal_components(df: DataFrame, in_col: str, k: int = 5, out_col: str = "pca") -> DataFrame:
    """Components of dense vectors of a fixed width (an embedder's), already centred."""
    width = len(df.select(in_col).first()[0])
    model = PCA(k=max(1, min(k, width)), inputCol=in_col, outputCol=out_col).fit(df)
    return model.transform(df)


def standardized_components(df: DataFrame, in_col: str, k: int = 5,
                            out_col: str = "pca") -> DataFrame:
    """Components of the standardised entries of a (sparse) vector column of a fixed width.

    Scaling by 1 / std keeps sparse rows sparse and has the covariance of the
    standardised rows; their projection is the scaled row's minus one constant
    vector.  Constant entries contribute 0.
    """
    scaler = StandardScaler(inputCol=in_col, outputCol="_scaled", withMean=False,
                            withStd=True).fit(df)
    scaled = scaler.transform(df)
    width = scaler.std.size
    model = PCA(k=max(1, min(k, width)), inputCol="_scaled", outputCol="_proj").fit(scaled)
    std, mean = scaler.std.toArray(), scaler.mean.toArray()
    centre = np.divide(mean, std, out=np.zeros_like(mean), where=std > 0)
    shift = F.array(*[F.lit(float(v)) for v in model.pc.toArray().T @ centre])
    proj = F.zip_with(vector_to_array("_proj", "float64"), shift, lambda a, b: a - b)
    return model.transform(scaled).withColumn(out_col, array_to_vector(proj)) \
        .drop("_scaled", "_proj")


def as_array(col: str = "pca") -> F.Column:
    return vector_to_array(F.col(col), "float64")
