"""Isolation forest on Spark: sampled trees grown per group, scored per batch.

1. Rows draw hashes uniform in [0, 1); rows under a cut-off (about three
   samples' worth per tree) are candidates, and the ``sample`` smallest hashes
   per tree form its sample (bounded groups, top-N per key).
2. ``groupBy("tree").applyInPandas`` grows each tree from its sample.
3. The node table (trees x at most 2*sample nodes, a size fixed by the
   parameters) is broadcast, and ``mapInPandas`` scores every row:
   ``2 ** (-mean path length / c(sample))``.
4. Rows scoring above the exact (1 - contamination) quantile are -1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.operators.quantiles import exact_percentile
from wayfarer.operators.vectors import as_array

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size int, depth int")


def c_factor(n: float) -> float:
    """Average unsuccessful-search path length in a binary search tree of n."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(pdf: pd.DataFrame, seed: int, max_depth: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    x = np.stack(pdf["_v"].to_numpy()) if len(pdf) else np.zeros((0, 1))
    rng = np.random.default_rng([seed, tree])
    rows = []

    def build(idx, depth):
        node = len(rows)
        rows.append(None)
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
            return node
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < t
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        rows[node] = (tree, node, f, t, left, right, len(idx), depth)
        return node

    build(np.arange(len(x)), 0)
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left",
                                       "right", "size", "depth"])


def _path_lengths(x: np.ndarray, nodes: pd.DataFrame) -> np.ndarray:
    """Mean path length over trees for each row of x (vectorised per tree)."""
    total = np.zeros(len(x))
    trees = 0
    for _, t in nodes.groupby("tree"):
        t = t.sort_values("node")
        feat, thr = t["feature"].to_numpy(), t["threshold"].to_numpy()
        left, right = t["left"].to_numpy(), t["right"].to_numpy()
        size, depth = t["size"].to_numpy(), t["depth"].to_numpy()
        leaf_extra = np.array([c_factor(v) for v in size])  # once per node, not per row
        cur = np.zeros(len(x), dtype=np.int64)
        active = feat[cur] >= 0
        while active.any():
            idx = np.flatnonzero(active)
            f = feat[cur[idx]]
            go_left = x[idx, f] < thr[cur[idx]]
            cur[idx] = np.where(go_left, left[cur[idx]], right[cur[idx]])
            active = feat[cur] >= 0
        total += depth[cur] + leaf_extra[cur]
        trees += 1
    return total / max(trees, 1)


def isolation_scores(df: DataFrame, id_col: str, vec_col: str = "pca", n_trees: int = 100,
                     sample: int = 256, seed: int = 42) -> DataFrame:
    """Add ``anomaly_score`` in (0, 1]; higher is more isolated."""
    vals = df.select(id_col, as_array(vec_col).alias("_v"))
    n = vals.count()
    if n == 0:
        return df.withColumn("anomaly_score", F.lit(None).cast("double"))
    psi = min(sample, n)
    max_depth = max(1, math.ceil(math.log2(max(psi, 2))))
    cut = min(1.0, 3.0 * psi / n)
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    u = lambda t: F.pmod(F.xxhash64(F.col(id_col), t, F.lit(seed)),
                         F.lit(1 << 30)) / F.lit(float(1 << 30))
    # One hash first: a row is a candidate of some tree with rate T*cut, then
    # of each tree with rate cut/(T*cut), so each tree still samples at rate
    # ``cut`` and only candidate rows evaluate the per-tree hashes.
    pre = min(1.0, n_trees * cut)
    per_tree = cut / pre
    cand = vals.filter(u(F.lit(-1)) < F.lit(pre)).select(
        id_col, "_v", F.explode(F.filter(trees, lambda t: u(t) < F.lit(per_tree))).alias("tree"))
    cand = cand.withColumn("_u", u(F.col("tree")))
    rank = Window.partitionBy("tree").orderBy("_u", id_col)
    samples = cand.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= psi) \
        .select("tree", "_v")
    nodes = samples.groupBy("tree").applyInPandas(
        lambda pdf: _grow(pdf, seed, max_depth), NODE_SCHEMA).toPandas()
    cn = c_factor(psi)  # the node table's size is fixed by the parameters; it goes along with the function

    def score(batches):
        for batch in batches:
            x = np.array(batch.column("_v").to_pylist(), float)
            h = _path_lengths(x, nodes) if len(x) else np.zeros(0)
            s = np.power(2.0, -h / cn) if cn > 0 else np.ones(len(h))
            keep = [n for n in batch.schema.names if n != "_v"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(s, pa.float64())],
                                             [*keep, "anomaly_score"])

    return df.withColumn("_v", as_array(vec_col)).mapInArrow(score, T.StructType(
        [*df.schema.fields, T.StructField("anomaly_score", T.DoubleType())]))


def flag_anomalies(scored: DataFrame, contamination: float = 0.05,
                   out_col: str = "anomaly") -> DataFrame:
    """-1 where the score is above the exact (1 - contamination) quantile, else 1."""
    q = exact_percentile(scored, "anomaly_score", 1.0 - contamination)
    if q is None:
        return scored.withColumn(out_col, F.lit(1))
    return scored.withColumn(out_col, F.when(F.col("anomaly_score") > F.lit(q), -1)
                             .otherwise(1).cast("int"))
