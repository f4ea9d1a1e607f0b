"""Embedding near-dedup: product quantisation with inverted lists.

A coarse k-means splits the unit vectors into cells (the inverted lists); inside
a cell the residual is cut into subspaces and each part coded by its nearest of
up to 256 codewords.  A query goes to every cell that can hold a vector within
the cosine bound: if y lies in cell c and |x - y| <= r, then
|x - c|^2 - |x - c_x|^2 <= 2 r |c - c_x| for x's own centre c_x.  In a cell its
distance to each coded vector is a sum of table lookups, and a vector is reranked
by exact cosine if that distance is at most r plus its own coding error.  Both
bounds are exact, so no link is lost; the codebooks, fitted on a bounded sample,
only decide how much is compared.

Equal vectors are one class with a count.  A cell is dealt out in blocks of about
``BLOCK`` classes, stored once.  Every two blocks that may hold a link meet once, the
classes of the one as queries to the other's, and a link counts for both ends: tasks
read blocks from the store, so what is shuffled and kept on disk grows with the vectors
and not with the cells that they probe.  A task sends back one count a class, and only
a spanning set of its links, never all pairs.

Defined results: rows whose vector is null, zero, empty or holds null or
non-finite parts link with nothing, nor do rows with a null id (component null,
kept).  Vectors of different length never link.  A repeated (id, vector) row is
one vector; its rows all get its result.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.components import connected_components
from wayfarer.llm.tables import drop, store

THRESHOLD = 0.95
MAX_SAMPLE = 20_000
SUBSPACES = 8
CODEWORDS = 256
BLOCK = 4096
QUERIES = 128


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centres of ``x``; fewer than ``k`` if there are fewer distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)[0]
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(count)])
        for c in np.flatnonzero(count):
            centres[c] = x[order[bounds[c]:bounds[c + 1]]].mean(axis=0)
        empty = np.flatnonzero(count == 0)
        centres[empty] = distinct[rng.choice(len(distinct), len(empty), replace=False)]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray):
    """(index, all squared distances) of the nearest centre."""
    d = (x ** 2).sum(1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(1)
    return d.argmin(axis=1), d


class Quantiser:
    """Coarse centres and residual codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, cells: int):
        dim = sample.shape[1]
        self.centres = kmeans(sample, cells)
        parts = min(SUBSPACES, dim)
        self.cuts = [dim * i // parts for i in range(parts + 1)]
        residual = sample - self.centres[nearest(sample, self.centres)[0]]
        self.books = [kmeans(residual[:, a:b], CODEWORDS, 8) for a, b in zip(self.cuts, self.cuts[1:])]
        # Distances between centres, for the probing bound.
        self.between = np.sqrt(np.maximum(nearest(self.centres, self.centres)[1], 0))

    def encode(self, x: np.ndarray):
        """(cell, codes, coding error) of unit vectors."""
        cell = nearest(x, self.centres)[0]
        residual = x - self.centres[cell]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            codes[:, m] = nearest(residual[:, a:b], book)[0]
            residual[:, a:b] -= book[codes[:, m]]
        return cell, codes, np.sqrt((residual ** 2).sum(1))

    def probes(self, x: np.ndarray, radius: float) -> list[np.ndarray]:
        """Cells that can hold a vector within ``radius``; a little slack covers rounding."""
        own, d = nearest(x, self.centres)
        extra = d - d[np.arange(len(x)), own][:, None]
        return [np.flatnonzero(e <= 2 * radius * self.between[c] + 1e-6) for e, c in zip(extra, own)]

    def asks(self, x: np.ndarray, own: int, cell: int, radius: float) -> np.ndarray:
        """Which vectors of the cell ``own`` must be compared with ``cell``: the bound of ``probes``."""
        d = nearest(x, self.centres[[own, cell]])[1]
        return d[:, 1] - d[:, 0] <= 2 * radius * self.between[own, cell] + 1e-6

    def lookup(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances (coded vectors x queries) in a cell, by table lookup."""
        residual = x - self.centres[cell]
        out = np.zeros((len(codes), len(x)), np.float32)
        part = np.empty_like(out)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            table = np.ascontiguousarray(nearest(residual[:, a:b], book)[1].T, np.float32)
            np.take(table, codes[:, m], axis=0, out=part, mode="clip")
            out += part
        return out


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.stack([np.frombuffer(r, np.float64) for r in raw])


def classes_of(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vector, rep, m, dim): each distinct valid vector, its smallest id and its number of ids."""
    v = F.col("v")
    valid = (F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
             & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists(v, lambda x: x != 0))
    rows = df.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.filter(valid).distinct().groupBy("v").agg(
        F.min("id").alias("rep"), F.count("*").alias("m")).withColumn("dim", F.size("v"))


def fit(classes: DataFrame, max_sample: int, cells: int | None = None) -> dict[int, Quantiser]:
    """A quantiser for every vector length, on at most ``max_sample`` vectors in all."""
    n = classes.count()
    # A cell fills about one block, as long as there are no more cells than that is worth.
    cells = cells or max(8, min(n // BLOCK, int(np.sqrt(n))))
    rows = classes.select("v", "dim").orderBy(F.xxhash64("rep"), "rep").limit(max_sample).collect()
    found = {}
    for dim in sorted({r["dim"] for r in rows}):
        x = np.array([r["v"] for r in rows if r["dim"] == dim], np.float64)
        found[dim] = Quantiser(unit(x), cells)
    return found


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their scale."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


CODED = "dim int, rep long, m long, vec binary, cell int, codes binary, error double"


def encode(classes: DataFrame, quantisers: dict[int, Quantiser]) -> DataFrame:
    def run(batches):
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), np.int64)
            for dim in np.unique(dims):
                pick = np.flatnonzero(dims == dim)
                some = batch.take(pa.array(pick))
                values = some.column("v").flatten().to_numpy(zero_copy_only=False)
                x = unit(values.reshape(len(pick), int(dim)))
                q = quantisers.get(int(dim))
                if q is None:  # a length that the sample lacks: one cell, no codes
                    cell, codes = np.zeros(len(x), int), np.zeros((len(x), 0), np.uint8)
                    error = np.full(len(x), np.inf)
                else:
                    cell, codes, error = q.encode(x)
                yield pa.RecordBatch.from_arrays(
                    [some.column("dim"), some.column("rep"), some.column("m"),
                     pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)),
                     pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error)],
                    ["dim", "rep", "m", "vec", "cell", "codes", "error"])

    return classes.select("dim", "rep", "m", "v").mapInArrow(run, CODED)


#: A cell and the length of its vectors in one number.
PLACE = 1 << 32
PACKED = "place long, probes array<long>, reps binary, copies binary, vecs binary, codes binary, errors binary"


def packs(coded: DataFrame, quantisers: dict[int, Quantiser], radius: float, block: int) -> DataFrame:
    """A row a block of a cell: its classes, packed, and the cells that any of them must be compared with."""
    sizes = coded.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = coded.join(sizes, ["dim", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
    names = ("dim", "cell", "block", "rep", "m", "vec", "codes", "error")

    def packed(key, rows):
        dim, cell, _ = key
        rep, m, vec, codes, error = zip(*rows)
        q = quantisers.get(dim)
        x = np.frombuffer(b"".join(vec), np.float64).reshape(len(rep), -1)
        probes = np.zeros(1, int) if q is None else np.unique(np.concatenate(q.probes(x, radius)))
        values = [pa.array([dim * PLACE + cell]), pa.array([dim * PLACE + probes], pa.list_(pa.int64())),
                  *(pa.array([v], pa.binary()) for v in (
                      np.array(rep, np.int64).tobytes(), np.array(m, np.int64).tobytes(), x.tobytes(),
                      b"".join(codes), np.array(error, np.float64).tobytes()))]
        return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in PACKED.split(", ")])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[:3] != key:
                    if rows:
                        yield packed(key, rows)
                    key, rows = row[:3], []
                rows.append(row[3:])
        if rows:
            yield packed(key, rows)

    return dealt.repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block").select(
        *names).mapInArrow(run, PACKED).withColumn("no", F.monotonically_increasing_id())


class Block:
    """The classes of one block, the ids that each one's links have, and which of them queries have joined."""

    def __init__(self, q: Quantiser | None, cell: int, reps, copies, vecs, codes, errors):
        self.q, self.cell = q, cell
        self.rep, self.m, self.error = (np.frombuffer(b, t) for b, t in (
            (reps, np.int64), (copies, np.int64), (errors, np.float64)))
        self.x = np.frombuffer(vecs, np.float64).reshape(len(self.rep), -1)
        self.codes = None if q is None else np.frombuffer(codes, np.uint8).reshape(len(self.rep), -1)
        self.label = np.arange(len(self.rep))

    def match(self, rep, m, queries: np.ndarray, threshold: float, radius: float, count, own=None):
        """Yields a link of each query that has one, and joins what a query links.

        ``count`` gets the copies of the queries at the classes they link with, ``own`` the other way round.
        """
        if self.q is None:
            near = np.ones((len(self.rep), len(queries)), bool)
        else:
            # The slack covers single-precision rounding of the table sums.
            reach = (radius + self.error) ** 2 + 1e-4
            near = self.q.lookup(queries, self.cell, self.codes) <= reach[:, None]
        at_all, of = np.nonzero(near)
        order = np.argsort(of, kind="stable")
        at_all, bounds = at_all[order], np.searchsorted(of[order], np.arange(len(queries) + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            x, at = queries[k], at_all[bounds[k]:bounds[k + 1]]
            at = at[self.x[at] @ x >= threshold]
            if len(at):
                labels = self.label[at]
                least = labels.min()
                if (labels != least).any():
                    self.label[np.isin(self.label, labels)] = least
                count[at] += m[k]
                if own is not None:
                    own[k] += self.m[at].sum()
                if rep[k] != self.rep[least]:
                    yield int(rep[k]), int(self.rep[least])

    def links(self):
        """Spanning links between the classes that queries have joined."""
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return zip(self.rep[moved].tolist(), self.rep[self.label[moved]].tolist())


SIDES = ("no", "place", "reps", "copies", "vecs", "codes", "errors")


def pairs(blocks: DataFrame) -> DataFrame:
    """Every two blocks that may hold a link (a block with itself, too), once: x's classes are asked for by y's.

    The blocks are not dealt out by what asks for them: a task reads some of the stored ones and some again.
    """
    x = blocks.select(*[F.col(c).alias(f"x_{c}") for c in SIDES])
    y = blocks.select(*[F.col(c).alias(f"y_{c}") for c in ("no", "place", "probes", "reps", "copies", "vecs")])
    return x.join(y, (F.col("x_no") <= F.col("y_no")) & F.array_contains("y_probes", F.col("x_place")))


def compare(asked: DataFrame, quantisers: dict[int, Quantiser], threshold: float, radius: float) -> DataFrame:
    """(a, b, n): b null: n linked ids of class a, itself included, in the blocks of a task; n null: a link."""
    def run(batches):
        no, block, counts, out = None, None, {}, []

        def count_of(number, reps):
            if number not in counts:
                counts[number] = reps, np.zeros(len(reps) // 8, np.int64)
            return counts[number][1]

        def emit():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*zip(*out), [None] * len(out))],
                                               ["a", "b", "n"])
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(f"x_{c}") for c in SIDES] + [
                batch.column(f"y_{c}") for c in ("no", "place", "reps", "copies", "vecs")]
            for i in range(batch.num_rows):
                x_no, place, x_reps, *x, y_no, own, reps, copies, vecs = (c[i].as_py() for c in columns)
                dim, cell = divmod(place, PLACE)
                q = quantisers.get(dim)
                if x_no != no:
                    if block is not None:
                        out.extend(block.links())
                    no, block = x_no, Block(q, cell, x_reps, *x)
                rep, m = np.frombuffer(reps, np.int64), np.frombuffer(copies, np.int64)
                queries = np.frombuffer(vecs, np.float64).reshape(len(rep), -1)
                there, mine = count_of(x_no, x_reps), None if x_no == y_no else count_of(y_no, reps)
                pick = np.arange(len(rep)) if q is None else np.flatnonzero(q.asks(queries, own % PLACE, cell, radius))
                for lo in range(0, len(pick), QUERIES):
                    some = pick[lo:lo + QUERIES]
                    back = None if mine is None else np.zeros(len(some), np.int64)
                    out.extend(block.match(rep[some], m[some], queries[some], threshold, radius, there, back))
                    if mine is not None:
                        mine[some] += back
                if out:
                    yield emit()
        if block is not None:
            out.extend(block.links())
        if out:
            yield emit()
        for reps, found in counts.values():
            held = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(reps, np.int64)[held]), pa.nulls(len(held), pa.int64()), pa.array(found[held])],
                ["a", "b", "n"])

    return asked.mapInArrow(run, "a long, b long, n long")


def near_duplicates(df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding",
                    threshold: float = THRESHOLD, max_sample: int = MAX_SAMPLE,
                    cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    radius = float(np.sqrt(2 - 2 * threshold))
    classes, classes_path = store(classes_of(df, vec_id, embedding), "vectors")
    quantisers = fit(classes, max_sample, cells)
    coded, coded_path = store(encode(classes, quantisers), "coded")
    blocks, blocks_path = store(packs(coded, quantisers, radius, block), "blocks")
    found, found_path = store(compare(pairs(blocks), quantisers, threshold, radius), "links")
    counts = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(
        (F.sum("n") - 1).alias("n_links"))
    member, member_path = connected_components(found.filter(F.col("b").isNotNull()).select("a", "b"))
    per_class = classes.join(counts, "rep", "left").join(
        member.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "v", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    got, _ = store(rows.join(per_class, "v", "left").select(
        "vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id")),
        "embedding-dedup")
    drop(spark, classes_path, coded_path, blocks_path, found_path, member_path)
    return got.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir) -> DataFrame:
    """op3: links and components of every embedding."""
    from wayfarer.session import read_table

    return near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
