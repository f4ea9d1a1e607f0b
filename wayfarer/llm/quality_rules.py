"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each document becomes a vector of transformed statistics.  For every language
and source a minimum-covariance-determinant estimate is made by concentration
steps: start from coordinate medians, once with the floors and once with the
quartiles as spread, then refit mean and covariance on the half of the documents that
lies closest until no determinant falls any more; the start of the smaller one counts.
A last step refits on all documents within the chi-square quantile of 0.975.  One step
is one combinable aggregation (counts, sums and cross products per group and distance
bin), so no group, however large, is gathered anywhere.  Documents whose squared robust
Mahalanobis distance exceeds ``cutoff`` are rejected, as are those that fail the
two fixed base rules.

Defined results: null or empty text has no words and fails the base rules; null
language or source is a group of its own; a group of fewer than ``min_group``
documents with words uses the estimate of its language, and that in turn the
one of all documents (with fewer than ``min_group`` in all, nothing but the base
rules rejects); repeated rows are judged one by one; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.llm.tables import drop, fresh, store
from wayfarer.llm.text_arrays import (Hasher, IS_SEPARATOR, flat, per_doc, pieces, windows, words)

BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = ["word_length", "symbols", "capitals", "marks", "digits", "repeats", "dup_lines"]
DIMENSIONS = len(STATISTICS)

#: Spread that each statistic is granted at least, on its transformed scale: the
#: counting noise of the shortest documents.  It keeps constant statistics finite; in
#: a source without any, a tenth of digits or one line in four repeated is too much.
FLOOR = (0.05, 0.03, 0.03, 0.03, 0.05, 0.08, 0.08)
#: Squared distance at which a document is an outlier: seven dimensions' chi-square
#: quantile of 1 - 1e-6, so one ordinary document in a million is rejected.
CUTOFF = 40.52
MIN_GROUP = 50
#: Concentration steps at most; they end when no determinant falls.
STEPS = 15
STARTS = 2
#: Share of a normal sample that the last refit keeps.
TRUSTED = 0.975
BINS_PER_OCTAVE = 8
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


SYMBOLS = _table("#*$%&|<>")
CAPITALS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGITS = _table("0123456789")
MARKS = _table("!?;:=+/\\~^_{}[]@")


def measure(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (documents x 5, long) and statistics (documents x 7) of a piece."""
    n = len(offsets) - 1
    starts, ends, doc = words(data, offsets)
    n_words = np.bincount(doc, minlength=n)
    inside = ~IS_SEPARATOR[data]
    chars = per_doc(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = per_doc(SYMBOLS[data], offsets)
    prefix = hasher.prefix(data)

    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    line_starts, line_ends = cuts[:-1], cuts[1:].copy()
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    closed = (line_ends > line_starts) & (data[line_ends - 1] == 10) if len(data) else \
        np.zeros(0, bool)
    line_ends -= closed
    worded = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=worded[1:])
    has_word = worded[line_ends] > worded[line_starts]
    line_doc, line_hash = line_doc[has_word], hasher.ranges(prefix, line_starts, line_ends)[has_word]
    n_lines = np.bincount(line_doc, minlength=n)
    dup_lines = n_lines
    if len(line_doc):
        order = np.lexsort((line_hash, line_doc))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(line_doc[order]) != 0) | (line_hash[order][1:] != line_hash[order][:-1])
        dup_lines = dup_lines - np.bincount(line_doc[order][new], minlength=n)

    repeated = np.zeros(n, np.int64)
    hashes, first, of = windows(hasher.ranges(prefix, starts, ends), doc, 3)
    if len(hashes):
        order = np.lexsort((hashes, of))
        same = (np.diff(of[order]) == 0) & (hashes[order][1:] == hashes[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered = np.zeros(len(starts), bool)
        for k in range(3):
            covered[first[order[twice]] + k] = True
        repeated = np.bincount(doc[covered], minlength=n)

    base = np.stack([n_words, chars, symbols, dup_lines, repeated], axis=1).astype(np.int64)
    size = np.maximum(chars, 1)
    share = lambda table: np.sqrt(per_doc(table[data], offsets) / size)
    stats = np.stack([np.log(size / np.maximum(n_words, 1)), np.sqrt(symbols / size),
                      share(CAPITALS), share(MARKS), share(DIGITS),
                      np.sqrt(repeated / np.maximum(n_words, 1)),
                      np.sqrt(dup_lines / np.maximum(n_lines, 1))], axis=1)
    return base, np.round(stats, 6)


MEASURED = T.StructType([T.StructField(c, T.LongType()) for c in BASE_COLUMNS]
                        + [T.StructField(c, T.DoubleType()) for c in STATISTICS])


def with_measures(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` and a struct column ``out`` of base counts and statistics of the whole text."""
    kind = pa.struct([(c, pa.int64()) for c in BASE_COLUMNS] + [(c, pa.float64()) for c in STATISTICS])

    def run(batches):
        hasher = Hasher(8)
        for batch in batches:
            data, offsets = flat(batch.column(text))
            parts = [measure(d, o, hasher) for _, d, o in pieces(data, offsets)]
            if not parts:
                continue
            base = np.concatenate([p[0] for p in parts])
            stats = np.concatenate([p[1] for p in parts])
            column = pa.StructArray.from_arrays(
                [pa.array(base[:, i]) for i in range(base.shape[1])]
                + [pa.array(stats[:, i]) for i in range(stats.shape[1])], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, MEASURED)])
    return docs.mapInArrow(run, schema)


def _key(level: int, lang, source):
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))
    return F.concat_ws("\x1f", F.lit(str(level)), *[part(c) for c in (lang, source)[:2 - level]])


def _keys(lang, source):
    return [_key(level, lang, source) for level in range(3)]


def _squared_distance(stats: str, model: str):
    d = [F.col(f"{stats}.{c}") - F.col(f"{model}.mean")[i] for i, c in enumerate(STATISTICS)]
    inverse = F.col(f"{model}.inverse")
    total = F.lit(0.0)
    for i in range(DIMENSIONS):
        row = F.lit(0.0)
        for j in range(DIMENSIONS):
            row = row + inverse[i * DIMENSIONS + j] * d[j]
        total = total + d[i] * row
    return total


def chi_square_share(x: float, dimensions: int) -> float:
    """Share of squared distances up to ``x`` of a normal sample: the incomplete gamma series."""
    a, half = dimensions / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= half / k
        total += term
    return total * math.exp(a * math.log(half) - half - math.lgamma(a))


def chi_square_quantile(share: float, dimensions: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, dimensions) < share else (low, middle)
    return high


def consistency(share: float, dimensions: int = DIMENSIONS) -> float:
    """What the covariance of the closest ``share`` of a normal sample is short of the whole one's."""
    return share / chi_square_share(chi_square_quantile(share, dimensions), dimensions + 2)


MODEL = "_key string, n long, mean array<double>, inverse array<double>, size double"


def _models(sums: DataFrame, floor: tuple, share: float) -> DataFrame:
    """Mean, inverse covariance and its log determinant of each key from counts, sums and cross products.

    The covariance is widened, as the closest ``share`` of a normal sample spreads less
    than the whole; a variance below the floor's square is raised to that.
    """
    widen, least = consistency(share), np.square(floor)

    def run(batches):
        for batch in batches:
            n = batch.column("n_used").to_numpy(zero_copy_only=False).astype(float)
            if not len(n):
                continue
            s = np.array([batch.column(f"s{i}").to_numpy(zero_copy_only=False)
                          for i in range(DIMENSIONS)])
            mean = (s / n).T
            cov = np.zeros((len(n), DIMENSIONS, DIMENSIONS))
            for i in range(DIMENSIONS):
                for j in range(i, DIMENSIONS):
                    q = batch.column(f"q{i}_{j}").to_numpy(zero_copy_only=False)
                    cov[:, i, j] = cov[:, j, i] = q / n - mean[:, i] * mean[:, j]
            cov *= widen
            at = np.arange(DIMENSIONS)
            cov[:, at, at] = np.maximum(cov[:, at, at], least)
            inverse = np.linalg.inv(cov)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("n"),
                 pa.array(list(mean), pa.list_(pa.float64())),
                 pa.array(list(inverse.reshape(len(n), -1)), pa.list_(pa.float64())),
                 pa.array(np.linalg.slogdet(cov)[1])],
                ["_key", "n", "mean", "inverse", "size"])

    return sums.mapInArrow(run, MODEL)


def fit(measured: DataFrame, lang: str, source: str, stats: str, *, min_group: int = MIN_GROUP,
        steps: int = STEPS, floor: tuple = FLOOR) -> tuple[DataFrame, str]:
    """One stored row (key, n, mean, inverse covariance) per language and source.

    ``measured`` is read once a step, so pass a stored table.  Also holds the
    pooled rows of each language and of all documents.  Returns (table, path).
    """
    spark = measured.sparkSession
    rows = (measured.filter(F.col(f"{stats}.n_words") > 0)
            .select(F.explode(F.array(*_keys(F.col(lang), F.col(source)))).alias("_key"),
                    F.col(stats).alias("x")))
    # Start: coordinate quartiles on a grid of 1/256, so that the exact ones' buffer is bounded.
    quartiles = rows.groupBy("_key").agg(
        F.count("*").alias("n"),
        *[F.percentile(F.round(F.col(f"x.{c}") * 256), F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])).alias(f"m{i}")
          for i, c in enumerate(STATISTICS)]).filter(F.col("n") >= min_group)
    mean = F.array(*[F.col(f"m{i}")[1] / 256 for i in range(DIMENSIONS)])
    spreads = [[F.lit(f) for f in floor],
               [F.greatest((F.col(f"m{i}")[2] - F.col(f"m{i}")[0]) / (256 * 1.349), F.lit(f)) for i, f in enumerate(floor)]]
    starts = F.array(*[F.struct(F.lit(str(k)).alias("start"), F.array(*[
        1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(DIMENSIONS) for j in range(DIMENSIONS)
    ]).alias("inverse")) for k, spread in enumerate(spreads)])
    start = quartiles.select("_key", "n", mean.alias("mean"), F.explode(starts).alias("s")).select(
        F.concat_ws("\x1e", "_key", "s.start").alias("_key"), "n", "mean", "s.inverse", F.lit(float("inf")).alias("size"))
    model, path = store(start, "mcd")
    both = rows.withColumn("_key", F.explode(F.array(*[F.concat_ws("\x1e", "_key", F.lit(str(k))) for k in range(STARTS)])))
    for _ in range(steps):
        newer, newer_path = store(_refit(both, model, floor, 0.5).join(
            model.select("_key", F.col("size").alias("before")), "_key"), "mcd")
        settled = newer.filter(F.col("size") < F.col("before") - 1e-6).isEmpty()
        drop(spark, path)
        model, path = newer.drop("before"), newer_path
        if settled:
            break
    best = model.groupBy(F.substring_index("_key", "\x1e", 1).alias("_key")).agg(
        F.min_by(F.struct("n", "mean", "inverse", "size"), F.struct("size", "_key")).alias("m")).select("_key", "m.*")
    best, best_path = store(best, "mcd")
    final, final_path = store(_refit(rows, best, floor, TRUSTED), "mcd")
    drop(spark, path, best_path)
    return final, final_path


def _refit(rows: DataFrame, model: DataFrame, floor: tuple, share: float) -> DataFrame:
    """Models from each key's closest documents: the half of them, or those within a normal sample's ``share``."""
    near = rows.join(model.select(F.col("_key"), F.struct("mean", "inverse").alias("m"), "n"), "_key")
    distance = _squared_distance("x", "m")
    if share == 0.5:
        near = near.withColumn("bin", F.floor(F.log2(distance + F.lit(2.0 ** -10)) * BINS_PER_OCTAVE))
    else:
        near = near.filter(distance <= chi_square_quantile(share, DIMENSIONS)).withColumn("bin", F.lit(0).cast("long"))
    xs = [F.col(f"x.{c}") for c in STATISTICS]
    sums = [F.count("*").alias("n_used"), F.first("n").alias("n"),
            *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)],
            *[F.sum(xs[i] * xs[j]).alias(f"q{i}_{j}")
              for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]]
    bins = near.groupBy("_key", "bin").agg(*sums)
    # The bins up to the one where half of the documents are reached.
    names = [c for c in bins.columns if c not in ("_key", "bin", "n")]
    per_key = bins.groupBy("_key").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(
            F.struct("bin", F.array(*[F.col(c).cast("double") for c in names]).alias("v")))).alias("b"))
    half = F.col("n") / 2
    taken = F.aggregate(
        "b", F.array(*[F.lit(0.0)] * len(names)),
        lambda acc, x: F.when(acc[0] >= half, acc).otherwise(
            F.zip_with(acc, x["v"], lambda p, q: p + q)))
    return _models(per_key.select("_key", "n", taken.alias("v")).select(
        "_key", "n", *[F.col("v")[i].alias(c) for i, c in enumerate(names)]), floor, share)


def judge(measured: DataFrame, model: DataFrame, lang: str, source: str, stats: str, out: str, *,
          cutoff: float = CUTOFF) -> DataFrame:
    """Adds struct ``out``: distance2 (null without an estimate), base_failed, kept."""
    keys = fresh(measured, "_k0", "_k1")
    slots = fresh([*measured.columns, *keys], "_m0", "_m1")
    df = measured.withColumns(dict(zip(keys, _keys(F.col(lang), F.col(source)))))
    for key, slot in zip(keys, slots):
        side = model.select(F.col("_key").alias(f"{slot}_key"), F.struct("mean", "inverse").alias(slot))
        df = df.join(side, F.col(key) == F.col(f"{slot}_key"), "left").drop(f"{slot}_key")
    pooled = model.filter(F.col("_key") == _keys(F.lit(None), F.lit(None))[2]).select(
        F.struct("mean", "inverse")).scalar()  # the one row over all documents
    chosen = fresh(df, "_model")[0]
    df = df.withColumn(chosen, F.coalesce(*[F.col(s) for s in slots], pooled))
    x = F.col(stats)
    failed = (x["n_words"] < MIN_WORDS) | (x["n_repeat_words"] * 100 > x["n_words"] * MAX_REPEAT_PERCENT)
    distance = F.when(x["n_words"] > 0, _squared_distance(stats, chosen))
    df = df.withColumn(out, F.struct(distance.alias("distance2"), failed.alias("base_failed")))
    df = df.withColumn(out, F.struct(
        F.col(f"{out}.distance2").alias("distance2"), F.col(f"{out}.base_failed").alias("base_failed"),
        (~F.col(f"{out}.base_failed")
         & (F.coalesce(F.col(f"{out}.distance2"), F.lit(0.0)) <= cutoff)).alias("kept")))
    return df.drop(*keys, *slots, chosen)


def quality_verdicts(docs: DataFrame, *, text: str = "text", lang: str = "lang",
                     source: str = "source", **settings) -> DataFrame:
    """All columns of ``docs`` and struct columns ``quality_stats`` and ``quality_verdict``.

    The names get a leading underscore where ``docs`` has them already; the two
    are always the last columns.  Texts are read twice (statistics for the fit,
    then again beside the text), never shuffled.
    """
    stats, verdict = fresh(docs, "quality_stats", "quality_verdict")
    cutoff = settings.pop("cutoff", CUTOFF)
    small = with_measures(docs.select(F.col(lang).alias("l"), F.col(source).alias("s"),
                                      F.col(text).alias("t")), "t", "q").drop("t")
    stored, path = store(small, "measures")
    model, _ = fit(stored, "l", "s", "q", **settings)
    drop(docs.sparkSession, path)
    return judge(with_measures(docs, text, stats), model, lang, source, stats, verdict, cutoff=cutoff)


def quality_filter(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns."""
    judged = quality_verdicts(docs, **settings)
    return judged.filter(F.col(f"{judged.columns[-1]}.kept")).select(*docs.columns)


def query(spark, sf_dir) -> DataFrame:
    """op8: one row per document with base counts, distance and verdict."""
    from wayfarer.session import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stored, _ = store(with_measures(docs, "text", "q").drop("text"), "measures")
    model, _ = fit(stored, "lang", "source", "q")
    out = judge(stored, model, "lang", "source", "q", "v")
    return out.select("doc_id", *[F.col(f"q.{c}") for c in BASE_COLUMNS], "v.base_failed", "v.kept",
                      "v.distance2")
