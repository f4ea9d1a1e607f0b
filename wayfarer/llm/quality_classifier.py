"""Quality classifier: naive Bayes support vectors.

A text becomes indicators of its hashed n-grams in two blocks: content (words,
word pairs, byte triples) and word shapes (case, length, ending, repetition of
the word before; one to three in a row).  Each indicator is scaled by the log
ratio of its smoothed class counts, each block has length one, and a linear
model with hinge loss is fitted by dual coordinate descent.  A sigmoid fitted on
documents held back from a first fit turns decisions into scores.

The fit takes at most ``MAX_TRAIN`` labelled documents, those with the smallest
hash of their id; scoring reads every whole text in one map without a shuffle,
with a model of fixed size.

Defined results: null and empty texts have no n-grams and get the score of the
intercept; labels other than 0 and 1 are left out of the fit; without two
classes every score is the share of label 1 (0.5 without labels); repeated rows
are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.text_arrays import Hasher, flat, pieces, windows, words

MAX_TRAIN = 6000
CONTENT_BITS, SHAPE_BITS = 18, 13
CONTENT, SHAPES = 1 << CONTENT_BITS, 1 << SHAPE_BITS
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 40
THRESHOLD = 0.3
#: Folds by CRC-32 of the id: rows of fold 0 are held out of the fit.
FOLDS, HELD_OUT = 5, 0


def _byte_classes() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digit, 3 sentence mark, 4 other ASCII, 5 beyond ASCII."""
    table = np.full(256, 4, np.uint8)
    table[97:123], table[65:91], table[48:58], table[128:] = 0, 1, 2, 5
    table[[ord(c) for c in ".,;:?'\"()-"]] = 3
    return table


BYTE_CLASS = _byte_classes()


def shapes(data, starts, ends, hashes, doc) -> np.ndarray:
    """A small number for each word's form."""
    kind = BYTE_CLASS[data]
    count = lambda k: np.concatenate([[0], np.cumsum(kind == k)])
    upper, lower = count(1), count(0)
    capitals = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    length = np.digitize(ends - starts, [2, 5, 10])
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    code = kind[starts].astype(np.int64)
    for part, size in ((kind[ends - 1], 6), (capitals, 2), (length, 4), (same, 2)):
        code = code * size + part
    return code


def indicators(data: np.ndarray, offsets: np.ndarray, hasher: Hasher):
    """Yields each document's sorted distinct feature numbers (content, shapes)."""
    starts, ends, doc = words(data, offsets)
    hashes = hasher.ranges(hasher.prefix(data), starts, ends)
    form = (shapes(data, starts, ends, hashes, doc) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    top = lambda h, bits: (h >> np.uint64(64 - bits)).astype(np.int64)
    by_doc = lambda of: np.searchsorted(of, np.arange(len(offsets)))
    content = [(top(hashes, CONTENT_BITS), by_doc(doc))]
    pair, _, of = windows(hashes, doc, 2)
    content.append((top(pair, CONTENT_BITS), by_doc(of)))
    form_grams = []
    for size in (1, 2, 3):
        gram, _, of = windows(form, doc, size)
        form_grams.append((top(gram, SHAPE_BITS), by_doc(of)))
    wide = data.astype(np.uint32)
    triples = ((((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(2654435761))
               >> np.uint32(32 - CONTENT_BITS)).astype(np.int64) if len(data) > 2 else np.zeros(0, np.int64)
    seen, seen_shapes = np.zeros(CONTENT, bool), np.zeros(SHAPES, bool)
    for i in range(len(offsets) - 1):
        seen[triples[offsets[i]:max(offsets[i], offsets[i + 1] - 2)]] = True
        for values, cut in content:
            seen[values[cut[i]:cut[i + 1]]] = True
        for values, cut in form_grams:
            seen_shapes[values[cut[i]:cut[i + 1]]] = True
        one, two = np.flatnonzero(seen), np.flatnonzero(seen_shapes)
        seen[one] = False
        seen_shapes[two] = False
        yield one.astype(np.int32), two.astype(np.int32)


def scaled(one, two, ratios: np.ndarray):
    """(feature numbers, values): indicators times log-count ratios, blocks of length one."""
    parts = []
    for index, base in ((one, 0), (two, CONTENT)):
        value = ratios[base + index]
        norm = np.sqrt(value @ value)
        parts.append((base + index, value / norm if norm > 0 else value))
    return np.concatenate([parts[0][0], parts[1][0]]), np.concatenate([parts[0][1], parts[1][1]])


def log_count_ratios(rows, labels: np.ndarray) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of smoothed indicator counts, block by block."""
    out = np.zeros(CONTENT + SHAPES, np.float64)
    for block, base, size in ((0, 0, CONTENT), (1, CONTENT, SHAPES)):
        count = []
        for label in (1, 0):
            c = np.full(size, SMOOTHING)
            for row, y in zip(rows, labels):
                if y == label:
                    c[row[block]] += 1
            count.append(c / c.sum())
        out[base:base + size] = np.log(count[0] / count[1])
    return out


def dual_coordinate_descent(xs, y: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS,
                            seed: int = 10) -> np.ndarray:
    """Weights (the last one is the intercept) of the L2-regularised hinge loss.

    ``y`` is -1 or 1; the classes weigh the same in all.
    """
    rng = np.random.default_rng(seed)
    w = np.zeros(size + 1)
    alpha = np.zeros(len(xs))
    limit = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())),
                     cost * len(y) / (2 * max(1, (y < 0).sum())))
    square = np.array([v @ v + 1.0 for _, v in xs])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(xs)):
            index, value = xs[i]
            gradient = y[i] * (w[index] @ value + w[-1]) - 1.0
            step = min(max(alpha[i] - gradient / square[i], 0.0), limit[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[index] += step * y[i] * value
                w[-1] += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w


def fit_sigmoid(decision: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the score's log odds, by Newton steps on smoothed targets."""
    pos, neg = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([decision, np.ones_like(decision)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * decision + b, -30, 30)))
        gradient = x @ (p - target) + 1e-3 * np.array([a, 0.0])
        hessian = (x * (p * (1 - p))) @ x.T + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str,
                  max_train: int):
    """Features and labels of the bounded sample, on the driver."""
    wanted = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(
        F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    wanted = wanted.orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(
        F.broadcast(wanted), "id")  # at most max_train ids

    def run(batches):
        hasher = Hasher(10)
        for batch in batches:
            data, offsets = flat(batch.column("t"))
            found = [f for _, d, o in pieces(data, offsets) for f in indicators(d, o, hasher)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), batch.column("y").cast(pa.int32()),
                 pa.array([f[0].tobytes() for f in found], pa.binary()),
                 pa.array([f[1].tobytes() for f in found], pa.binary())], ["id", "y", "one", "two"])

    made = rows.mapInArrow(run, "id string, y int, one binary, two binary")
    # One row an id, however often a document is repeated.
    got = made.groupBy("id").agg(F.min(F.struct("y", "one", "two")).alias("r")).collect()
    got.sort(key=lambda r: r["id"])
    as_ints = lambda b: np.frombuffer(bytes(b), np.int32)
    return ([(as_ints(r["r"]["one"]), as_ints(r["r"]["two"])) for r in got],
            np.array([r["r"]["y"] for r in got], np.int64))


class Model:
    """Weights already times the ratios' scaling, and the sigmoid."""

    def __init__(self, rows, labels: np.ndarray):
        self.constant = float(labels.mean()) if len(labels) else 0.5
        self.weights = None
        if len(set(labels.tolist())) < 2:
            return
        back = np.arange(len(labels)) % 5 == 0
        if len(set(labels[back].tolist())) < 2 or len(set(labels[~back].tolist())) < 2:
            back[:] = False
        part = np.flatnonzero(~back)
        w, ratios = self._fit([rows[i] for i in part], labels[part])
        judged = np.flatnonzero(back) if back.any() else part
        self.sigmoid = fit_sigmoid(np.array([self._decide(rows[i], w, ratios) for i in judged]),
                                   labels[judged])
        self.weights, self.ratios = (w, ratios) if not back.any() else self._fit(rows, labels)
        self.weights, self.ratios = self.weights.astype(np.float32), self.ratios.astype(np.float32)

    @staticmethod
    def _fit(rows, labels):
        ratios = log_count_ratios(rows, labels)
        xs = [scaled(*row, ratios) for row in rows]
        return dual_coordinate_descent(xs, np.where(labels == 1, 1.0, -1.0), CONTENT + SHAPES), ratios

    @staticmethod
    def _decide(row, w, ratios):
        index, value = scaled(*row, ratios)
        return w[index] @ value + w[-1]

    def score(self, row) -> float:
        if self.weights is None:
            return self.constant
        a, b = self.sigmoid
        z = float(self._decide(row, self.weights, self.ratios))
        return 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """A model from at most ``max_train`` documents with a label 0 or 1."""
    return Model(*training_rows(docs, labels, doc_id, text, label, max_train))


def score_texts(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` and a double column ``out``."""
    from pyspark.sql import types as T

    def run(batches):  # the model goes along: a few MB, whatever the input
        hasher = Hasher(10)
        for batch in batches:
            data, offsets = flat(batch.column(text))
            scores = [model.score(f) for _, d, o in pieces(data, offsets)
                      for f in indicators(d, o, hasher)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def query(spark, sf_dir) -> DataFrame:
    """op10: a quality score for every document."""
    from wayfarer.session import read_table

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs, labels.filter(fold != HELD_OUT))
    small = score_texts(docs, model).drop("text")
    return small.select("doc_id", (fold == HELD_OUT).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
