"""Language ID: a byte convolutional network in numpy.

Bytes are embedded, convolved by filters of widths 2 to 5, passed through a
rectifier, max-pooled over a window of ``WINDOW`` bytes and classified by
softmax.  The network is trained with Adam on windows of labelled text: at most
about ``PER_LANGUAGE`` documents of each language, picked by a hash of their id
against the language's count, and ``WINDOWS_EACH`` windows of each.  Prediction
cuts every whole text into consecutive windows, runs them in batches and
averages the windows' probabilities by their bytes.  Training and prediction
share no column but text and, for training, the label.

Defined results: null and empty texts and texts without a letter are ``und``
with score 0; without any labelled text everything is ``und``; a single known
language is predicted for all other texts; repeated rows are predicted one by
one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.llm.tables import fresh
from wayfarer.llm.text_arrays import flat

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 10
EMBEDDING = 8
PER_LANGUAGE = 500
WINDOWS_EACH = 4
EPOCHS = 12
BATCH = 64
RATE = 3e-3
#: Windows run at once when predicting: a few MB of unfolded input.
BLOCK = 64
FOLDS, HELD_OUT = 4, 2


class ByteNetwork:
    """Parameters, training and batched prediction.  Byte 0 is padding with a zero embedding."""

    def __init__(self, languages: list[str], seed: int = 6):
        rng = np.random.default_rng(seed)
        self.languages = languages
        span, total = max(WIDTHS), FILTERS * len(WIDTHS)
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.embedding[0] = 0
        # One kernel matrix for all widths; narrow filters have zeros beyond their width.
        self.mask = np.zeros((span * EMBEDDING, total), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width * EMBEDDING, k * FILTERS:(k + 1) * FILTERS] = 1
        self.kernel = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(total, np.float32)
        self.out = rng.normal(0, 0.1, (total, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    NAMES = ("embedding", "kernel", "bias", "out", "out_bias")

    def unfold(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, span * embedding) from (windows, WINDOW) bytes."""
        n, size = windows.shape
        span = max(WIDTHS)
        padded = np.zeros((n, size + span - 1), np.uint8)
        padded[:, :size] = windows
        seen = np.ascontiguousarray(self.embedding[padded]).reshape(n, -1)
        view = np.lib.stride_tricks.sliding_window_view(seen, span * EMBEDDING, axis=1)
        return view[:, ::EMBEDDING]

    def pool(self, windows: np.ndarray):
        unfolded = self.unfold(windows)
        n, size, k = unfolded.shape
        flat_in = unfolded.reshape(n * size, k)
        act = (flat_in @ self.kernel).reshape(n, size, -1)
        return flat_in, act

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        _, act = self.pool(windows)
        hidden = np.maximum(act.max(axis=1) + self.bias, 0)
        return softmax(hidden @ self.out + self.out_bias)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 6):
        rng = np.random.default_rng(seed)
        moments = {name: [np.zeros_like(getattr(self, name)), np.zeros_like(getattr(self, name))]
                   for name in self.NAMES}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), BATCH):
                step += 1
                pick = order[lo:lo + BATCH]
                gradients = self.gradients(windows[pick], labels[pick])
                for name, g in zip(self.NAMES, gradients):
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    getattr(self, name)[...] -= RATE * (m / (1 - 0.9 ** step)) / (
                        np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    def gradients(self, windows: np.ndarray, labels: np.ndarray):
        n = len(labels)
        flat_in, act = self.pool(windows)
        best = act.argmax(axis=1)  # (n, filters)
        top = np.take_along_axis(act, best[:, None, :], axis=1)[:, 0] + self.bias
        hidden = np.maximum(top, 0)
        delta = softmax(hidden @ self.out + self.out_bias)
        delta[np.arange(n), labels] -= 1
        delta /= n
        g_out, g_out_bias = hidden.T @ delta, delta.sum(0)
        g_top = (delta @ self.out.T) * (top > 0)
        g_bias = g_top.sum(0)
        # Only the pooled positions carry gradient.
        rows = np.arange(n)[:, None] * act.shape[1] + best
        picked = flat_in[rows]  # (n, filters, span * embedding)
        g_kernel = np.einsum("nf,nfk->kf", g_top, picked) * self.mask
        g_in = (g_top[:, :, None] * self.kernel.T[None]).reshape(n, -1, max(WIDTHS), EMBEDDING)
        g_embedding = np.zeros_like(self.embedding)
        padded = np.zeros((n, windows.shape[1] + max(WIDTHS) - 1), np.uint8)
        padded[:, :windows.shape[1]] = windows
        for k in range(max(WIDTHS)):
            np.add.at(g_embedding, padded[np.arange(n)[:, None], best + k], g_in[:, :, k])
        g_embedding[0] = 0
        return g_embedding, g_kernel, g_bias, g_out, g_out_bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_windows(docs: DataFrame, text: str, lang: str, ident: str, per_language: int):
    """Bounded sample: (windows, language names) on the driver.

    A document takes part if the uniform number of its id's hash lies under
    ``per_language`` over its language's documents.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(ident).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    names = labelled.select("i", "l")
    counts = names.groupBy("l").agg(F.count("*").alias("n"))
    u = (F.xxhash64(F.lit("language"), "i") / 2.0 ** 63 + 1) / 2
    chosen = names.join(counts, "l").filter(u * F.col("n") < per_language).select("i", "l").distinct()
    # About per_language ids a language; the texts stay where they are read.
    rows = labelled.join(F.broadcast(chosen), (labelled["i"].eqNullSafe(chosen["i"]))
                         & (labelled["l"] == chosen["l"]), "left_semi")

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("t"))
            found, names, keys = [], [], []
            for k, (name, ident) in enumerate(zip(batch.column("l").to_pylist(), batch.column("i").to_pylist())):
                raw = data[offsets[k]:offsets[k + 1]]
                # Spread over the whole text; short texts give one padded window.
                room = max(0, len(raw) - WINDOW)
                # Odd windows are cut short, so that short texts are learnt too.
                for j, at in enumerate(sorted({room * w // max(1, WINDOWS_EACH - 1) for w in range(WINDOWS_EACH)})):
                    found.append(raw[at:at + (WINDOW if j % 2 == 0 else 64)].tobytes())
                    names.append(name)
                    keys.append(str(ident))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string()),
                                              pa.array(found, pa.binary())], ["i", "l", "w"])

    # A document repeated many times counts once.
    got = sorted((r["l"], r["i"], bytes(r["w"])) for r in
                 rows.mapInArrow(run, "i string, l string, w binary").distinct().collect())
    got = [r for r in got if r[2]]
    windows = np.zeros((len(got), WINDOW), np.uint8)
    for k, (_, _, raw) in enumerate(got):
        windows[k, :len(raw)] = np.frombuffer(raw, np.uint8)
    return windows, [r[0] for r in got]


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", ident: str = "doc_id",
        per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> ByteNetwork | None:
    windows, names = training_windows(docs, text, lang, ident, per_language)
    if not names:
        return None
    languages = sorted(set(names))
    network = ByteNetwork(languages)
    where = {name: k for k, name in enumerate(languages)}
    network.train(windows, np.array([where[n] for n in names]), epochs)
    return network


def text_probabilities(network: ByteNetwork, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, languages): the mean of each text's window probabilities by their bytes."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    count = (size + WINDOW - 1) // WINDOW
    doc = np.repeat(np.arange(n), count)
    first = np.repeat(np.cumsum(count) - count, count)
    start = offsets[doc] + (np.arange(len(doc)) - first) * WINDOW
    length = np.minimum(WINDOW, offsets[doc + 1] - start)
    total = np.zeros((n, len(network.languages)))
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    reach = np.arange(WINDOW)
    for lo in range(0, len(doc), BLOCK):
        s, k = start[lo:lo + BLOCK], length[lo:lo + BLOCK]
        windows = padded[s[:, None] + reach]
        windows[reach >= k[:, None]] = 0
        np.add.at(total, doc[lo:lo + BLOCK], network.probabilities(windows) * k[:, None])
    return total / np.maximum(size, 1)[:, None]


def predict(docs: DataFrame, network: ByteNetwork | None, *, text: str = "text") -> DataFrame:
    """``docs`` and, last, a struct column ``language``: lang_pred and score."""
    out = fresh(docs, "language")[0]
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            names, scores = ["und"] * n, np.zeros(n)
            if network is not None and n:
                data, offsets = flat(batch.column(text))
                p = text_probabilities(network, data, offsets)
                best = p.argmax(axis=1)
                for i, value in enumerate(batch.column(text).to_pylist()):
                    if value and any(map(str.isalpha, value)):
                        names[i], scores[i] = network.languages[best[i]], min(1.0, p[i, best[i]])
            column = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)],
                                                ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, kind)]))


def query(spark, sf_dir) -> DataFrame:
    """op6: the language of every document."""
    from wayfarer.session import read_table

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    docs = read_table(spark, sf_dir, "documents")
    network = fit(docs.filter(fold != HELD_OUT).select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", "text"), network).drop("text")
    return found.select("doc_id", (fold == HELD_OUT).alias("held_out"), "language.lang_pred",
                        "language.score")
