"""Periodic runs of words by recompression.

The words of many documents stand in one array of numbers, with a number of its own
before each document and after the last.  Levels alternate: block compression turns
every maximal block of one letter into a letter (letter, length); pair compression
gives each letter a side by a hash, and turns every left letter followed by a right
one into a letter of its own.  Both depend on the letters alone, so equal stretches are compressed equally but
for their ends: the levels are a run-length grammar of the text, on which the longest
common extension of two places is found by climbing while their letters agree and
descending where they first differ (``Grammar.extend``), for all asked pairs at once.

A run of period p and at least 2p words holds two neighbours of the grid p, 2p, 3p...
with equal words.  For every p those neighbours are compared; where they agree, the
exact extensions to both sides give the run.  A run found under several periods keeps
the smallest.  The candidates of a document of n words are at most n (1 + 1/2 + ...).

Python sees one piece of documents at a time, cut by words; the work is one map over
the text, nothing is shuffled.

Defined results: a null or empty text has no words, no runs and the hash of nothing
twice; a null id has no changed words.  Repeated rows and ids are treated row by row;
an empty table gives an empty result; extra columns stay, and a clashing result name
is prefixed with underscores.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.llm.tables import fresh

LEAST_WORDS = 12
#: Words worked on at once; a longer document is a piece of its own.
PIECE_WORDS = 1 << 18

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def sides(letters: np.ndarray, level: int) -> np.ndarray:
    """Whether a letter is a left one at this level."""
    x = (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(63)) == 1


class Level:
    """Letters of one level and how they are grouped into the letters of the next.

    ``starts`` marks the first letter of a group, ``up`` is the group of a letter,
    ``first`` the first letter of a group, ``blocks`` tells the kind of grouping.
    """

    def __init__(self, letters: np.ndarray, starts: np.ndarray, blocks: bool):
        self.letters, self.starts, self.blocks = letters, starts, blocks
        self.first = np.flatnonzero(starts)
        self.up = np.cumsum(starts) - 1
        self.after = np.append(self.first[1:], len(letters))

    def backwards(self) -> "Level":
        """The same grouping of the letters read from the end."""
        ends = np.append(self.starts[1:], True)
        return Level(self.letters[::-1].copy(), ends[::-1].copy(), self.blocks)

    def left_in_group(self, at: np.ndarray) -> np.ndarray:
        return self.after[self.up[at]] - at


class Grammar:
    """Run-length grammar of ``words``; numbers from ``n_shared`` on bound documents.

    The first and the last number are bounds.
    """

    def __init__(self, words: np.ndarray, n_shared: int):
        self.size = len(words)
        self.levels: list[Level] = []
        # Bounds get negative numbers: they never join a group.
        letters = np.where(words >= n_shared, n_shared - 1 - words, words).astype(np.int64)
        new, turn = n_shared, 0
        while np.diff(np.flatnonzero(letters < 0)).max(initial=0) > 3 and turn < 500:
            same = letters[1:] == letters[:-1]
            if same.any():
                starts = np.concatenate([[True], ~same])
                level = Level(letters, starts, True)
                sizes = level.after - level.first
                letters, new = self._named(letters[level.first], sizes, sizes > 1, new)
                self.levels.append(level)
            left = sides(letters, turn)
            joined = left[:-1] & ~left[1:] & (letters[:-1] >= 0) & (letters[1:] >= 0)
            if joined.any():
                starts = np.concatenate([[True], ~joined])
                level = Level(letters, starts, False)
                pairs = (level.after - level.first) == 2
                second = np.where(pairs, letters[level.after - 1], 0)
                letters, new = self._named(letters[level.first], second, pairs, new)
                self.levels.append(level)
            turn += 1
        self.top = letters
        self._reversed: list[Level] | None = None

    @staticmethod
    def _named(letters: np.ndarray, other: np.ndarray, where: np.ndarray, new: int):
        """Letters of the next level: equal (letter, other) get one new number."""
        out = letters.copy()
        key = (letters[where] << 31) | other[where]
        names, place = np.unique(key, return_inverse=True)
        out[where] = new + place
        return out, new + len(names)

    def extend(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and from ``b`` on."""
        return self._extend(self.levels, self.top, a, b)

    def extend_back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words before ``a`` and before ``b``."""
        if self._reversed is None:
            self._reversed = [level.backwards() for level in self.levels]
        return self._extend(self._reversed, self.top[::-1], self.size - a, self.size - b)

    @staticmethod
    def _extend(levels: list[Level], top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places ``a`` and ``b`` differ; the text ends in a letter found nowhere else."""
        query, x, y = np.arange(len(a)), a.copy(), b.copy()
        parted = []  # by level: (query, x, y) whose letters there differ
        for level in levels:
            letters, starts = level.letters, level.starts
            differ = letters[x] != letters[y]
            # Letters inside a group are compared here, first letters of groups above.
            step = np.flatnonzero(~(starts[x] & starts[y]) & ~differ)
            gone = differ & ~(starts[x] & starts[y])
            if level.blocks:
                more_x, more_y = level.left_in_group(x[step]), level.left_in_group(y[step])
                less = np.minimum(more_x, more_y)
                x[step] += less
                y[step] += less
                gone[step[more_x != more_y]] = True
            else:
                x[step] += 1
                y[step] += 1
            parted.append((query[gone], x[gone], y[gone]))
            stay = ~gone
            query, x, y = query[stay], level.up[x[stay]], level.up[y[stay]]
        # At the top a document is a letter or two besides its end.
        live = np.arange(len(query))
        while len(live):
            live = live[top[x[live]] == top[y[live]]]
            x[live] += 1
            y[live] += 1
        for level, (more, more_x, more_y) in zip(reversed(levels), reversed(parted)):
            x, y = level.first[x], level.first[y]
            same = np.flatnonzero(level.letters[x] == level.letters[y])
            if level.blocks:
                less = np.minimum(level.left_in_group(x[same]), level.left_in_group(y[same]))
            else:
                less = 1
            x[same] += less
            y[same] += less
            query, x, y = np.concatenate([query, more]), np.concatenate([x, more_x]), np.concatenate([y, more_y])
        out = np.empty(len(a), np.int64)
        out[query] = x - a[query]
        return out


def grid_candidates(words: np.ndarray, sizes: np.ndarray):
    """(place, period) of neighbours on the grid of each period that hold equal words.

    ``sizes``: words of the documents with a bound each, in descending order, so that
    those long enough for a period are a prefix.
    """
    until = np.cumsum(sizes) + 1
    long_enough = len(sizes)
    places, periods = [], []
    longest = int(sizes[0]) - 1 if len(sizes) else 0
    for p in range(1, longest // 2 + 1):
        while sizes[long_enough - 1] - 1 < 2 * p:
            long_enough -= 1
        end = int(until[long_enough - 1])
        grid = words[0:end:p]
        found = np.flatnonzero(grid[1:] == grid[:-1])
        if len(found):
            places.append(found * p)
            periods.append(np.full(len(found), p, np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def find_runs(documents: list[np.ndarray], least: int = LEAST_WORDS):
    """(document, start, length, period) of all runs, by document, start and period."""
    order = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
    sizes = np.array([len(documents[d]) + 1 for d in order], np.int64)
    n_shared = max((int(d.max()) + 1 for d in documents if len(d)), default=0)
    words = np.empty(int(sizes.sum()) + 1, np.int64)
    at = np.cumsum(sizes) - sizes + 1
    words[0] = n_shared
    for k, d in enumerate(order):
        words[at[k]:at[k] + sizes[k] - 1] = documents[d]
        words[at[k] + sizes[k] - 1] = n_shared + k + 1
    places, periods = grid_candidates(words, sizes)
    if not len(places):
        return (np.zeros(0, np.int64),) * 4
    grammar = Grammar(words, n_shared)
    after = grammar.extend(places, places + periods)
    before = grammar.extend_back(places, places + periods)
    length = after + before + periods
    fits = (length >= 2 * periods) & (length >= least)
    start, length, periods = places[fits] - before[fits], length[fits], periods[fits]
    by = np.lexsort((periods, length, start))
    start, length, periods = start[by], length[by], periods[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, periods = start[new], length[new], periods[new]
    k = np.searchsorted(at, start, "right") - 1
    doc, start = np.array(order, np.int64)[k], start - at[k]
    by = np.lexsort((periods, start, doc))
    return doc[by], start[by], length[by], periods[by]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Marks the words outside every run's part after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) == 0


def by_words(lists: list[list[bytes]], limit: int):
    """Cut a batch into pieces of about ``limit`` words, documents of like length together."""
    some, total = [], 0
    for d in sorted(range(len(lists)), key=lambda d: len(lists[d])):
        if some and total + len(lists[d]) > limit:
            yield some
            some, total = [], 0
        some.append(d)
        total += len(lists[d])
    if some:
        yield some


def collapse_runs(docs: DataFrame, text: str = "text", *, words=None, least: int = LEAST_WORDS) -> DataFrame:
    """All columns of ``docs`` and a struct column ``word_runs``.

    Its fields: n_words, runs (start, length, period; by start, then period) and
    collapsed, the words that no run repeats, joined by one space.  ``words`` may
    change a document's word list before (called with the row's value of the
    column that it names in ``words.column``, and the list).
    """
    out = fresh(docs, "word_runs")[0]
    extra = getattr(words, "column", None)
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.binary())])

    def rows_of(batch):
        lists = [t.split() if t else [] for t in batch.column(text).cast(pa.binary()).to_pylist()]
        if words is not None:
            lists = [words(v, ws) for v, ws in zip(batch.column(extra).to_pylist(), lists)]
        rows = [None] * len(lists)
        for some in by_words(lists, PIECE_WORDS):
            numbers: dict[bytes, int] = {}
            found = find_runs([np.array([numbers.setdefault(w, len(numbers)) for w in lists[d]], np.int64)
                               for d in some], least)
            cut = np.searchsorted(found[0], np.arange(len(some) + 1))
            for k, d in enumerate(some):
                start, length, period = (column[cut[k]:cut[k + 1]] for column in found[1:])
                rest = lists[d]
                if len(start):
                    rest = [w for w, kept in zip(rest, kept_words(len(rest), start, length, period).tolist()) if kept]
                rows[d] = {"n_words": len(lists[d]), "collapsed": b" ".join(rest), "runs": [
                    {"start": s, "length": n, "period": p}
                    for s, n, p in zip(start.tolist(), length.tolist(), period.tolist())]}
        return rows

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(rows_of(some), kind)],
                                                 [*batch.schema.names, out])

    spark_kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", RUN_TYPE),
                               T.StructField("collapsed", T.BinaryType())])
    done = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, spark_kind)]))
    return done.withColumn(out, F.struct(
        F.col(f"{out}.n_words"), F.col(f"{out}.runs"), F.col(f"{out}.collapsed").cast("string").alias("collapsed")))


class Wrapped:
    """The contract's word lists: of one document in ten the end repeats a stretch of it."""

    def __init__(self, column: str):
        self.column = column

    def __call__(self, doc_id, words: list[bytes]) -> list[bytes]:
        h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
        if h % 10 or not n:
            return words
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        again, rest = divmod(n - a, p)
        return words[:a] + words[a:a + p] * again + words[a:a + rest]


def query(spark, sf_dir) -> DataFrame:
    """op13: the runs of every document's words, and what is left without the repeats."""
    from wayfarer.session import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = collapse_runs(docs, words=Wrapped("doc_id")).select("doc_id", "word_runs.*")
    # The greatest length, then the smallest start and period.
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(
        ",", *[r[n].cast("string") for n in ("start", "length", "period")]))
    digest = F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), digest.alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("r.start").alias("start"), (-F.col("r.shorter")).alias("length"),
        F.col("r.period").alias("period"),
        F.expr("(1000 * -r.shorter) div r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
