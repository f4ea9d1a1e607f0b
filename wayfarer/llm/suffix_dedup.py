"""Exact-substring dedup with run-length Burrows-Wheeler indexes.

Every byte covered by a ``window``-byte string that also starts elsewhere in the
corpus is removed, all copies included.

1. Each window of a text is filed under its smallest gram hash (``anchors``);
   consecutive windows of one anchor make a run, a range of a few hundred bytes.
   Equal windows meet under one key.
2. Keys are counted; runs whose key occurs once hold no repeat and go no further
   (one combinable count, one join), unless a run may repeat itself.  Equal runs of a key are one entry with a
   count: runs that occur twice are repeats as a whole.
3. The distinct runs of a key, and those of many keys together, are built into a
   run-length index with sampled run ends (``run_index``); its matching
   statistics are streamed over the same runs and mark the long matches.
4. A key with more than ``GROUP`` distinct runs is first split: its windows are
   parted by their distance from the anchor, and each part is filed under the
   bytes all its windows share.  Parts shrink level by level, down to single
   windows, where equal parts are equal strings.
5. The marks go back to their documents, which are cut.

Texts travel compressed, beside a row number given when the input is stored, so
ids may repeat or be null.  Decisions rest on 64-bit content hashes within equal
44-bit keys; nothing else is approximate.

Defined results: null counts as empty; texts shorter than the window stay whole;
repeated rows are documents of their own, so they are repeats of each other; an
empty table gives an empty result.  Cut texts are decoded without the bytes of
characters that were cut in part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.llm.anchors import runs
from wayfarer.llm.run_index import RunIndex
from wayfarer.llm.tables import drop, fresh, released, store
from wayfarer.llm.text_arrays import Hasher, flat, pieces

WINDOW = 200
GRAM = 32
#: Distinct runs of one key that are indexed together; more are split first.
GROUP = 256
#: Bytes indexed at once, of one key or many.
INDEX_BYTES = 1 << 20
#: Distances from the anchor that a part spans, level by level.
SPANS = (43, 11, 3, 1)


def stored_rows(docs: DataFrame, text: str, uid: str, packed: str) -> tuple[DataFrame, str]:
    """``docs`` without the text, with a row number and the compressed text, written once."""
    others = [f for f in docs.schema.fields if f.name != text]

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        packer = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = flat(batch.column(text))
            n = batch.num_rows
            z = [packer.compress(data[offsets[i]:offsets[i + 1]].tobytes()) for i in range(n)]
            nulls = batch.column(text).is_null().to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in others], pa.array(np.arange(number, number + n)),
                 pa.array([None if x else v for v, x in zip(z, nulls)], pa.binary())],
                [*[f.name for f in others], uid, packed])
            number += n

    schema = T.StructType([*others, T.StructField(uid, T.LongType()),
                           T.StructField(packed, T.BinaryType())])
    return store(docs.mapInArrow(run, schema), "texts")


def unpacked(column):
    """(bytes, offsets) of a column of compressed texts."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    raw = [b"" if z is None else unpack.decompress(z) for z in column.to_pylist()]
    return (np.frombuffer(b"".join(raw), np.uint8),
            np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


RUNS = "key long, content long, uid long, start int, length int, anchor int, again boolean"


def anchored_runs(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """All runs of all documents; ``rows`` has uid and the compressed text z."""
    def run(batches):
        hasher = Hasher(4)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                data, offsets = unpacked(some.column("z"))
                uids = some.column("uid").to_numpy()
                for first, d, o in pieces(data, offsets):
                    key, content, doc, start, end, anchor, again = runs(d, o, hasher, window, gram)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)),
                         pa.array(uids[first + doc]), pa.array((start - o[doc]).astype(np.int32)),
                         pa.array((end - start).astype(np.int32)),
                         pa.array((anchor - start).astype(np.int32)), pa.array(again)],
                        ["key", "content", "uid", "start", "length", "anchor", "again"])

    return rows.mapInArrow(run, RUNS)


def cut_runs(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, item, m, anchor, raw): the bytes of the wanted runs, from one document of each."""
    asked = wanted.groupBy("uid").agg(F.collect_list(
        F.struct("node", "item", "m", "start", "length", "anchor")).alias("asked"))  # one document's runs

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for z, asked in zip(batch.column("z").to_pylist(), batch.column("asked").to_pylist()):
                raw = unpack.decompress(z)
                out.extend((r["node"], r["item"], r["m"], r["anchor"],
                            raw[r["start"]:r["start"] + r["length"]]) for r in asked)
                if len(out) > 20_000:
                    yield _entries(out)
                    out = []
            if out:
                yield _entries(out)

    return asked.join(rows, "uid").select("z", "asked").mapInArrow(run, ENTRIES)


ENTRIES = "node long, item long, m long, anchor int, raw binary"


def _entries(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      ["node", "item", "m", "anchor", "raw"])


MARKS = "node long, item long, a int, b int"


def indexed_marks(entries: DataFrame, window: int) -> DataFrame:
    """(node, item, a, b): ranges of the entries that repeat among the entries of their node.

    Nodes come whole, as bounded groups; as many as fit are indexed together.
    """
    dealt = entries.select("node", "item", "raw").repartition("node").sortWithinPartitions("node")

    def marks(names, strings):
        found = RunIndex(strings).long_matches(window)
        rows = [(node, item, a, b) for (node, item), ranges in zip(names, found) for a, b in ranges]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                          ["node", "item", "a", "b"])

    def run(batches):
        names, strings, size, last = [], [], 0, None
        for batch in batches:
            for node, item, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if node != last and size >= INDEX_BYTES:
                    yield marks(names, strings)
                    names, strings, size = [], [], 0
                last = node
                names.append((node, item))
                strings.append(raw)
                size += len(raw)
        if strings:
            yield marks(names, strings)

    return dealt.mapInArrow(run, MARKS)


PARTS = "node long, item long, parent long, whole long, base int, anchor int, raw binary"


def _leftmost(raw: bytes, anchor: int, window: int, gram: int):
    """(window start, its leftmost anchor) for a run's windows: the gram may occur more than once."""
    text, found, at = raw[anchor:anchor + gram], [], raw.find(raw[anchor:anchor + gram])
    while at >= 0:
        found.append(at)
        at = raw.find(text, at + 1)
    starts = np.arange(len(raw) - window + 1)
    where = np.array(found)
    return starts, where[np.searchsorted(where, starts)]


def split_parts(entries: DataFrame, span: int, window: int, gram: int) -> DataFrame:
    """(node, item, parent, whole, base, anchor, raw): parts of runs by distance from the anchor.

    A part holds a run's windows whose distance from the anchor lies in one
    stretch of ``span``; it is filed under that stretch and the bytes that all
    such windows share.  ``item`` is the hash of the part's own bytes, ``base``
    its place in the run (parent, whole) and ``anchor`` the anchor's in the part.
    """
    def run(batches):
        hasher = Hasher(5)
        for batch in batches:
            out = []
            for parent, whole, anchor, raw in zip(*(batch.column(c).to_pylist() for c in
                                                    ("node", "item", "anchor", "raw"))):
                starts, anchors = _leftmost(raw, anchor, window, gram)
                distance = anchors - starts
                stretch = distance // span
                begin = np.flatnonzero(np.concatenate(
                    [[True], (stretch[1:] != stretch[:-1]) | (anchors[1:] != anchors[:-1])]))
                stop = np.append(begin[1:], len(starts)) - 1
                prefix = hasher.prefix(np.frombuffer(raw, np.uint8))
                least = stretch[begin] * span
                most = least + span - 1
                # All windows of the stretch cover the bytes from ``least`` before the anchor on.
                core_end = np.maximum(anchors[begin] - most + window, anchors[begin] + gram)
                core = hasher.ranges(prefix, anchors[begin] - least, core_end)
                first, last = starts[begin], starts[stop] + window
                own = hasher.ranges(prefix, first, last)
                node = core * np.uint64(0x9E3779B97F4A7C15) + np.uint64(parent & (1 << 63) - 1) \
                    + stretch[begin].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                for k in range(len(begin)):
                    out.append((int(node[k].view(np.int64)), int(own[k].view(np.int64)), parent, whole,
                                int(first[k]), int(anchors[begin[k]] - first[k]), raw[first[k]:last[k]]))
                if len(out) >= 20_000:
                    yield parts_batch(out)
                    out = []
            if out:
                yield parts_batch(out)

    def parts_batch(rows):
        kinds = (pa.int64(),) * 4 + (pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                          ["node", "item", "parent", "whole", "base", "anchor", "raw"])

    return entries.mapInArrow(run, PARTS)


def repeated_ranges(rows: DataFrame, *, window: int = WINDOW, gram: int = GRAM,
                    group: int = GROUP) -> tuple[DataFrame, str]:
    """(uid, ranges): byte ranges (a, b) of documents that repeat; together all of them.  And its path.

    ``rows`` has uid and the compressed text z.  A row a run that holds a repeat.
    """
    spark = rows.sparkSession
    found, found_path = store(anchored_runs(rows, window, gram), "runs")
    often = found.groupBy("key").agg(F.count("*").alias("n"), F.max("again").alias("again")).filter(
        "n > 1 or again").select("key")
    # Stored, so that the join has an exchange of its own and can split a hot key.
    often, often_path = store(often, "repeated-keys")
    shared, shared_path = store(found.join(often, "key"), "shared-runs")
    drop(spark, found_path, often_path)
    released(spark)

    distinct = shared.groupBy("key", "content").agg(
        F.count("*").alias("m"), F.min(F.struct("uid", "start", "length", "anchor", "again")).alias("one"))
    distinct, distinct_path = store(distinct.select("key", "content", "m", "one.*"), "distinct-runs")
    several = distinct.groupBy("key").agg(F.count("*").alias("d"), F.max("again").alias("again")).filter(
        "d > 1 or again").select("key")
    several, several_path = store(several, "mixed-keys")
    wanted = distinct.join(several, "key").select(
        F.col("key").alias("node"), F.col("content").alias("item"), "m", "uid", "start", "length", "anchor")
    entries, entries_path = store(cut_runs(wanted, rows), "entries")

    # Marks within runs: (key, content, a, b).
    marks = [distinct.filter("m > 1").select("key", "content", F.lit(0).alias("a"),
                                             F.col("length").alias("b"))]
    paths = [shared_path, distinct_path, several_path, entries_path]
    place = None  # from (node, item) to (key, content, base); None: they are the same
    for span in (*SPANS, None):
        sizes = entries.groupBy("node").agg(F.count("*").alias("d"))
        sized = entries.join(sizes, "node")
        if place is not None:  # a part cannot repeat a window of its own, a run can
            sized = sized.filter("d > 1")
        small = sized.filter(F.col("d") <= group) if span else sized
        got, path = store(indexed_marks(small, window), "marks")
        paths.append(path)
        marks.append(_placed(got, place))
        if span is None:
            break
        large, path = store(sized.filter(F.col("d") > group).select(*entries.columns), "large")
        paths.append(path)
        if large.isEmpty():
            break
        parts, path = store(split_parts(large, span, window, gram), "parts")
        paths.append(path)
        inner = parts.select("node", "item", F.col("parent").alias("parent_node"),
                             F.col("whole").alias("parent_item"), "base")
        if place is None:
            place = inner.select("node", "item", F.col("parent_node").alias("key"),
                                 F.col("parent_item").alias("content"), "base")
        else:
            up = place.select(F.col("node").alias("parent_node"), F.col("item").alias("parent_item"),
                              "key", "content", F.col("base").alias("up"))
            place = inner.join(up, ["parent_node", "parent_item"]).select(
                "node", "item", "key", "content", (F.col("base") + F.col("up")).alias("base"))
        place, path = store(place.distinct(), "places")
        paths.append(path)
        # Equal parts are one entry; the runs they come from are distinct, so two of them are a repeat.
        merged = parts.groupBy("node", "item").agg(
            F.count("*").alias("m"), F.min("anchor").alias("anchor"), F.min("raw").alias("raw"))
        entries, path = store(merged, "entries")
        paths.append(path)
        marks.append(_placed(entries.filter("m > 1").select(
            "node", "item", F.lit(0).alias("a"), F.length("raw").alias("b")), place))

    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    # One row a content, whatever levels marked it; stored, so that the join can split a hot one.
    united, path = store(every.groupBy("key", "content").agg(
        united_ranges(F.collect_set(F.struct("a", "b"))).alias("ranges")), "united-marks")
    paths.append(path)
    result, path = store(shared.select("key", "content", "uid", "start").join(united, ["key", "content"]).select(
        "uid", F.transform("ranges", lambda r: F.struct(
            (F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"]).alias("b"))).alias("ranges")), "repeats")
    drop(spark, *paths)
    released(spark)
    return result, path


def united_ranges(ranges) -> F.Column:
    """The maximal ranges that an array of (a, b) covers, in order; a run has at most as many as bytes."""
    def take_in(done, r):
        last = F.element_at(done, -1)
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))
        return F.when(last["b"] < r["a"], F.concat(done, F.array(r))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))

    ordered = F.array_sort(ranges)
    return F.aggregate(ordered, F.slice(ordered, 1, 1), take_in)


def _placed(marks: DataFrame, place: DataFrame | None) -> DataFrame:
    """(key, content, a, b) of marks on (node, item)."""
    if place is None:
        return marks.select(F.col("node").alias("key"), F.col("item").alias("content"), "a", "b")
    return marks.join(place, ["node", "item"]).select(
        "key", "content", (F.col("a") + F.col("base")).alias("a"), (F.col("b") + F.col("base")).alias("b"))


CUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                    T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def remove_repeats(docs: DataFrame, *, text: str = "text", keep_text: bool = True,
                   **settings) -> DataFrame:
    """``docs`` with repeats cut from ``text`` and, last, a struct column ``removal``.

    Its fields: n_bytes, n_removed, n_spans and kept_sha256 of the remaining
    bytes.  ``keep_text=False`` leaves the text column out.
    """
    spark = docs.sparkSession
    uid, packed, other, covers = fresh(docs, "uid", "z", "row_uid", "covers")
    rows, rows_path = stored_rows(docs, text, uid, packed)
    thin = rows.select(F.col(uid).alias("uid"), F.col(packed).alias("z"))
    ranges, ranges_path = repeated_ranges(thin, **settings)
    per_row = ranges.groupBy(F.col("uid").alias(other)).agg(
        F.flatten(F.collect_list("ranges")).alias(covers))  # one document's ranges
    joined = rows.join(per_row, F.col(uid) == F.col(other), "left").drop(other, uid)
    out = fresh(docs, "removal")[0]
    others = [f for f in docs.schema.fields if f.name != text]
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, stats = [], []
            for z, ranges in zip(batch.column(packed).to_pylist(), batch.column(covers).to_pylist()):
                raw = b"" if z is None else unpack.decompress(z)
                change = np.zeros(len(raw) + 1, np.int64)
                for r in ranges or ():
                    change[r["a"]] += 1
                    change[r["b"]] -= 1
                gone = np.cumsum(change[:-1]) > 0
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                stats.append({"n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": spans,
                              "kept_sha256": hashlib.sha256(left).hexdigest()})
                kept.append(None if z is None else left.decode("utf-8", "ignore") if keep_text else None)
            columns = {f.name: batch.column(f.name) for f in others}
            columns[text] = pa.array(kept, pa.string())
            kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                              ("kept_sha256", pa.string())])
            yield pa.RecordBatch.from_arrays([*[columns[f.name] for f in fields], pa.array(stats, kind)],
                                             [*[f.name for f in fields], out])

    return joined.mapInArrow(run, T.StructType([*fields, T.StructField(out, CUT)]))


def query(spark, sf_dir) -> DataFrame:
    """op4: what is cut from every document."""
    from wayfarer.session import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select("doc_id", "removal.*")
