"""Packing: concatenate and cut.

Pass one tokenizes every partition and stores its documents' token ids with the
running total inside the partition.  A prefix sum over the partitions' totals
(one number a partition) gives each partition its place in the one stream of all
tokens.  Pass two reads the stored ids, cuts the stream into windows of
``window`` tokens and writes those that lie inside a task at once; what a task
holds of the windows across its ends is written as boundary records, at most two
a run of documents, which one small aggregation puts together.  No token is
shuffled except in boundary windows, and a document's length does not matter.

Defined results: null text counts as empty; an empty document is its end token
alone; repeated rows are packed as often as they occur; documents follow each
other in partition order.  Only the last window is shorter than ``window``.  An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.tables import store

WINDOW = 1024
END = 0
TOKENIZER = "byte_bpe_50k"

STREAM = ("part int, seq long, before long, doc_id {id}, n_tokens long, ids binary")
PIECE = "struct<offset:long,doc_id:{id},start:long,length:long,doc_tokens:long,ids:binary>"


def encoder(name: str = TOKENIZER):
    """Function from a list of texts to lists of ids, as the ``tokenizers`` file gives them.

    The same vocabulary and split pattern run faster in tiktoken; texts that hold
    the string of a special token go through ``tokenizers``, whose ids they need.
    """
    import base64
    import os

    import public_tokenizers as P

    made = P.__dict__.setdefault("_wayfarer_encoders", {})  # once a worker process
    if name not in made:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(P.path(f"{name}.json"))
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if any(s in text for s in special):
                return whole.encode(text, add_special_tokens=False).ids
            return quick.encode_ordinary(text)

        made[name] = encode
    return made[name]


def token_stream(docs: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """Rows (part, seq, before, doc_id, n_tokens, ids): each partition's documents in order.

    ``before`` counts the partition's tokens ahead of the document; ids are
    little-endian unsigned 32-bit.
    """
    kind = docs.schema[doc_id].dataType

    def run(batches):
        from pyspark import TaskContext

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        seq = before = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                ids, counts = [], []
                for value in some.column(1).to_pylist():
                    found = encode(value) if value else []
                    found.append(END)
                    ids.append(np.array(found, "<u4").tobytes())
                    counts.append(len(found))
                n = np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(seq, seq + len(n))),
                     pa.array(before + np.cumsum(n) - n), some.column(0), pa.array(n),
                     pa.array(ids, pa.binary())],
                    ["part", "seq", "before", "doc_id", "n_tokens", "ids"])
                seq += len(n)
                before += int(n.sum())

    return docs.select(doc_id, text).mapInArrow(run, STREAM.format(id=kind.simpleString()))


def pack_sequences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                   window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, pieces.

    A piece has offset (in the sequence), doc_id, start (ids of its document
    before it), length, doc_tokens and ids (little-endian unsigned 32-bit); the
    pieces of a sequence are in order and leave no gap.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    stream, _ = store(token_stream(docs, doc_id, text, tokenizer), "tokens")
    totals = stream.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    # One number a partition of the first pass.
    sizes = {r["part"]: r["n"] for r in totals.collect()}
    base, place = {}, 0
    for part in sorted(sizes):
        base[part] = place
        place += sizes[part]
    end = place
    piece = PIECE.format(id=kind)
    arrow_piece = pa.list_(pa.struct([
        ("offset", pa.int64()), ("doc_id", pa.null()), ("start", pa.int64()), ("length", pa.int64()),
        ("doc_tokens", pa.int64()), ("ids", pa.binary())]))

    def cut(batches):
        open_id, open_pieces, expected = None, [], None
        out = []

        def flush(whole):
            if open_pieces:
                out.append((open_id, whole, list(open_pieces)))
                open_pieces.clear()

        def rows(id_type):
            struct = pa.list_(pa.struct([pa.field("doc_id", id_type) if f.name == "doc_id" else f
                                         for f in arrow_piece.value_type]))
            names = [f.name for f in struct.value_type]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.bool_()),
                 pa.array([[dict(zip(names, p)) for p in r[2]] for r in out], struct)],
                ["sequence_id", "whole", "pieces"])
            out.clear()
            return batch

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            parts, befores, docs_, counts, ids = (
                batch.column(c).to_pylist() for c in ("part", "before", "doc_id", "n_tokens", "ids"))
            for part, before, doc, n, raw in zip(parts, befores, docs_, counts, ids):
                at = base[part] + before
                if at != expected:
                    flush(False)
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    if sequence != open_id:
                        flush(False)
                        open_id = sequence
                    length = min(window - offset, n - start)
                    open_pieces.append((offset, doc, start, length, n,
                                        raw[4 * start:4 * (start + length)]))
                    start += length
                    if open_pieces[0][0] == 0 and (offset + length == window or at + start == end):
                        flush(True)
                        open_id = None
                expected = at + n
                if len(out) >= 256:
                    yield rows(id_type)
        flush(False)
        if out:
            yield rows(id_type)

    cuts, _ = store(stream.select("part", "before", "doc_id", "n_tokens", "ids").mapInArrow(
        cut, f"sequence_id long, whole boolean, pieces array<{piece}>"), "cuts")
    # Boundary records: the parts of a window that different tasks hold.
    joined = cuts.filter(~F.col("whole")).groupBy("sequence_id").agg(
        F.array_sort(F.flatten(F.collect_list("pieces")),
                     lambda a, b: (a["offset"] - b["offset"]).cast("int")).alias("pieces"))
    done = cuts.filter("whole").select("sequence_id", "pieces").unionByName(joined)
    return done.select("sequence_id", F.aggregate(
        "pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["length"]).alias("n_tokens"), "pieces")


def query(spark, sf_dir) -> DataFrame:
    """op5: one row per piece of every document."""
    from wayfarer.session import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_sequences(docs).select("sequence_id", F.explode("pieces").alias("p")).select(
        "p.doc_id", "p.start", "p.length", F.crc32("p.ids").alias("ids_crc32"), "p.doc_tokens",
        "sequence_id", "p.offset")
