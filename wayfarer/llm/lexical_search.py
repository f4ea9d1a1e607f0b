"""Ranked lexical search without a document index: an Aho-Corasick scan.

The terms of all items form one automaton of guarded patterns (a blank, the term,
a blank).  Pass one maps the text's separators to blanks, runs the automaton over
it and stores, per document, its number of terms and the item terms it holds with
their counts; the automaton's outputs are term numbers, which map to the items that
ask for them.  One grouped count over the stored hits gives the document
frequencies.  Pass two turns the hits into integer scores of (document, item) block
by block, keeps the best ``k`` of each item inside its task and lets one window over
those (at most ``k`` rows an item and task) pick the result.  No text, posting or
score leaves its task otherwise, so neither a frequent term nor a large group of
copies makes a group.

The automaton is shipped to every task.  Items are split into groups of at most
``MAX_ITEM_BYTES`` of text, each with its own scan, so that it stays small; one
item above that bound is refused.

Defined results: a null text has no terms; such documents, and those without a
term, count neither in N nor in L.  Rows of one document id are documents of their
own and may both be ranked; a null id comes after all others among equal scores.
Equal item rows count once, and rows of one item id with different texts make one
item of all their terms; items without terms, or whose terms occur nowhere, have no
rows.  Empty tables give an empty result.  Only the four named columns are read, so
others may have any name.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.llm.tables import store
from wayfarer.llm.text_arrays import flat, pieces

TOP = 20
MAX_ITEM_BYTES = 4 << 20

#: Cells of a block of scores, and additions made at once.
CELLS = 1 << 20
ADDED = 1 << 22

BLANK = 0x20
#: Bytes to what the automaton reads: letters, digits and all of UTF-8's upper half
#: stand for themselves, A-Z in lower case, everything else is a blank.
FOLD = np.array([c if c >= 0x80 or chr(c).isalnum() else BLANK for c in range(256)], np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, with repeats, in order."""
    if not text:
        return []
    return FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes().split()


class ItemTerms:
    """Distinct terms of some items, numbered, and the items that ask for each."""

    def __init__(self, texts_of_items: list[list[str]]):
        numbers: dict[bytes, int] = {}
        asked: dict[tuple[int, int], int] = {}
        for item, texts in enumerate(texts_of_items):
            for term in chain.from_iterable(map(terms_of, texts)):
                key = (numbers.setdefault(term, len(numbers)), item)
                asked[key] = asked.get(key, 0) + 1
        self.terms = list(numbers)
        rows = sorted(asked)
        self.item = np.array([i for _, i in rows], np.int64)
        self.times = np.array([asked[r] for r in rows], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in rows], np.int64), np.arange(len(self.terms) + 1))

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for number, term in enumerate(self.terms):
            found.add_word(f" {term.decode('latin-1')} ", number)
        found.make_automaton()
        return found


def guarded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded bytes with a blank before, between and after the documents, end of each)."""
    sizes = np.diff(offsets)
    out = np.full(len(data) + len(sizes) + 1, BLANK, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = FOLD[data]
    return out, offsets[1:] + np.arange(1, len(sizes) + 1)


def count_terms(data: np.ndarray, offsets: np.ndarray, automaton, n_terms: int):
    """(terms a document, first hit of each document, term of each hit, its count)."""
    folded, ends = guarded(data, offsets)
    begins = np.flatnonzero((folded[1:] != BLANK) & (folded[:-1] == BLANK))
    sizes = np.diff(np.searchsorted(begins, ends), prepend=0)
    # The guard after a match is a byte of its document or the blank that ends it.
    hits = np.fromiter(chain.from_iterable(automaton.iter(folded.tobytes().decode("latin-1"))),
                       np.int64).reshape(-1, 2)
    docs = np.searchsorted(ends, hits[:, 0])
    key, counts = np.unique(docs * n_terms + hits[:, 1], return_counts=True)
    first = np.searchsorted(key, np.arange(len(sizes) + 1) * n_terms)
    return sizes, first, key % n_terms, counts


def scan(docs: DataFrame, doc_id: str, text: str, asked: ItemTerms) -> DataFrame:
    """Pass one: (doc_id, n, terms, counts) of every document with a term."""
    kind = docs.schema[doc_id].dataType

    def run(batches):
        automaton, n_terms = asked.automaton(), len(asked.terms)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for at, some, limits in pieces(data, offsets):
                sizes, first, terms, counts = count_terms(some, limits, automaton, n_terms)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sizes)), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(counts, pa.int64()))],
                    ["doc_id", "n", "terms", "counts"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("counts", T.ArrayType(T.LongType()))])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, schema).filter("n > 0")


def weights(n_docs: int, holding: dict[int, int], n_terms: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2df + 1))) of every term; 0 where no document holds it."""
    out = np.zeros(n_terms, np.int64)
    for term, df in holding.items():
        out[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return out


class Best:
    """The ``k`` best (score descending, id ascending) of each item seen so far."""

    def __init__(self, n_items: int, k: int, id_type: pa.DataType):
        self.k = k
        self.least = np.ones(n_items, np.int64)
        self.items, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = pa.array([], id_type)

    def add(self, block: np.ndarray, ids: pa.Array) -> None:
        """Scores of documents (rows) for all items (columns)."""
        if len(block) > self.k:
            kth = np.partition(block, len(block) - self.k, axis=0)[len(block) - self.k]
            floor = np.maximum(self.least, kth)
        else:
            floor = self.least
        row, item = np.nonzero(block >= floor)
        if not len(row):
            return
        items = np.concatenate([self.items, item])
        scores = np.concatenate([self.scores, block[row, item]])
        all_ids = pa.concat_arrays([self.ids, ids.take(pa.array(row))])
        place = np.empty(len(items), np.int64)
        place[pc.sort_indices(all_ids, null_placement="at_end").to_numpy()] = np.arange(len(items))
        order = np.lexsort((place, -scores, items))
        sorted_items = items[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_items, sorted_items)
        kept = order[rank < self.k]
        self.items, self.scores, self.ids = items[kept], scores[kept], all_ids.take(pa.array(kept))
        full = order[rank == self.k - 1]
        self.least[items[full]] = scores[full]


def block_scores(asked: ItemTerms, n_items: int, terms: np.ndarray, gains: np.ndarray,
                 rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum of the gains of each row's terms over the items that ask for them."""
    out = np.zeros(n_rows * n_items, np.int64)
    wide = asked.first[terms + 1] - asked.first[terms]
    end = np.cumsum(wide)
    lo = 0
    while lo < len(terms):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + ADDED, "right")))
        w = wide[lo:hi]
        entry = np.repeat(np.arange(lo, hi), w)
        link = np.arange(len(entry)) - np.repeat(np.cumsum(w) - w, w) + asked.first[terms[entry]]
        np.add.at(out, rows[entry] * n_items + asked.item[link], gains[entry] * asked.times[link])
        lo = hi
    return out.reshape(n_rows, n_items)


def best_of_tasks(hits: DataFrame, asked: ItemTerms, n_items: int, weight: np.ndarray, n_docs: int,
                  n_all: int, k: int) -> DataFrame:
    """Pass two: (item, doc_id, score), at most ``k`` rows an item and task."""
    block = max(1, CELLS // max(1, n_items))

    def run(batches):
        best = None
        for batch in batches:
            best = best or Best(n_items, k, batch.column(0).type)
            for lo in range(0, batch.num_rows, block):
                some = batch.slice(lo, block)
                n = some.column(1).to_numpy()
                of_terms, of_counts = some.column(2), some.column(3)
                sizes = pc.list_value_length(of_terms).to_numpy()
                terms, tf = of_terms.flatten().to_numpy(), of_counts.flatten().to_numpy()
                rows = np.repeat(np.arange(len(n)), sizes)
                m = 100 - 25 + 25 * n * n_docs // n_all
                gains = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[rows]))
                best.add(block_scores(asked, n_items, terms, gains, rows, len(n)), some.column(0))
        if best is not None and len(best.items):
            yield pa.RecordBatch.from_arrays([pa.array(best.items, pa.int32()), best.ids,
                                              pa.array(best.scores, pa.int64())], ["item", "doc_id", "score"])

    schema = T.StructType([T.StructField("item", T.IntegerType()),
                           T.StructField("doc_id", hits.schema["doc_id"].dataType),
                           T.StructField("score", T.LongType())])
    return hits.select("doc_id", "n", "terms", "counts").mapInArrow(run, schema)


def _search(docs: DataFrame, items: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """The ranking for one group of items (columns item_id, texts), few enough for one automaton."""
    spark = docs.sparkSession
    rows = items.collect()  # at most MAX_ITEM_BYTES of text
    asked = ItemTerms([r["texts"] for r in rows])
    if not asked.terms:
        return spark.createDataFrame([], T.StructType([
            items.schema["item_id"], T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())]))
    hits, _ = store(scan(docs, doc_id, text, asked), "term-hits")
    total = hits.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_all")).first()
    held = hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # a row a term
    weight = weights(total["n_docs"], {r["t"]: r["count"] for r in held}, len(asked.terms))
    partial = best_of_tasks(hits, asked, len(rows), weight, total["n_docs"], total["n_all"] or 1, k)
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = partial.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)],
                                  T.StructType([T.StructField("item", T.IntegerType()), items.schema["item_id"]]))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, *, k: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text",
           max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score."""
    whole = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    sized = whole.groupBy("item_id").agg(F.collect_list("text").alias("texts"), F.coalesce(
        F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    size = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("all"),
                     F.coalesce(F.max("bytes"), F.lit(0)).alias("one")).first()
    if size["one"] > max_item_bytes:
        raise ValueError(f"an item has {size['one']} bytes of text; the automaton takes {max_item_bytes} at once")
    if size["all"] <= max_item_bytes:
        return _search(docs, sized.select("item_id", "texts"), doc_id, text, k)
    # Groups of items by running size, each below the bound; two numbers an item pass the driver.
    listed, _ = store(sized.withColumn("no", F.monotonically_increasing_id()), "items")
    cuts, room = [0], max_item_bytes
    for r in listed.select("no", "bytes").orderBy("no").toLocalIterator():
        if r["bytes"] > room:
            cuts.append(r["no"])
            room = max_item_bytes
        room -= r["bytes"]
    parts = [_search(docs, listed.filter((F.col("no") >= lo) & (F.col("no") < hi)).select("item_id", "texts"),
                     doc_id, text, k) for lo, hi in zip(cuts, [*cuts[1:], 1 << 62])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def query(spark, sf_dir) -> DataFrame:
    """op12: the 20 best documents for each benchmark item."""
    from wayfarer.session import read_table

    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT r, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM sizes),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest({_TERMS}) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE text IS NOT NULL)
  GROUP BY ALL),
held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighted AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, totals GROUP BY term, n_docs),
gains AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_all)))) AS gain
  FROM held JOIN weighted USING (term) JOIN sizes USING (r), totals),
scores AS (
  SELECT item_id, r, sum(gain * times)::BIGINT AS score
  FROM gains JOIN asked USING (term) GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank,
    doc_id, score
  FROM scores JOIN sizes USING (r) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}"""
