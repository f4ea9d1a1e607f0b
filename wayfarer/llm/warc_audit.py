"""WARC: Merkle fixity audit of two replicas of an archive.

Records are hashed (SHA-256) and filed by their byte offset inside a segment.
The records of an offset range of ``leaf_bytes`` make a leaf; ``fan`` consecutive
ranges make their parent's range, up to one root a segment.  Every node hashes
its children in offset order.  The audit joins the roots of both replicas and
then goes down one level at a time, reading only children of nodes that differ,
until it compares single records.  Nodes have at most ``fan`` children and a
leaf only the records that start in ``leaf_bytes``, so no group grows with the
data.

Defined results: a record found in both replicas with different digests is
``corrupt``; one only in the first is ``missing``, one only in the second is
``extra``; several records at one offset are hashed together.  Null columns
count as empty text.  The record window assumes that ids are spread: different
records of one id all lie in one segment.  Equal replicas, and empty ones, give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wayfarer.llm.tables import drop, store

LEAF_BYTES = 1 << 15
FAN = 8
#: Page ids of one segment: that many consecutive ids make an archive file.
SEGMENT_IDS = 256


def warc_bytes(record_id, url, payload):
    """Expression: the WARC/1.1 response record as text; its UTF-8 form is what is stored."""
    payload = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def record_digests(records: DataFrame, record_id: str, *contents: tuple[str, object]) -> DataFrame:
    """(record_id, length, digest columns): the hashing pass, where the bytes are read.

    ``contents`` are (column name, record expression); the first gives the length.
    Only ids, lengths and digests leave this pass.
    """
    return records.select(
        F.col(record_id).alias("record_id"), F.octet_length(contents[0][1]).cast("long").alias("length"),
        *[F.sha2(record, 256).alias(name) for name, record in contents])


def with_offsets(digests: DataFrame, digest: str, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Adds segment and byte offset: ``segment_ids`` consecutive ids make an archive file.

    Records follow each other in order of (id, digest).  Equal records are one,
    so copies cannot fill a segment; records without an id are spread over
    negative segments by their digest.
    """
    spread = -1 - F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")
    segment = F.coalesce(F.floor(F.col("record_id") / segment_ids), spread).cast("long")
    order = Window.partitionBy("segment").orderBy("record_id", digest)
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return digests.distinct().withColumn("segment", segment).withColumn(
        "offset", F.coalesce(before, F.lit(0)).cast("long"))


def by_offset(index: DataFrame, digest: str = "digest") -> DataFrame:
    """(segment, offset, digest, length, record_id) with one row per offset of a replica."""
    return index.groupBy("segment", "offset").agg(
        F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(digest))), 256).alias("digest"),
        F.max("length").alias("length"), F.min("record_id").alias("record_id"))


def _fold(children: DataFrame, size: int) -> DataFrame:
    """Nodes over ranges of ``size`` bytes: (segment, range, digest)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "digest")))
    line = F.transform(parts, lambda c: F.concat_ws(":", c["offset"].cast("string"), c["digest"]))
    return children.groupBy("segment", F.floor(F.col("offset") / size).cast("long").alias("range")).agg(
        F.sha2(F.concat_ws("|", line), 256).alias("digest"))


def tree(digests: DataFrame, top: int, leaf_bytes: int = LEAF_BYTES, fan: int = FAN) -> list[DataFrame]:
    """Node tables from the leaves up to the roots, each (segment, offset, digest)."""
    levels, below = [], digests
    for level in range(top + 1):
        size = leaf_bytes * fan ** level
        below = _fold(below, size).select("segment", (F.col("range") * size).alias("offset"), "digest")
        levels.append(below)
    return levels


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.withColumnRenamed("digest", "digest_a").join(
        b.withColumnRenamed("digest", "digest_b"), ["segment", "offset"], "full")
    return both.filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))


def audit(first: DataFrame, second: DataFrame, leaf_bytes: int = LEAF_BYTES,
          fan: int = FAN) -> DataFrame:
    """Records that differ: (segment, offset, record_id, length, status).

    ``first`` and ``second`` are the replicas' record digests with segment,
    offset, length and record_id.
    """
    spark = first.sparkSession
    kept, paths = [], []
    for name, replica in (("first", first), ("second", second)):
        table, path = store(by_offset(replica), f"fixity-{name}")
        kept.append(table)
        paths.append(path)
    last = [t.agg(F.max("offset")).head()[0] for t in kept]
    last = max([x for x in last if x is not None], default=0)
    top = 0
    while leaf_bytes * fan ** top <= last:
        top += 1
    stored = []
    for side, table in zip("ab", kept):
        parts = [n.withColumn("level", F.lit(i)) for i, n in enumerate(tree(table, top, leaf_bytes, fan))]
        nodes, path = store(reduce(DataFrame.unionByName, parts), f"merkle-{side}")
        stored.append(nodes)
        paths.append(path)
    at = lambda nodes, level: nodes.filter(F.col("level") == level).drop("level")
    def opened(a: DataFrame, b: DataFrame) -> DataFrame:
        """The nodes to go down from, stored: both replicas' next level reads them."""
        nodes, path = store(_differ(a, b).select("segment", "offset"), "open-nodes")
        paths.append(path)
        return nodes

    open_nodes = opened(at(stored[0], top), at(stored[1], top))
    for level in range(top - 1, -1, -1):
        size = leaf_bytes * fan ** (level + 1)
        open_nodes = opened(*[_below(at(n, level), open_nodes, size) for n in stored])
    columns = ["length", "record_id", "digest"]
    a, b = [_below(t, open_nodes, leaf_bytes).select(
        "segment", "offset", *[F.col(c).alias(f"{c}_{s}") for c in columns])
        for s, t in zip("ab", kept)]
    pairs = a.join(b, ["segment", "offset"], "full").filter(
        ~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    found = pairs.select(
        "segment", "offset",
        F.when(F.col("digest_a").isNull(), F.col("record_id_b")).otherwise(F.col("record_id_a")).alias("record_id"),
        F.coalesce("length_a", "length_b").alias("length"),
        F.when(F.col("digest_a").isNull(), "extra").when(F.col("digest_b").isNull(), "missing")
        .otherwise("corrupt").alias("status"))
    result, _ = store(found, "fixity")
    drop(spark, *paths)
    return result


def _below(nodes: DataFrame, parents: DataFrame, size: int) -> DataFrame:
    """Nodes whose parent range of ``size`` bytes is among ``parents``."""
    up = parents.select("segment", F.col("offset").alias("_up"))
    return nodes.withColumn("_up", (F.floor(F.col("offset") / size) * size).cast("long")).join(
        up, ["segment", "_up"], "left_semi").drop("_up")


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Two replicas' record digests over ``pages``, with damage set by the MD5 of the page id.

    First two hex digits 00 to 03: the second replica's last payload byte is
    altered; 04 to 07: it lacks the record; 08 to 0b: the first lacks it.
    """
    mark = lambda c: F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 2)
    whole = warc_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    altered = F.when(mark(F.col("page_id")).between("00", "03"),
                     F.concat(F.substr(whole, F.lit(1), F.char_length(whole) - 1), F.lit("\t"))).otherwise(whole)
    hashed = record_digests(pages, "page_id", ("first", whole), ("second", altered))
    index, path = store(with_offsets(hashed, "first").withColumn("mark", mark(F.col("record_id"))), "archive")
    columns = ["segment", "offset", "length", "record_id"]
    return (index.filter(~F.col("mark").between("08", "0b")).select(*columns, F.col("first").alias("digest")),
            index.filter(~F.col("mark").between("04", "07")).select(*columns, F.col("second").alias("digest")),
            path)


def query(spark, sf_dir) -> DataFrame:
    """op2: audit of two replicas of the pages' archive."""
    from wayfarer.session import read_table

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    first, second, path = replicas(pages)
    result = audit(first, second)
    drop(spark, path)
    return result


ORACLE_SQL = f"""
WITH d AS (
  SELECT DISTINCT page_id AS record_id,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
r AS (
  SELECT coalesce(CAST(floor(record_id / {SEGMENT_IDS}) AS BIGINT),
      -1 - CAST('0x' || substr(sha256(record), 1, 4) AS BIGINT)) AS segment, record_id,
    CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest FROM d),
o AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY segment ORDER BY record_id, digest
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    substr(md5(coalesce(CAST(record_id AS VARCHAR), '')), 1, 2) AS mark FROM r)
SELECT segment, "offset", record_id, length,
  CASE WHEN mark <= '03' THEN 'corrupt' WHEN mark <= '07' THEN 'missing' ELSE 'extra' END AS status
FROM o WHERE mark <= '0b'"""
