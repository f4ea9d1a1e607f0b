"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the target weights times all
documents, over its own documents.  Each document draws a uniform number from a
hash of its id and inverts its source's Poisson distribution with it, is
exploded by that count and dealt out by a hash of (id, copy), sorted inside each
partition: a global shuffle that every run repeats exactly.  Where the id is null
or several rows have it, the row's own hash and, for equal rows, a number go with it,
so that such rows draw and are dealt out one by one.  All of it is DataFrame functions; the only
aggregations are counts per source and id.

Rates above ``SPLIT`` are drawn as sums of equal parts, since a Poisson
distribution is the sum of independent ones and exp(-rate) would underflow.

Defined results: sources without a weight, and null ones, have
``default_weight``; weights are relative among the sources present; weight 0
removes a source, and if no source has weight nothing is left.  Equal rows are rows of
their own; text plays no other part, so null and empty texts are mixed like any
other.  ``ORACLE_SQL`` draws by id alone and so
holds for tables of distinct ids.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.tables import fresh, store

#: Production weights: the large crawl is held down, two curated sources are raised.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 3.0}
DEFAULT_WEIGHT = 1.0
SEED = 20
SPLIT = 256.0


def rates(docs: DataFrame, source: str, weights: dict[str, float], default: float) -> DataFrame:
    """(source, draws, cdf): Poisson distribution of each source's part of the rate."""
    counts = docs.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("n"))
    weight = F.lit(float(default))
    for name, value in weights.items():
        weight = F.when(F.col("_s") == name, F.lit(float(value))).otherwise(weight)
    weighed = counts.withColumn("w", weight)
    all_n, all_w = [weighed.agg(F.sum(c)).scalar() for c in "nw"]
    rate = weighed.select("_s", F.when(all_w > 0, all_n * (F.col("w") / all_w) / F.col("n"))
                          .otherwise(F.lit(0.0)).alias("rate"))
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT)).cast("int")
    part = rate.withColumn("draws", draws).withColumn("part", F.col("rate") / F.col("draws"))
    # As far as the upper tail stays above the resolution of the uniform numbers.
    last = F.ceil(F.col("part") + 12 * F.sqrt(F.col("part")) + 30).cast("int")
    zero = F.exp(-F.col("part"))
    return part.select("_s", "rate", "draws", F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * F.col("part") / k).alias("p"),
            (acc["c"] + acc["p"] * F.col("part") / k).alias("c"),
            F.concat(acc["cdf"], F.array(acc["c"] + acc["p"] * F.col("part") / k)).alias("cdf")),
        lambda acc: acc["cdf"]).alias("cdf"))


def uniform(*parts):
    """Expression: a number in [0, 1) from the first 13 hex digits of an MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16 ** 13)


def with_identity(docs: DataFrame, doc_id: str, out: str) -> DataFrame:
    """``docs`` and a string ``out``, different for every row: the id, and more where it is null or repeated.

    Rows of a null or repeated id get the row's hash too, and equal ones a number:
    they are counted by hash and input partition and dealt out again, so a number is
    the same whenever a task runs again, and many equal rows stay spread as they were.
    """
    found, times = fresh([*docs.columns, out], "_id", "_times")
    # Stored, so that its size is known: few repeated ids are broadcast, and no text moves for them.
    repeated, _ = store(docs.select(F.col(doc_id).alias(found)).groupBy(found).agg(F.count("*").alias(times)).filter(
        (F.col(times) > 1) | F.col(found).isNull()), "repeated-ids")
    alone = docs.withColumn(out, F.col(doc_id).cast("string"))
    if repeated.isEmpty():
        return alone
    same = F.col(doc_id).eqNullSafe(F.col(found))
    alone = alone.join(repeated, same, "left_anti")
    row, part, m, content = fresh([*docs.columns, out], "_row", "_part", "_m", "_content")
    # Maps and variants have no hash of their own, their text has.
    plain = lambda kind: "map<" not in kind and "variant" not in kind
    hashed = [x for c, kind in docs.dtypes for x in (
        F.col(c).isNull(), F.col(c) if plain(kind) else F.to_json(F.struct(c)))]
    counted = docs.join(repeated, same, "left_semi").groupBy(
        F.concat_ws("#", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.xxhash64(*hashed)).alias(row),
        F.spark_partition_id().alias(part)).agg(
        F.count("*").alias(m), F.first(F.struct(*docs.columns)).alias(content))
    numbered = counted.withColumn(m, F.explode(F.sequence(F.lit(1).cast("long"), F.col(m)))).select(
        f"{content}.*", F.concat_ws("#", row, F.col(part).cast("string"), F.col(m).cast("string")).alias(out))
    return alone.unionByName(numbered)


def mix_sources(docs: DataFrame, *, weights: dict[str, float] | None = None,
                default_weight: float = DEFAULT_WEIGHT, seed: int = SEED, doc_id: str = "doc_id",
                source: str = "source") -> DataFrame:
    """``docs`` with each row as often as drawn, in shuffled order.

    Three columns come last: ``n_copies``, ``copy`` (1 to n_copies) and
    ``shuffle_key``; they get a leading underscore where ``docs`` has the name.
    """
    weights = WEIGHTS if weights is None else weights
    n_copies, copy, key = fresh(docs, "n_copies", "copy", "shuffle_key")
    s, rate, draws, cdf, own = fresh([*docs.columns, n_copies, copy, key],
                                     "_s_", "_rate", "_draws", "_cdf", "_own")
    table = rates(docs.select(F.col(source).alias("v")), "v", weights, default_weight).toDF(
        s, rate, draws, cdf)
    joined = with_identity(docs, doc_id, own).join(table, F.col(source).eqNullSafe(F.col(s)))
    ident = F.col(own)
    count = F.aggregate(
        F.sequence(F.lit(1), F.col(draws)), F.lit(0),
        lambda acc, j: acc + F.size(F.filter(
            F.col(cdf), lambda c: c <= uniform(F.lit(f"count{seed}"), ident, j))))
    copies = (joined.withColumn(n_copies, count.cast("int")).drop(s, rate, draws, cdf)
              .filter(F.col(n_copies) > 0)
              .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n_copies)))))
    text = F.concat_ws("|", F.lit(f"order{seed}"), ident, F.col(copy).cast("string"))
    return copies.withColumn(key, F.md5(text)).drop(own).repartition(F.col(key)).sortWithinPartitions(key)


def query(spark, sf_dir) -> DataFrame:
    """op9: documents mixed to the production weights."""
    from wayfarer.session import read_table

    return mix_sources(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    cases = "".join(f" WHEN source = '{s}' THEN {w}::DOUBLE" for s, w in WEIGHTS.items())
    return f"""
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n, CASE{cases} ELSE {DEFAULT_WEIGHT}::DOUBLE END AS w
  FROM documents GROUP BY source),
l AS (SELECT source, (SELECT sum(n) FROM c) * (w / (SELECT sum(w) FROM c)) / n AS rate FROM c),
p AS (SELECT source, greatest(1, ceil(rate / {SPLIT})) AS draws,
        rate / greatest(1, ceil(rate / {SPLIT})) AS part FROM l),
t AS (
  SELECT source, part, 0 AS k, exp(-part) AS pk, exp(-part) AS cdf FROM p
  UNION ALL
  SELECT source, part, k + 1, pk * part / (k + 1), cdf + pk * part / (k + 1) FROM t
  WHERE k < ceil(part + 12 * sqrt(part) + 30)),
u AS (
  SELECT d.doc_id, d.source, p.draws, j.j,
    CAST('0x' || substr(md5('count{SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), '-') || '|'
      || j.j), 1, 13) AS BIGINT)::DOUBLE / {float(16 ** 13)!r}::DOUBLE AS u
  FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN p ON d.source IS NOT DISTINCT FROM p.source,
    LATERAL (SELECT unnest(range(1, CAST(p.draws AS BIGINT) + 1)) AS j) j),
n AS (
  SELECT u.doc_id, u.source, count(t.k) AS n_copies
  FROM u LEFT JOIN t ON u.source IS NOT DISTINCT FROM t.source AND t.cdf <= u.u
  GROUP BY u.doc_id, u.source)
SELECT d.*, CAST(n.n_copies AS INTEGER) AS n_copies, CAST(i.i AS INTEGER) AS copy,
  md5('order{SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), '-') || '|' || i.i) AS shuffle_key
FROM documents d
JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.source IS NOT DISTINCT FROM n.source,
  LATERAL (SELECT unnest(range(1, n.n_copies + 1)) AS i) i"""


ORACLE_SQL = _sql()
