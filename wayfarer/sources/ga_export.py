"""Nested, date-sharded analytics export -> flat clickstream rows.

The export is one folder per day, ``events_YYYYMMDD`` (and
``events_intraday_YYYYMMDD`` while a day is open), each row an event with
nested geo / device / traffic structs and an ``event_params`` array of
key / typed-value structs.  Flattening keeps one event per (user, event name,
timestamp), reads five parameters, and fills traffic defaults.

Shards are pruned on the folder name before any file is opened; a table that
is instead partitioned by a ``table_date`` column is pruned by Catalyst from
the same predicate.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.functions.timeutil import from_epoch_micros

VALUE = T.StructType([T.StructField("string_value", T.StringType()),
                      T.StructField("int_value", T.LongType())])
RAW_SCHEMA = T.StructType([
    T.StructField("event_date", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("event_timestamp", T.LongType()),
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("geo", T.StructType([T.StructField("region", T.StringType()),
                                       T.StructField("city", T.StringType())])),
    T.StructField("device", T.StructType([T.StructField("category", T.StringType())])),
    T.StructField("traffic_source", T.StructType([T.StructField("name", T.StringType()),
                                                  T.StructField("medium", T.StringType()),
                                                  T.StructField("source", T.StringType())])),
    T.StructField("collected_traffic_source", T.StructType([
        T.StructField("manual_campaign_name", T.StringType()),
        T.StructField("manual_medium", T.StringType()),
        T.StructField("manual_source", T.StringType())])),
    T.StructField("event_params", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()), T.StructField("value", VALUE)]))),
])

SHARD_RE = re.compile(r"^events_(intraday_)?(\d{8})$")
DEDUP_KEY = ["user_pseudo_id", "event_name", "event_timestamp"]


def shard_suffix(path_col: F.Column) -> F.Column:
    """``YYYYMMDD`` or ``intraday_YYYYMMDD`` from a file path under a shard folder."""
    return F.regexp_extract(path_col, r"events_((?:intraday_)?[0-9]{8})/", 1)


def with_shard_columns(df: DataFrame, suffix: F.Column) -> DataFrame:
    """``table_date`` from the suffix digits and ``is_intraday``."""
    return (df.withColumn("_table_suffix", suffix)
            .withColumn("table_date", F.try_to_date(
                F.regexp_extract("_table_suffix", "[0-9]+", 0), "yyyyMMdd"))
            .withColumn("is_intraday", F.col("_table_suffix").contains("intraday")))


def date_window(as_of_date: dt.date, historical_days: int) -> tuple[dt.date, dt.date]:
    """Both ends inclusive: ``historical_days + 1`` days ending at ``as_of_date``."""
    return as_of_date - dt.timedelta(days=historical_days), as_of_date


def prune_shards(df: DataFrame, as_of_date: dt.date, historical_days: int,
                 include_intraday: bool = False) -> DataFrame:
    """Keep shards inside the window.

    With ``include_intraday=False`` an intraday shard never matches, as when
    the raw suffix itself is parsed as a date; with True its digits are used.
    """
    lo, hi = date_window(as_of_date, historical_days)
    parsed = F.try_to_date(F.col("_table_suffix"), "yyyyMMdd")
    d = F.col("table_date") if include_intraday else parsed
    return df.filter(d.between(F.lit(lo), F.lit(hi)))


def list_shards(spark: SparkSession, base: str, as_of_date: dt.date, historical_days: int,
                include_intraday: bool = False) -> list[str]:
    """Shard folders inside the window (a metadata listing, no data read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(conf)
    lo, hi = date_window(as_of_date, historical_days)
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        m = SHARD_RE.match(name)
        if not st.isDirectory() or not m:
            continue
        if m.group(1) and not include_intraday:
            continue
        day = dt.datetime.strptime(m.group(2), "%Y%m%d").date()
        if lo <= day <= hi:
            out.append(st.getPath().toString())
    return sorted(out)


def scan_shards(spark: SparkSession, base: str, as_of_date: dt.date, historical_days: int,
                include_intraday: bool = False) -> DataFrame:
    """Raw nested rows of the shards in the window, with shard columns."""
    paths = list_shards(spark, base, as_of_date, historical_days, include_intraday)
    if not paths:
        return with_shard_columns(spark.createDataFrame([], RAW_SCHEMA), F.lit(""))
    raw = spark.read.schema(RAW_SCHEMA).parquet(*paths)
    return with_shard_columns(raw, shard_suffix(F.col("_metadata.file_path")))


def dedup_raw(raw: DataFrame) -> DataFrame:
    """One raw row per (user, event name, timestamp).

    The survivor among copies is the one with the smallest content hash (the
    source query leaves it arbitrary).  ``min_by`` combines map-side, so many
    copies of one event never meet in one task before being reduced.
    """
    cols = [c for c in raw.columns if c not in DEDUP_KEY]
    h = F.xxhash64(*[F.col(c) for c in cols])
    best = raw.groupBy(*DEDUP_KEY).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), h).alias("_row"))
    return best.select(*DEDUP_KEY, "_row.*")


def _param(key: str, field: str) -> F.Column:
    vals = F.transform(F.filter("event_params", lambda p: p["key"] == key),
                       lambda p: p["value"][field])
    return F.array_max(vals)


def _not_set(c: str) -> F.Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(not set)"))


def flatten_events(raw: DataFrame, *keep: str) -> DataFrame:
    """Flat clickstream rows (the schema the cleaning step reads), and last the columns ``keep``.

    After deduplication each key has one raw row, so the parameter pivot is
    a per-row higher-order expression; rows without parameters vanish, like
    an inner unnest would drop them.
    """
    src = F.coalesce(F.col("collected_traffic_source.manual_source"),
                     F.col("traffic_source.source"))
    med = F.coalesce(F.col("collected_traffic_source.manual_medium"),
                     F.col("traffic_source.medium"))
    camp = F.coalesce(F.col("collected_traffic_source.manual_campaign_name"),
                      F.col("traffic_source.name"))
    df = raw.filter(F.col("user_pseudo_id").isNotNull() & (F.size("event_params") > 0))
    return df.select(
        F.try_to_date(F.col("event_date"), "yyyyMMdd").alias("event_date"),
        "event_name",
        from_epoch_micros("event_timestamp").alias("event_timestamp"),
        "user_pseudo_id",
        _not_set("geo.region").alias("geo_region"),
        _not_set("geo.city").alias("geo_city"),
        _not_set("device.category").alias("device_category"),
        F.concat(F.col("user_pseudo_id"), F.lit("."),
                 _param("ga_session_id", "int_value").cast("string")).alias("ga_session_id"),
        _param("ga_session_number", "int_value").alias("ga_session_number"),
        F.coalesce(_param("session_engaged", "string_value").cast("long"), F.lit(0))
        .alias("session_engaged"),
        _param("page_location", "string_value").alias("page_location"),
        _param("page_title", "string_value").alias("page_title"),
        F.coalesce(camp, F.lit("(not set)")).alias("campaign"),
        F.coalesce(med, F.lit("(not set)")).alias("medium"),
        F.coalesce(src, F.lit("(not set)")).alias("source"),
        F.concat(F.coalesce(src, F.lit("(direct)")), F.lit(" / "),
                 F.coalesce(med, F.lit("(not set)"))).alias("source_medium"),
        *keep,
    )


FLAT_KEY = ["user_pseudo_id", "event_name", "event_timestamp"]


def dedup_flat(flat: DataFrame, key: list[str] = FLAT_KEY) -> DataFrame:
    """One flat row per (user, event name, timestamp), smallest content hash kept."""
    cols = [c for c in flat.columns if c not in key]
    h = F.xxhash64(*[F.col(c) for c in cols])
    best = flat.groupBy(*key).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), h).alias("_row"))
    return best.select(*key, "_row.*").select(*flat.columns)


def load_export(spark: SparkSession, base: str, as_of_date: dt.date, historical_days: int,
                include_intraday: bool = False,
                event_names: list[str] | None = None) -> DataFrame:
    """Shard scan -> flat rows, one per (user, event name, timestamp).

    ``event_names`` (e.g. session_start, page_view and the goal) is pushed to
    the parquet scan; as the dedup key holds the event name, filtering first
    keeps the same rows.  Rows are flattened before the dedup so the shuffle
    carries only the flat columns, not every nested parameter; the copy kept
    among duplicates is arbitrary in the source query as well.
    """
    raw = scan_shards(spark, base, as_of_date, historical_days, include_intraday)
    if event_names:
        raw = raw.filter(F.col("event_name").isin(list(event_names)))
    flat = flatten_events(raw.drop("_table_suffix", "table_date", "is_intraday"))
    return dedup_flat(flat)


def snapshot_path(root: str, table_name: str, as_of_date: dt.date, historical_days: int,
                  include_intraday: bool = False, event_names: list[str] | None = None) -> str:
    """Folder of the snapshot of one request; every parameter is part of its name."""
    slug = re.sub(r"\W", "_", table_name)
    path = f"{root.rstrip('/')}/{slug}__{as_of_date:%Y%m%d}__{historical_days}d"
    if include_intraday:
        path += "__intraday"
    if event_names:
        import hashlib

        names = "\x1f".join(sorted(set(event_names)))
        path += f"__{hashlib.sha256(names.encode()).hexdigest()[:16]}"
    return path


def write_snapshot(df: DataFrame, root: str, table_name: str, as_of_date: dt.date,
                   historical_days: int, include_intraday: bool = False,
                   event_names: list[str] | None = None) -> DataFrame:
    """Keep the flat rows as parquet, keyed on all parameters of the request."""
    path = snapshot_path(root, table_name, as_of_date, historical_days, include_intraday, event_names)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_snapshot(spark: SparkSession, root: str, table_name: str, as_of_date: dt.date,
                  historical_days: int, include_intraday: bool = False,
                  event_names: list[str] | None = None,
                  schema: T.StructType | None = None) -> DataFrame | None:
    """The snapshot of this request, or None if there is none that was written to its end."""
    path = snapshot_path(root, table_name, as_of_date, historical_days, include_intraday, event_names)
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def query_export(spark: SparkSession, base: str, as_of_date: dt.date, historical_days: int,
                 include_intraday: bool = False, event_names: list[str] | None = None,
                 snapshot_root: str | None = None) -> DataFrame:
    """``load_export``; with ``snapshot_root`` through rows kept by shard (``shard_store``)."""
    args = (as_of_date, historical_days, include_intraday, event_names)
    if snapshot_root is None:
        return load_export(spark, base, *args)
    from wayfarer.sources.shard_store import load_window

    return load_window(spark, base, snapshot_root, *args)
