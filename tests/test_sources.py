import datetime as dt
import tempfile

from pyspark.sql import functions as F

from wayfarer.sources import events_adapter as A
from wayfarer.sources import ga_export as GX

SF = "/root/testdata/sf0.001"


def write_shards(spark, root):
    raw = A.nested_export_from_events(spark.read.parquet(f"{SF}/events.parquet"))
    days = [r[0] for r in raw.select("_table_suffix").distinct().collect()]
    for d in days:
        raw.filter(F.col("_table_suffix") == d).drop("_table_suffix") \
            .write.mode("overwrite").parquet(f"{root}/events_{d}")
    return raw, days


def test_shard_scan_prunes_and_flattens(spark):
    root = tempfile.mkdtemp(prefix="wayfarer-shards-")
    raw, days = write_shards(spark, root)
    as_of = dt.date(2024, 1, 30)
    paths = GX.list_shards(spark, root, as_of, 7)
    assert paths and all("intraday" not in p for p in paths)
    assert {p.rsplit("events_", 1)[1] for p in paths} == {
        d for d in days if "intraday" not in d and "20240123" <= d <= "20240130"}
    scanned = GX.scan_shards(spark, root, as_of, 7)
    expect = raw.filter(~F.col("_table_suffix").contains("intraday")
                        & F.col("_table_suffix").between("20240123", "20240130")).count()
    assert scanned.count() == expect
    assert scanned.filter(F.col("is_intraday")).count() == 0
    with_intraday = GX.scan_shards(spark, root, as_of, 7, include_intraday=True)
    assert with_intraday.filter(F.col("is_intraday")).count() > 0
    flat = GX.load_export(spark, root, as_of, 7)
    keys = flat.groupBy("user_pseudo_id", "event_name", "event_timestamp").count()
    assert keys.filter(F.col("count") > 1).count() == 0
    assert flat.filter(F.col("user_pseudo_id").isNull()).count() == 0
    # Same rows as deduplicating the raw rows first (copies are identical here).
    slow = GX.flatten_events(GX.dedup_raw(
        scanned.drop("_table_suffix", "table_date", "is_intraday")))
    assert flat.exceptAll(slow).count() == 0 and slow.exceptAll(flat).count() == 0
    names = ["session_start", "page_view", "purchase"]
    some = GX.load_export(spark, root, as_of, 7, event_names=names)
    assert some.exceptAll(flat.filter(F.col("event_name").isin(names))).count() == 0
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_name" in plan or "In(event_name" in plan


def test_flatten_defaults(spark):
    row = {"event_date": "20240105", "event_name": "page_view", "event_timestamp": 1704448800000000,
           "user_pseudo_id": "7.1", "geo": {"region": "", "city": None}, "device": {"category": "mobile"},
           "traffic_source": {"name": None, "medium": "cpc", "source": "google"},
           "collected_traffic_source": {"manual_campaign_name": None, "manual_medium": None,
                                        "manual_source": None},
           "event_params": [{"key": "page_location", "value": {"string_value": "https://x/a",
                                                                "int_value": None}},
                            {"key": "session_engaged", "value": {"string_value": "1",
                                                                  "int_value": None}}]}
    df = spark.createDataFrame([row], GX.RAW_SCHEMA)
    r = GX.flatten_events(df).first()
    assert r.geo_region == "(not set)" and r.geo_city == "(not set)"
    assert r.ga_session_id is None and r.session_engaged == 1
    assert r.source_medium == "google / cpc" and r.campaign == "(not set)"
    assert r.event_timestamp == dt.datetime(2024, 1, 5, 10, 0)
    empty = spark.createDataFrame([{**row, "event_params": []}], GX.RAW_SCHEMA)
    assert GX.flatten_events(empty).count() == 0


def test_snapshot_round_trip(spark):
    root = tempfile.mkdtemp(prefix="wayfarer-snap-")
    df = spark.range(5)
    day = dt.date(2024, 1, 30)
    assert GX.read_snapshot(spark, root, "p.d.events_*", day, 30) is None
    GX.write_snapshot(df, root, "p.d.events_*", day, 30)
    assert GX.read_snapshot(spark, root, "p.d.events_*", day, 30).count() == 5
    assert GX.read_snapshot(spark, root, "p.d.events_*", day, 7) is None
