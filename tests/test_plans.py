"""Scale properties read from physical plans (a guard against regressions)."""
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")


def formatted(spark, df):
    jvm = spark.sparkContext._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", ["journeys", "journeys_with_mix", "divergence_top",
                                  "divergence_count", "sequence_support", "sequence_features",
                                  "export_events", "topic_keywords", "balanced_journeys"])
def test_no_pairwise_joins(spark, name):
    plan = formatted(spark, E.queries()[name](spark, SF))
    assert not any(p in plan for p in PAIRWISE), name


def test_counts_push_filters_and_prune_columns(spark):
    plan = formatted(spark, E.queries()["user_counts"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_name), EqualTo(event_name,page_view)]" in plan
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "page_title" not in schema and "campaign" not in schema


def test_gap_window_is_not_per_user_alone(spark):
    from wayfarer.operators import clean
    from wayfarer.plans import catalog
    c = clean.clean_events(catalog.flat_events(spark, SF), "purchase", ["acme"])
    plan = formatted(spark, c)
    # The per-event lag is partitioned by (user, bucket); only the per-bucket
    # summary is windowed by user alone.
    assert "lag(event_timestamp_sec" in plan
    for line in plan.splitlines():
        if "lag(event_timestamp_sec" in line and "windowspecdefinition" in line:
            assert "_bucket" in line.split("windowspecdefinition(")[1].split(",")[1]


def test_export_scan_pushes_event_names(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from wayfarer.sources import events_adapter as A
    from wayfarer.sources import ga_export as GX
    raw = A.nested_export_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    raw.filter(F.col("_table_suffix") == "20240130").drop("_table_suffix") \
        .write.parquet(str(tmp_path / "events_20240130"))
    df = GX.load_export(spark, str(tmp_path), dt.date(2024, 1, 30), 0,
                        event_names=["page_view", "session_start"])
    plan = formatted(spark, df)
    assert "PushedFilters: [In(event_name, [page_view,session_start])]" in plan \
        or "In(event_name, [page_view,session_start])" in plan
