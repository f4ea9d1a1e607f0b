import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from tests.test_sources import write_shards
from wayfarer.sources import ga_export as GX
from wayfarer.sources.shard_store import ShardStore, load_window


@pytest.fixture(scope="module")
def export(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("export"))
    _, days = write_shards(spark, root)
    return root, days


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def reads(monkeypatch):
    """Shards that each refresh reads."""
    seen, refresh = [], ShardStore.refresh
    monkeypatch.setattr(ShardStore, "refresh", lambda self, shards: seen.append(refresh(self, shards)) or seen[-1])
    return seen


def test_a_window_that_moves_reads_its_new_day_only(spark, export, tmp_path, monkeypatch):
    base, _ = export
    seen, root = reads(monkeypatch), str(tmp_path)
    for day, days in ((28, 4), (29, 4), (29, 4), (29, 2), (30, 6)):
        as_of = dt.date(2024, 1, day)
        got = load_window(spark, base, root, as_of, days)
        assert same(got, GX.load_export(spark, base, as_of, days))
    assert [sorted(s) for s in seen] == [[f"202401{d}" for d in range(24, 29)], ["20240129"], [], [], ["20240130"]]


def test_intraday_and_changed_shards_are_read_again(spark, export, tmp_path, monkeypatch):
    base, days = export
    mine = str(tmp_path / "export")
    shutil.copytree(base, mine)
    seen, root = reads(monkeypatch), str(tmp_path / "kept")
    as_of = dt.date(2024, 1, 30)
    intraday = sorted(d for d in days if d.startswith("intraday_") and "20240125" <= d[-8:] <= "20240130")
    load_window(spark, mine, root, as_of, 5, True).count()
    assert same(load_window(spark, mine, root, as_of, 5, True), GX.load_export(spark, mine, as_of, 5, True))
    assert intraday and sorted(seen[1]) == intraday
    # One shard loses half its rows, another all of them, a third goes away.
    half = spark.read.parquet(f"{base}/events_20240127").filter(F.xxhash64("user_pseudo_id", "event_timestamp") % 2 == 0)
    half.write.mode("overwrite").parquet(f"{mine}/events_20240127")
    spark.read.parquet(f"{base}/events_20240126").limit(0).write.mode("overwrite").parquet(f"{mine}/events_20240126")
    shutil.rmtree(f"{mine}/events_20240128")
    got = load_window(spark, mine, root, as_of, 5)
    assert same(got, GX.load_export(spark, mine, as_of, 5)) and sorted(seen[2]) == ["20240126", "20240127"]


def test_event_names_have_a_store_of_their_own(spark, export, tmp_path):
    base, _ = export
    as_of, names = dt.date(2024, 1, 30), ["page_view", "purchase"]
    for some in (names, None, names):
        got = GX.query_export(spark, base, as_of, 3, event_names=some, snapshot_root=str(tmp_path))
        assert same(got, GX.load_export(spark, base, as_of, 3, event_names=some))


def test_an_interrupted_write_is_done_again(spark, export, tmp_path, monkeypatch):
    base, _ = export
    as_of = dt.date(2024, 1, 30)
    store = ShardStore(spark, str(tmp_path), base)
    shards = {p.rsplit("events_", 1)[1]: p for p in GX.list_shards(spark, base, as_of, 1)}
    mark = ShardStore._mark
    monkeypatch.setattr(ShardStore, "_mark", lambda self, s, state: mark(self, s, None) if state is None else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.refresh(shards)
    monkeypatch.setattr(ShardStore, "_mark", mark)
    assert store.kept() == {} and sorted(store.refresh(shards)) == sorted(shards)
    assert same(store.rows(sorted(shards)), GX.load_export(spark, base, as_of, 1))
    empty = load_window(spark, base, str(tmp_path), dt.date(2020, 1, 1), 3)
    assert empty.count() == 0 and empty.columns == store.schema.names
