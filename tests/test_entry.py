import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "activity_list_text" in df.columns


def test_registry_shapes():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert all(callable(f) for f in qs.values())


def test_workers_need_no_package_on_their_path(tmp_path):
    """Load the entry by file path from elsewhere; pandas-UDF stages must run."""
    import os
    import subprocess
    import sys

    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                         "__spark_entry__.py")
    code = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
spec = importlib.util.spec_from_file_location('entry_mod', {entry!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
print('ROWS', m.queries()['isolation_scores'](spark, '/root/testdata/sf0.001').count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS 500" in out.stdout, out.stderr[-2000:]


def test_bench_prints_one_json_line(tmp_path):
    import json
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_PASSES="1",
               BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(repo, "bench.py"), "journeys",
                          "divergence_top"], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=900)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1, out.stdout + out.stderr[-1000:]
    rec = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(rec)
    assert rec["unit"] == "sec" and rec["sf"] == "0.001"
    assert set(rec["queries"]) == {"journeys", "divergence_top"}
    assert all(isinstance(v, float) for v in rec["queries"].values())
