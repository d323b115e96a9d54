import datetime

import pytest

from notemill.operators import runs
from notemill.runtime import fresh_path
from notemill.streaming import monitor

SCHEMA = "run string, step int, ts timestamp, metric double"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, before)


def rows_of(run, first, metrics, minute=0):
    start = datetime.datetime(2024, 1, 1, 0, minute)
    return [(run, first + k, start + datetime.timedelta(minutes=first + k), m) for k, m in enumerate(metrics)]


def test_states_after_each_restart_equal_the_batch_result(spark, rocks):
    parts = [
        rows_of("a", 1, [0.1, 0.2, 0.2]) + rows_of("b", 1, [0.5]) + rows_of("silent", 1, [0.3]),
        rows_of("a", 4, [0.2, 0.19]) + rows_of("b", 20, [0.6, None]),
        rows_of("a", 60, [0.9, 0.1]) + rows_of("b", 61, [0.6, 0.55]),
    ]
    arrived, out, log = (fresh_path(spark, n) for n in ("arrived", "stops", "log"))
    so_far = []
    for part in parts:
        so_far += part
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(SCHEMA).parquet(arrived)
        monitor.store_updates(monitor.live_stops(stream, patience=2, seconds=1800), out, log)
        got = {r["run"]: (r["stop_step"], r["stop_eval"], r["n_evals"]) for r in monitor.latest_states(spark, out).collect()}
        want = runs.early_stop(spark.createDataFrame(so_far, SCHEMA), "metric", patience=2).collect()
        assert got == {r["run"]: (r["stop_step"], r["stop_eval"], r["n_evals"]) for r in want}
    spent = {r["run"]: r["spent"] for r in monitor.latest_states(spark, out).collect()}
    # The silent run has one row only: its timer fired when the others' rows moved the clock.
    assert spent == {"a": True, "b": True, "silent": True}
    last = spark.read.parquet(out)
    assert last.filter("run = 'silent'").count() == 2  # written when it changed, not in every batch
