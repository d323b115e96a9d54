"""Run histories, accounting, catalogue, manifests, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from notemill.operators import accounting as acc
from notemill.operators import runs
from notemill.sources import catalog
from notemill.sources import readers as rd
from notemill.sources import writers as wr
from notemill.streaming import monitor


def history(spark, values, run="r"):
    rows = [(run, i + 1, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run string, step int, metric double").withColumn(
        "ts", F.timestamp_seconds(F.col("step") * 60)
    )


def test_early_stop_golden(spark):
    h = history(spark, [0.5, 0.6, 0.6, 0.59, 0.7])
    row = runs.early_stop(h, "metric", patience=2).first()
    assert (row["stop_step"], row["stop_eval"], row["n_evals"]) == (4, 4, 5)
    assert runs.best_checkpoint(h.filter("step <= 4"), "metric").first()["best_step"] == 2
    assert runs.early_stop(h, "metric", patience=4).first()["stop_step"] is None


def brute_stop(values, patience, threshold):
    best, waited = None, 0
    for i, v in enumerate(values):
        if best is None or v - best > threshold:
            waited = 0
        else:
            waited += 1
        best = v if best is None else max(best, v)
        if waited >= patience:
            return i + 1
    return None


def test_early_stop_random_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(runs, "_STEPS", 8)
    rng = random.Random(9)
    expected, frames = {}, None
    for k in range(8):
        values = [round(rng.random() + i * 0.01, 2) for i in range(rng.randint(1, 60))]
        expected[f"r{k}"] = brute_stop(values, 6, 0.05)
        h = history(spark, values, f"r{k}")
        frames = h if frames is None else frames.unionAll(h)
    got = runs.early_stop(frames, "metric", patience=6, threshold=0.05).collect()
    assert {r["run"]: r["stop_step"] for r in got} == expected


def test_best_and_latest(spark):
    h = history(spark, [0.3, 0.9, 0.9, 0.1])
    best = runs.best_checkpoint(h, "metric")
    assert tuple(best.first()) == ("r", 2, 0.9)
    assert runs.best_checkpoint(h, "metric", mode="min").first()["best_step"] == 4
    assert sorted(r["step"] for r in runs.keep_latest(h).collect()) == [3, 4]
    assert sorted(r["step"] for r in runs.keep_latest(h, best=best).collect()) == [2, 3, 4]
    with pytest.raises(ValueError, match="mode"):
        runs.best_checkpoint(h, "metric", mode="best")


def test_budget_and_cadence(spark):
    h = history(spark, [0.1] * 10)
    got = runs.time_budget(h, 200).orderBy("step").collect()
    assert [r["step"] for r in got] == [1, 2, 3, 4, 5]
    assert [r["stopped"] for r in got] == [False] * 4 + [True]
    assert runs.time_budget(h, 10**6).count() == 10
    assert sorted(r["step"] for r in runs.cadence(h, 4).collect()) == [1, 4, 8]
    assert sorted(r["step"] for r in runs.cadence(h, 4, first=False).collect()) == [4, 8]


def test_scan_dirs(spark, tmp_path):
    for name in ("a/x/events.out.tfevents.1", "a/x/config.txt", "a/y/config.txt", "b/tfevents"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    rows = rd.scan_run_dirs(spark, str(tmp_path)).collect()
    assert sorted((r["dir"].split("/")[-1], r["n_files"], r["n_logs"]) for r in rows) == [("b", 1, 1), ("x", 2, 1)]


def test_manifest_appends(spark, tmp_path):
    path = str(tmp_path / "runs")
    wr.append_run(spark.createDataFrame([("r1", 1)], "run string, seed int"), path)
    wr.append_run(spark.createDataFrame([("r2", 2)], "run string, seed int"), path)
    assert sorted(r["run"] for r in spark.read.json(path).collect()) == ["r1", "r2"]


YAML = """model/one:
  Full:
    FLOPs: '6.81e+08'
    n_peft_params: 109482240
    n_trainable_params: 109483778
    raw_FLOPS: 680683008.0
    total_params: 109483778
  LORA:
    FLOPs: null
    n_peft_params: 294912
    n_trainable_params: 296450
    raw_FLOPS: null
    total_params: 109483778
two:
  LORA:
    n_peft_params: 5
    n_trainable_params: 7
    total_params: 50
"""
FIELDS = {"n_trainable_params": "bigint", "n_peft_params": "bigint", "total_params": "bigint", "raw_FLOPS": "double", "FLOPs": "string"}


def test_accounting(spark, tmp_path):
    (tmp_path / "acc.yaml").write_text(YAML)
    table = rd.accounting_columns(rd.read_accounting(spark, str(tmp_path / "acc.yaml")), FIELDS)
    rows = {(r["model"], r["method"]): r for r in table.collect()}
    assert set(rows) == {("model/one", "Full"), ("model/one", "LORA"), ("two", "LORA")}
    assert rows[("model/one", "Full")]["raw_FLOPS"] == 680683008.0
    assert rows[("model/one", "Full")]["FLOPs"] == "6.81e+08"
    assert rows[("model/one", "LORA")]["raw_FLOPS"] is None and rows[("model/one", "LORA")]["FLOPs"] is None
    shares = {(r["model"], r["method"]): r for r in acc.param_shares(acc.model_size(table)).collect()}
    lora = shares[("model/one", "LORA")]
    assert round(lora["model_size_MB"], 6) == 1.130867 and round(lora["n_peft_params_perc"], 6) == 0.269366
    assert round(lora["model_size_GB"], 9) == 0.001104362
    matrix = {r["model"]: (r["Full"], r["LORA"]) for r in acc.method_matrix(table, "n_peft_params", ["Full", "LORA"]).collect()}
    assert matrix == {"model/one": (109482240, 294912), "two": (None, 5)}
    done = spark.createDataFrame([("two", "LORA", 0.9)], "model string, method string, f1 double")
    assert acc.join_accounting(done, table).first()["total_params"] == 50
    nested = {"m": {"Full": {"total_params": 3}}}
    (tmp_path / "acc.json").write_text(json.dumps(nested))
    row = rd.accounting_columns(rd.read_accounting(spark, str(tmp_path / "acc.json")), {"total_params": "bigint"}).first()
    assert tuple(row) == ("m", "Full", 3)


def test_tensor_sizes(spark):
    tensors = spark.createDataFrame(
        [("m", 1000, 4, True, False, 4064), ("m", 500, 2, False, False, 1064), ("m", 10, 8, False, True, 144)],
        "model string, numel bigint, element_size int, requires_grad boolean, is_buffer boolean, serialized_bytes bigint",
    )
    counts = acc.param_counts(tensors).first()
    assert (counts["n_trainable_params"], counts["total_params"]) == (1000, 1500)
    full = acc.full_size(tensors).first()
    assert full["total_bytes"] == 4000 + 80 + 4064 + 1064 + 144


def test_catalogue(spark):
    table = catalog.task_catalog(spark, "root")
    assert table.count() == 11
    wanted = spark.createDataFrame([("mednli",), ("mimic-mp",), ("nope",)], "task string")
    rows = {r["task"]: r for r in catalog.resolve_task(wanted, table).collect()}
    assert (rows["mednli"]["text_column_1"], rows["mednli"]["text_column_2"]) == ("sentence1", "sentence2")
    assert rows["mimic-mp"]["known"] and rows["mimic-mp"]["label_name"] == "hospital_expire_flag"
    assert not rows["nope"]["known"] and rows["nope"]["text_column_1"] == "text"
    with pytest.raises(ValueError, match="mimic-mp"):
        catalog.task_settings(spark, "nope")
    own = catalog.task_settings(spark, "mimic-dia", label_name="group")
    assert catalog.label_column(own) == "group"
    with pytest.raises(ValueError, match="mimic-dia"):
        catalog.label_column(catalog.task_settings(spark, "mimic-dia"))
    assert catalog.label_column(catalog.task_settings(spark, "mednli")) == "labels"
    df = spark.createDataFrame([("t", 1)], "text string, label int")
    assert catalog.ensure_labels(df, "label").columns == ["text", "labels"]
    both = df.withColumn("labels", F.lit(2))
    assert catalog.ensure_labels(both, "label").columns == ["text", "label", "labels"]
    assert catalog.text_columns_by_position(both, 2) == ["text", "label"]
    assert catalog.drop_columns(both, ["text"]).columns == ["label", "labels"]


def test_stream_states(spark, tmp_path):
    rows = [("r", i, float(i % 7)) for i in range(0, 600, 10)] + [("s", 5, 1.0)]
    df = spark.createDataFrame(rows, "run string, sec long, value double").select(
        F.col("run").alias("user_id"), F.timestamp_seconds("sec").cast("timestamp_ntz").alias("ts"), "value"
    )
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    got = {r["run"]: r for r in monitor.run_states_of_events(spark, str(tmp_path / "in"), "*.parquet", 300).collect()}
    assert (got["r"]["elapsed"], got["r"]["best"], got["r"]["n_rows"], got["r"]["spent"]) == (590, 6.0, 60, True)
    assert got["s"]["spent"] is False


def test_label_incoming_notes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def note(name, word):
        (folder / f"{name}.xml").write_text(
            f'<r><TEXT><![CDATA[\nsaw {word} now\n]]></TEXT><TAGS><NAME id="P0" start="5" end="{5 + len(word)}" text="{word}" TYPE="DOCTOR"/></TAGS></r>'
        )

    def run():
        stream = monitor.label_incoming_notes(
            spark, str(folder), str(tmp_path / "out"), str(tmp_path / "log"), type_attr="TYPE"
        )
        stream.awaitTermination()
        return {r["doc_id"]: r["labels"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    note("1-01", "Smith")
    assert run() == {"1-01": ["O", "B-DOCTOR", "O"]}
    note("2-01", "Li")
    assert run() == {"1-01": ["O", "B-DOCTOR", "O"], "2-01": ["O", "B-DOCTOR", "O"]}
