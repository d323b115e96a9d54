"""Live views of runs and notes, as Structured Streaming queries.

Run states use streaming aggregates, which combine on the map side first; a single
busy run costs one state row. Labelling new notes needs no state at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from notemill.functions.naming import elapsed_seconds
from notemill.operators.spans import label_annotated_notes
from notemill.runtime import fresh_path
from notemill.sources.readers import parse_span_xml


def run_states(history: DataFrame, seconds: int, run: str = "run", metric: Column | None = None) -> DataFrame:
    """Start, latest row, best metric and whether the time budget is spent, per run.

    ``history`` may be a stream or a table.
    """
    metric = F.col("metric") if metric is None else metric
    states = history.groupBy(run).agg(
        F.min("ts").alias("started"), F.max("ts").alias("latest"),
        F.max(metric).alias("best"), F.count(F.lit(1)).alias("n_rows"),
    )
    elapsed = elapsed_seconds(F.col("latest"), F.col("started"))
    return states.select(run, elapsed.alias("elapsed"), "best", "n_rows", (elapsed > seconds).alias("spent"))


def run_states_of_events(spark: SparkSession, folder: str, files: str, seconds: int) -> DataFrame:
    """Run states after all matching files of ``folder`` have come in as a stream."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    states = run_states(events.select(F.col("user_id").alias("run"), "ts", F.col("value").alias("metric")), seconds)
    out, log = fresh_path(spark, "run-states"), fresh_path(spark, "run-states-log")

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream = (
        states.writeStream.outputMode("complete").option("checkpointLocation", log)
        .trigger(availableNow=True).foreachBatch(store).start()
    )
    stream.awaitTermination()
    last = spark.read.parquet(out)
    newest = last.agg(F.max("epoch").alias("epoch"))
    return last.join(newest, "epoch", "left_semi").drop("epoch")


def label_incoming_notes(spark: SparkSession, folder: str, out: str, log: str, tags: str = "*", type_attr: str = "type"):
    """Label annotated XML files as they arrive and append them to a dataset.

    Returns the stream; each file is handled once, also after a restart from ``log``.
    """
    files = spark.readStream.text(folder, wholetext=True, pathGlobFilter="*.xml")
    named = files.select(
        F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.xml$", "").alias("doc_id"),
        F.regexp_replace("value", r"\r\n?", "\n").alias("text"),
    )
    notes = parse_span_xml(named, tags, type_attr)
    return (
        label_annotated_notes(notes)
        .writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", log)
        .trigger(availableNow=True).start()
    )


_STATE = (
    "n_evals long, best double, last_improved long, stop_step long, stop_eval long, started timestamp, spent boolean, last_step long"
)
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]


class _Stops(StatefulProcessor):
    """The state of one run: a few numbers, whatever the length of its history."""

    def __init__(self, patience: int, threshold: float, seconds: int, sign: int, run: str):
        self.patience, self.threshold, self.seconds, self.sign, self.run = patience, threshold, seconds, sign, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def _row(self, key, now: dict):
        import pandas as pd

        values = {self.run: key[0], **{c: now[c] for c in ("stop_step", "stop_eval", "n_evals", "spent")}}
        return pd.DataFrame({c: pd.Series([v], dtype="boolean" if c == "spent" else None if c == self.run else "Int64") for c, v in values.items()})

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        old = self.state.get() if self.state.exists() else None
        now = dict(zip(_FIELDS, old)) if old else {c: None for c in _FIELDS} | {"n_evals": 0, "last_improved": 0, "spent": False}
        table = pd.concat(list(rows)).sort_values("step")
        if now["started"] is None:
            now["started"] = table["ts"].min().to_pydatetime()
            # Fires once the stream's clock has passed the budget, also if the run is silent by then.
            self.handle.registerTimer(int(table["ts"].min().timestamp() * 1000) + self.seconds * 1000 + 1)
        for step, value in zip(table["step"], table["metric"]):
            value = None if pd.isna(value) else float(value) * self.sign
            now["n_evals"] += 1
            if now["best"] is None or (value is not None and value - now["best"] > self.threshold):
                now["last_improved"] = now["n_evals"]
            if value is not None and (now["best"] is None or value > now["best"]):
                now["best"] = value
            if now["stop_step"] is None and now["n_evals"] - now["last_improved"] >= self.patience:
                now["stop_step"], now["stop_eval"] = int(step), now["n_evals"]
            now["last_step"] = int(step)
        latest = table["ts"].max()
        now["spent"] = bool(now["spent"] or (latest - pd.Timestamp(now["started"])).total_seconds() > self.seconds)
        self.state.update(tuple(now[c] for c in _FIELDS))
        yield self._row(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = dict(zip(_FIELDS, self.state.get()))
        if not now["spent"]:
            now["spent"] = True
            self.state.update(tuple(now[c] for c in _FIELDS))
            yield self._row(key, now)

    def close(self) -> None:
        pass


def live_stops(
    history: DataFrame, patience: int = 5, threshold: float = 0.0, seconds: int = 20 * 86400, run: str = "run",
    mode: str = "max", delay: str = "0 seconds",
) -> DataFrame:
    """Where each run stops early and whether its time budget is spent, while its history comes in.

    ``history`` is a stream of ``run``, ``step``, ``ts``, ``metric``; a run's rows come in the order of their steps, or together.
    In update mode a run is emitted when it has new rows or its timer fires; only its state is kept. A batch's runs
    equal ``runs.early_stop`` over all rows so far; ``spent`` follows the stream's clock (the latest ``ts`` less
    ``delay``). Needs the RocksDB state store.
    """
    watched = history.select(run, "step", "ts", "metric").withWatermark("ts", delay)
    kind = watched.schema[run].dataType.simpleString()
    return watched.groupBy(run).transformWithStateInPandas(
        statefulProcessor=_Stops(patience, threshold, seconds, 1 if mode == "max" else -1, run),
        outputStructType=f"{run} {kind}, stop_step long, stop_eval long, n_evals long, spent boolean",
        outputMode="Update", timeMode="EventTime",
    )


def store_updates(states: DataFrame, out: str, log: str):
    """Run an update stream over what has arrived; each batch adds the runs that changed. Restarts from ``log``."""

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream = (
        states.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(store).start()
    )
    stream.awaitTermination()


def latest_states(spark: SparkSession, out: str, run: str = "run") -> DataFrame:
    """The last stored state of each run."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (run, "epoch")]
    return rows.groupBy(run).agg(F.max_by(F.struct(*rest), "epoch").alias("x")).select(run, "x.*")
