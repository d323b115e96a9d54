"""Run histories: best checkpoint, early stop, time budget, cadence, log folders.

A history has one row per evaluation: ``run``, ``step``, ``ts``, a metric. Runs may
be of any length; nothing here puts a whole run into one task's window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.functions.naming import elapsed_seconds
from notemill.operators.ordered import running
from notemill.operators.rows import salted_join

_STEPS = 4096


def best_checkpoint(history: DataFrame, metric: str, mode: str = "max", run: str = "run") -> DataFrame:
    """Step and value of each run's best evaluation, the earliest one on ties."""
    if mode not in ("max", "min"):
        raise ValueError(f"unknown mode {mode!r}; known: max, min")
    value = F.col(metric) if mode == "max" else -F.col(metric)
    best = F.max(F.struct(value.alias("v"), (-F.col("step")).alias("s")))
    picked = history.filter(F.col(metric).isNotNull()).groupBy(run).agg(best.alias("__b"))
    shown = F.col("__b.v") if mode == "max" else -F.col("__b.v")
    return picked.select(run, (-F.col("__b.s")).alias("best_step"), shown.alias(metric))


def patience_used(
    history: DataFrame, metric: str, threshold: float = 0.0, run: str = "run", mode: str = "max"
) -> DataFrame:
    """Add ``n_eval``, ``improved`` and ``waited``: evaluations since the last improvement.

    An evaluation improves on the run if it beats the best value before it by more
    than ``threshold``; the first one always does.
    """
    value = F.col(metric) if mode == "max" else -F.col(metric)
    stretch = F.floor(F.col("step") / _STEPS)
    seen = running(
        history, [run], ["step"], stretch,
        {"__before": ("max", value), "__rank": ("count", F.lit(1))},
        inclusive=False,
    )
    improved = F.col("__before").isNull() | (value - F.col("__before") > F.lit(float(threshold)))
    flagged = seen.withColumn("n_eval", F.col("__rank") + 1).withColumn("improved", improved)
    last = running(
        flagged, [run], ["step"], stretch,
        {"__last": ("max", F.when(F.col("improved"), F.col("n_eval")))},
    )
    return last.withColumn("waited", F.col("n_eval") - F.col("__last")).drop("__before", "__rank", "__last")


def early_stop(
    history: DataFrame,
    metric: str,
    patience: int = 5,
    threshold: float = 0.0,
    run: str = "run",
    mode: str = "max",
) -> DataFrame:
    """Step at which each run stops (NULL if never) and its number of evaluations by then."""
    waited = patience_used(history, metric, threshold, run, mode)
    over = F.col("waited") >= patience
    return waited.groupBy(run).agg(
        F.min(F.when(over, F.col("step"))).alias("stop_step"),
        F.min(F.when(over, F.col("n_eval"))).alias("stop_eval"),
        F.count(F.lit(1)).alias("n_evals"),
    )


def keep_latest(history: DataFrame, k: int = 2, run: str = "run", best: DataFrame | None = None) -> DataFrame:
    """The latest ``k`` checkpoints of each run, and its best one where given."""
    window = Window.partitionBy(run).orderBy(F.desc("step"))
    latest = history.withColumn("__r", F.row_number().over(window)).filter(F.col("__r") <= k).drop("__r")
    if best is None:
        return latest
    kept = best.select(run, F.col("best_step").alias("step"))
    return latest.unionByName(history.join(kept, [run, "step"], "left_semi")).distinct()


def time_budget(history: DataFrame, seconds: int, run: str = "run", start: DataFrame | None = None) -> DataFrame:
    """Steps a run makes before its budget is spent: the first step past it is its last.

    ``start`` may give ``(run, started)``; else a run starts with its first row.
    """
    if start is None:
        start = history.groupBy(run).agg(F.min("ts").alias("started"))
    timed = salted_join(history, start, run, ["step"]).withColumn(
        "elapsed", elapsed_seconds(F.col("ts"), F.col("started"))
    )
    last = timed.groupBy(run).agg(
        F.min(F.when(F.col("elapsed") > seconds, F.col("step"))).alias("__last")
    )
    kept = salted_join(timed, last, run, ["step"]).filter(F.col("__last").isNull() | (F.col("step") <= F.col("__last")))
    return kept.select(*history.columns, "elapsed", F.coalesce(F.col("step") == F.col("__last"), F.lit(False)).alias("stopped"))


def cadence(history: DataFrame, k: int, first: bool = True) -> DataFrame:
    """Rows at every ``k`` steps, and step 1 where wanted."""
    due = F.col("step") % k == 0
    return history.filter(due | (F.col("step") == 1) if first else due)


def dirs_with(files: DataFrame, needle: str = "tfevents", path: str = "path") -> DataFrame:
    """Directories that hold a file whose name contains ``needle``, with all their files counted."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    folder = F.regexp_replace(F.col(path), "/[^/]*$", "")
    hit = F.contains(name, F.lit(needle))
    return files.groupBy(folder.alias("dir")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.when(hit, 1).otherwise(0)).alias("n_logs")
    ).filter(F.col("n_logs") > 0)
