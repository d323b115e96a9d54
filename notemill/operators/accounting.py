"""Parameter counts and sizes per model and method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MB = 1024.0**2
_PARAM_BYTES = 4


def param_counts(tensors: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Trainable and total parameters; buffers are not parameters."""
    numel = F.when(~F.col("is_buffer"), F.col("numel")).otherwise(F.lit(0))
    return tensors.groupBy(*by).agg(
        F.sum(F.when(F.col("requires_grad"), numel).otherwise(F.lit(0))).alias("n_trainable_params"),
        F.sum(numel).alias("total_params"),
    )


def model_size(counts: DataFrame, n_col: str = "n_trainable_params") -> DataFrame:
    """Size in MB and GB at four bytes a parameter."""
    mb = F.col(n_col).cast("double") * _PARAM_BYTES / _MB
    return counts.withColumn("model_size_MB", mb).withColumn("model_size_GB", mb / 1024)


def full_size(tensors: DataFrame, by: Sequence[str] = ("model",), serialized: str = "serialized_bytes") -> DataFrame:
    """Trainable, buffer and serialized bytes together.

    ``serialized`` is a column with each tensor's bytes in the stored model.
    """
    size = F.col("numel") * F.col("element_size")
    trainable = F.when(F.col("requires_grad") & ~F.col("is_buffer"), size).otherwise(F.lit(0))
    buffers = F.when(F.col("is_buffer"), size).otherwise(F.lit(0))
    total = F.sum(trainable) + F.sum(buffers) + F.sum(serialized)
    sums = tensors.groupBy(*by).agg(total.alias("total_bytes"))
    mb = F.col("total_bytes").cast("double") / _MB
    return sums.withColumn("full_model_size_MB", mb).withColumn("full_model_size_GB", mb / 1024)


def param_shares(accounting: DataFrame, total: str = "total_params") -> DataFrame:
    """Percentages of adapter and trainable parameters, as far as the columns are there."""
    shares = {"n_peft_params": "n_peft_params_perc", "n_trainable_params": "n_trainable_params_perc"}
    out = accounting
    for part, name in shares.items():
        if part in accounting.columns:
            out = out.withColumn(name, F.col(part).cast("double") / F.col(total).cast("double") * 100)
    return out


def method_matrix(accounting: DataFrame, field: str, methods: Sequence[str]) -> DataFrame:
    """One row per model, one column per method; the methods fix the columns."""
    return accounting.groupBy("model").pivot("method", list(methods)).agg(F.first(field, ignorenulls=True))


def join_accounting(runs: DataFrame, accounting: DataFrame) -> DataFrame:
    """Runs with the accounting of their model and method; NULL where there is none."""
    return runs.join(accounting, ["model", "method"], "left")
