"""The task catalogue and the columns each task reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = (
    "task string, task_type string, data_dir string, training_file string, validation_file string, "
    "test_file string, label_name string, text_columns array<string>, remove_columns array<string>"
)

# The known tasks. Folders are relative to the catalogue's root; a task
# without file names is a stored dataset.
_TASKS = [
    ("mednli", "SEQ_CLS", "MedNLI", None, None, None, None, ["sentence1", "sentence2"], ["sentence1", "sentence2"]),
    ("mimic-dia", "SEQ_CLS", "mimic3-clinical-outcomes/dia", "DIA_GROUPS_3_DIGITS_adm_train.csv", "DIA_GROUPS_3_DIGITS_adm_val.csv", "DIA_GROUPS_3_DIGITS_adm_test.csv", None, ["text"], ["text"]),
    ("mimic-dia-adm-only", "SEQ_CLS", "mimic3-clinical-outcomes/dia_adm_only", "DIA_GROUPS_3_DIGITS_adm_train.csv", "DIA_GROUPS_3_DIGITS_adm_val.csv", "DIA_GROUPS_3_DIGITS_adm_test.csv", None, ["text"], ["text"]),
    ("mimic-los", "SEQ_CLS", "mimic3-clinical-outcomes/los", "train.csv", "valid.csv", "LOS_WEEKS_adm_test.csv", "los_label", ["text"], ["text"]),
    ("mimic-los-adm-only", "SEQ_CLS", "mimic3-clinical-outcomes/los_adm_only", "LOS_WEEKS_adm_train.csv", "LOS_WEEKS_adm_val.csv", "LOS_WEEKS_adm_test.csv", None, ["text"], ["text"]),
    ("mimic-mp", "SEQ_CLS", "mimic3-clinical-outcomes/mp", "train.csv", "valid.csv", "test.csv", "hospital_expire_flag", ["text"], ["text"]),
    ("ICD9-Triage", "SEQ_CLS", "icd9-triage/no_category_in_text", "train.csv", "valid.csv", "test.csv", "label", ["text"], ["text", "triage-category"]),
    ("i2b2-2010-NER", "TOKEN_CLS", "I2B22010NER_hf_dataset", None, None, None, None, ["text"], ["text"]),
    ("i2b2-2012-NER", "TOKEN_CLS", "i2b2-2012_hf_dataset", None, None, None, None, ["text"], ["text"]),
    ("i2b2-2014-NER", "TOKEN_CLS", "i2b2-2014_hf_dataset", None, None, None, None, ["text"], ["text"]),
    ("i2b2-2010-RE", "SEQ_CLS", "i2b2-2010-RE", None, None, None, None, ["text"], ["text"]),
]

# Text columns by task name, where they differ from ("text", none).
_TEXT_KEYS = {
    "cola": ("sentence", None),
    "mnli": ("premise", "hypothesis"),
    "mnli-mm": ("premise", "hypothesis"),
    "mrpc": ("sentence1", "sentence2"),
    "qnli": ("question", "sentence"),
    "qqp": ("question1", "question2"),
    "rte": ("sentence1", "sentence2"),
    "sst2": ("sentence", None),
    "stsb": ("sentence1", "sentence2"),
    "wnli": ("sentence1", "sentence2"),
    "mimic-note-category": ("TEXT", None),
    "mednli": ("sentence1", "sentence2"),
}


def task_catalog(spark: SparkSession, root: str = "datasets") -> DataFrame:
    rows = [(t[0], t[1], f"{root}/{t[2]}", *t[3:]) for t in _TASKS]
    return spark.createDataFrame(rows, _SCHEMA)


def text_columns(task: Column) -> tuple[Column, Column]:
    """First and second text column of a task; ``('text', NULL)`` where unknown."""
    first, second = F.lit("text"), F.lit(None).cast("string")
    for name, (a, b) in _TEXT_KEYS.items():
        hit = task == name
        first = F.when(hit, F.lit(a)).otherwise(first)
        second = F.when(hit, F.lit(b).cast("string")).otherwise(second)
    return first, second


def text_columns_by_position(df: DataFrame, n: int = 1) -> list[str]:
    return df.columns[:n]


def resolve_task(runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Runs with their task's fields; ``known`` tells whether the catalogue has the task."""
    marked = catalog.withColumn("__known", F.lit(True))
    joined = runs.join(marked, "task", "left")
    first, second = text_columns(F.col("task"))
    return joined.withColumn("known", F.coalesce("__known", F.lit(False))).drop("__known").withColumn(
        "text_column_1", first
    ).withColumn("text_column_2", second)


def task_settings(spark: SparkSession, task: str, root: str = "datasets", **overrides) -> dict:
    """Fields of one task; explicit values win over the catalogue's."""
    rows = {row["task"]: row.asDict() for row in task_catalog(spark, root).collect()}
    if task not in rows:
        raise ValueError(f"unknown task {task!r}; known tasks: {sorted(rows)}")
    return {**rows[task], **{k: v for k, v in overrides.items() if v is not None}}


def label_column(settings: dict) -> str:
    """Label column of a task; a CSV task must name one, a stored dataset uses ``labels``."""
    if settings.get("label_name"):
        return settings["label_name"]
    if settings.get("training_file"):
        raise ValueError(f"task {settings['task']!r} has no label column; pass label_name")
    return "labels"


def ensure_labels(df: DataFrame, label_col: str) -> DataFrame:
    """The label column under the name ``labels``, unless that name is taken."""
    return df if "labels" in df.columns else df.withColumnRenamed(label_col, "labels")


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)
