"""Baselines trained on Spark: text, token and vector classifiers, and their search.

Fits run as distributed jobs of ``spark.ml``; only model coefficients reach the driver.
"""

from __future__ import annotations

import functools
import threading
import hashlib
import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions.arrays import let
from notemill.functions.text import word_pieces
from notemill.operators.metrics import (
    auc_binary,
    auc_or_zero,
    auc_ovr_macro,
    entity_scores,
    prefix_metrics,
    seq_cls_metrics,
)
from notemill.operators.rows import unroll
from notemill.runtime import drop_path, fresh_path, stage


def _regression(label: str, max_iter: int, **params) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol=label, family="multinomial", maxIter=max_iter, **params
    )


def _without_summary(model: LogisticRegressionModel, spark: SparkSession) -> LogisticRegressionModel:
    """The model written and read back, which leaves out the summary of its fit.

    The summary of two classes holds the session. A model's scoring carries all of it to the tasks, and a session in
    which any aggregate was observed cannot go there. More classes have no such summary.
    """
    if model.numClasses != 2:
        return model
    path = fresh_path(spark, "model")
    model.write().save(path)
    try:
        return LogisticRegressionModel.load(path)
    finally:
        drop_path(spark, path)


def _scoring(fitted: PipelineModel, spark: SparkSession) -> PipelineModel:
    return PipelineModel([*fitted.stages[:-1], _without_summary(fitted.stages[-1], spark)])


def fit_text_classifier(
    train: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    n_features: int = 1 << 16,
    max_iter: int = 20,
    **params,
) -> PipelineModel:
    """Hashed piece counts, inverse document frequency, multinomial regression."""
    words = with_pieces(train.select(text_col, label_col), text_col).select("pieces", label_col)
    words = words.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = Pipeline(
            stages=[
                HashingTF(inputCol="pieces", outputCol="counts", numFeatures=n_features),
                IDF(inputCol="counts", outputCol="features"),
                _regression(label_col, max_iter, **params),
            ]
        ).fit(words)
    finally:
        words.unpersist()
    return _scoring(fitted, train.sparkSession)


def with_pieces(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("pieces", word_pieces(F.col(text_col)))


def score(model, df: DataFrame) -> DataFrame:
    """Add ``logits``, ``probs`` and INT ``prediction`` as plain arrays."""
    raw = model.transform(df)
    return raw.select(
        *df.columns,
        vector_to_array("rawPrediction").alias("logits"),
        vector_to_array("probability").alias("probs"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def n_classes(model) -> int:
    return (model.stages[-1] if isinstance(model, PipelineModel) else model).numClasses


def evaluate_splits(model, splits: dict[str, DataFrame], label_col: str) -> DataFrame:
    """Sequence metrics of each split, with the split in the names (``eval_…``, ``test_…``).

    Rows are scored once; the metrics then read the stored logits.
    """
    parts = [
        score(model, df).select(F.lit(name).alias("__part"), F.col(label_col).alias("label"), "logits")
        for name, df in splits.items()
    ]
    scored = stage(functools.reduce(DataFrame.unionByName, parts), "scored")
    rows = [
        prefix_metrics(seq_cls_metrics(scored.filter(F.col("__part") == name), "logits", "label", n_classes(model)), name)
        for name in splits
    ]
    # One row per split under names of its own: a union and a max bring them together.
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def fit_linear_probe(
    df: DataFrame, vector_col: str, label_col: str, max_iter: int = 20, **params
) -> LogisticRegressionModel:
    """Only a head over frozen vectors.

    Rows that have ``features`` already are taken as they are, so that a search over many
    fits can prepare and keep them once.
    """
    if "features" in df.columns:
        return _without_summary(_regression(label_col, max_iter, **params).fit(df.select("features", label_col)), df.sparkSession)
    rows = as_features(df, vector_col).select("features", label_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _without_summary(_regression(label_col, max_iter, **params).fit(rows), df.sparkSession)
    finally:
        rows.unpersist()


def as_features(df: DataFrame, vector_col: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector_col).cast("array<double>")))


# --- tokens --------------------------------------------------------------------


def _shape(token: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(token, r"\p{Lu}+", "X"), r"\p{Ll}+", "x")
    return F.regexp_replace(marked, r"\p{N}+", "9")


def _token_facts(sentences: DataFrame, tokens: str, tags: str | None, key: list[str]) -> DataFrame:
    """One row per token: itself, its tag and its neighbours' shapes. A shape is found once per token."""

    def rows(words: Column) -> Column:
        def row(token: Column, i: Column) -> Column:
            return F.struct(
                i.alias("pos"),
                token["word"].alias("word"),
                F.coalesce(F.get(words, i - 1)["shape"], F.lit(_START)).alias("before"),
                F.coalesce(F.get(words, i + 1)["shape"], F.lit(_END)).alias("after"),
            )

        return F.transform(words, row)

    shaped = F.transform(tokens, lambda t: F.struct(t.alias("word"), _shape(t).alias("shape")))
    tag_ids = F.col(tags) if tags else F.transform(tokens, lambda _: F.lit(None).cast("int"))
    tagged = F.zip_with(
        let(shaped, rows),
        tag_ids,
        lambda r, g: F.struct(
            r["pos"].alias("pos"), r["word"].alias("word"), r["before"].alias("before"), r["after"].alias("after"), g.alias("tag_id")
        ),
    )
    return unroll(sentences, key, tagged, "r").select(*key, "r.*")


#: Shapes of the marks ``<s>`` and ``</s>`` that stand for neighbours beyond a sentence.
_START, _END = "<x>", "</x>"


def _pieces() -> Column:
    return F.array(
        F.concat(F.lit("w="), "word"),
        F.concat(F.lit("s="), _shape(F.col("word"))),
        F.concat(F.lit("e="), F.right(F.col("word"), F.lit(3))),
        F.concat(F.lit("p="), "before"),
        F.concat(F.lit("n="), "after"),
    ).alias("pieces")


def token_features(sentences: DataFrame, tokens: str, tags: str | None, key: list[str]) -> DataFrame:
    """One row per token with hashed-feature names: itself, shape, ending, neighbours."""
    return _token_facts(sentences, tokens, tags, key).select(*key, "pos", _pieces(), "tag_id")


def weighted_features(sentences: DataFrame, tokens: str, tags: str, key: list[str]) -> DataFrame:
    """``token_features`` with tags, tokens of equal features and tag as one row with their number ``n``."""
    facts = _token_facts(sentences, tokens, tags, key)
    distinct = facts.groupBy("word", "before", "after", "tag_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return distinct.select(_pieces(), "tag_id", "n")


def fit_token_classifier(
    sentences: DataFrame, tokens: str, tags: str, key: list[str], n_features: int = 1 << 14, max_iter: int = 10
) -> PipelineModel:
    """Every token counts, equal ones by a weight.

    So the fit's rows, which it keeps and passes over again and again, grow with the vocabulary and not with the text.
    """
    rows = weighted_features(sentences, tokens, tags, key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = Pipeline(
            stages=[
                HashingTF(inputCol="pieces", outputCol="features", numFeatures=n_features, binary=True),
                _regression("tag_id", max_iter, weightCol="n"),
            ]
        ).fit(rows)
    finally:
        rows.unpersist()
    return _scoring(fitted, sentences.sparkSession)


def predict_tags(model: PipelineModel, sentences: DataFrame, tokens: str, tags: str, key: list[str], names: list[str]) -> DataFrame:
    """Sentences with arrays of true and predicted tag names."""
    rows = model.transform(token_features(sentences, tokens, tags, key))
    known = F.lit(names)
    back = rows.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "tag_id", F.col("prediction").cast("int").alias("guess")))).alias("__r")
    )
    return back.select(
        *key,
        F.transform("__r", lambda r: F.get(known, r["tag_id"])).alias("true"),
        F.transform("__r", lambda r: F.get(known, r["guess"])).alias("pred"),
    )


def token_scores(model, sentences: DataFrame, tokens: str, tags: str, key: list[str], names: list[str]) -> DataFrame:
    return entity_scores(predict_tags(model, sentences, tokens, tags, key, names), "true", "pred")


# --- search --------------------------------------------------------------------


def _draw(study: str, trial: int, name: str, seed: int) -> float:
    """A fixed number in [0, 1) per study, trial and parameter."""
    digest = hashlib.md5(f"{seed}:{study}:{trial}:{name}".encode()).hexdigest()
    return int(digest[:13], 16) / 16**13


def draw_trials(study: str, space: dict[str, tuple], n_trials: int = 20, seed: int = 42) -> list[dict]:
    """Parameters per trial: ``("log_uniform", low, high)`` or ``("choice", [values])``."""
    trials = []
    for trial in range(n_trials):
        row: dict = {"study": study, "trial": trial}
        for name, spec in space.items():
            u = _draw(study, trial, name, seed)
            if spec[0] == "log_uniform":
                low, high = math.log(spec[1]), math.log(spec[2])
                row[name] = math.exp(low + u * (high - low))
            elif spec[0] == "choice":
                row[name] = spec[1][int(u * len(spec[1]))]
            else:
                raise ValueError(f"unknown distribution {spec[0]!r}; known: log_uniform, choice")
        trials.append(row)
    return trials


def pending_trials(trials: DataFrame, done: DataFrame | None) -> DataFrame:
    """Trials of a study that the store does not hold yet."""
    return trials if done is None else trials.join(done.select("study", "trial"), ["study", "trial"], "left_anti")


def roc_auc(scored: DataFrame, label_col: str, classes: int) -> float:
    if classes == 2:
        auc = auc_binary(scored.withColumn("__s", F.get(F.col("probs"), F.lit(1))), "__s", label_col)
    else:
        auc = auc_ovr_macro(scored, "probs", label_col)
    return auc_or_zero(auc).first()["auc"]


def search(
    fit: Callable[[dict], object],
    validation: DataFrame,
    label_col: str,
    classes: int,
    space: dict[str, tuple],
    study: str,
    n_trials: int = 20,
    seed: int = 42,
    store: str | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Trials with their validation AUC. ``fit`` maps drawn parameters to a model.

    Trials already in ``store`` (a folder of trial rows) are not run again. Fits run
    side by side from driver threads, each as a distributed job. A trial is stored as soon
    as it is done, so one that fails loses none of the others. Returns the store's rows of
    this study, or the new ones where there is no store.
    """
    spark = validation.sparkSession
    drawn = draw_trials(study, space, n_trials, seed)
    if not drawn:
        raise ValueError("a search needs at least one trial")
    done = _stored(spark, store)
    todo = spark.createDataFrame(drawn)
    wanted = {row["trial"] for row in pending_trials(todo, done).select("trial").collect()}

    def run(row: dict) -> dict:
        params = {k: v for k, v in row.items() if k not in ("study", "trial")}
        found = {**row, "roc_auc_macro": float(roc_auc(score(fit(params), validation), label_col, classes))}
        if store is not None:
            with storing:  # writers to one folder must not overlap
                spark.createDataFrame([found]).coalesce(1).write.mode("append").json(store)
        return found

    storing = threading.Lock()
    pool = ThreadPool(parallelism)
    try:
        results = pool.map(run, [row for row in drawn if row["trial"] in wanted])
    finally:
        pool.close()
    if store is None:
        return spark.createDataFrame(results)
    return _stored(spark, store).filter(F.col("study") == study)


def _stored(spark, store: str | None) -> DataFrame | None:
    if store is None:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.json(store)


def best_trial(trials: DataFrame, metric: str = "roc_auc_macro") -> DataFrame:
    """The trial with the largest metric, the earliest on ties."""
    rest = [c for c in trials.columns if c not in (metric, "trial")]
    top = F.max(F.struct(F.col(metric).alias("m"), (-F.col("trial")).alias("t"), *rest))
    return trials.agg(top.alias("b")).select(
        (-F.col("b.t")).alias("trial"), *[F.col(f"b.{c}") for c in rest], F.col("b.m").alias(metric)
    )
