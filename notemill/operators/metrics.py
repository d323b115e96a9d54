"""Classification and entity scores as DataFrame aggregates.

Everything after the first aggregation is small: a confusion table has one row per
pair of classes, and ROC-AUC works on distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.arrays import argmax, drop_masked, entity_chunks, softmax
from notemill.operators.conll import decode_tags
from notemill.operators.ordered import running_sums


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def class_scores(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class seen as label or prediction."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = conf.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("hits")),
                F.struct(F.col("prediction").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    return sums.select(
        "cls",
        "support",
        "predicted",
        "hits",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def macro_precision_recall(conf: DataFrame) -> DataFrame:
    return class_scores(conf).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def _f1(average: str) -> Column:
    if average == "macro":
        return F.avg("f1")
    if average == "weighted":
        return _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support"))
    if average == "micro":
        return _ratio(F.sum("hits"), F.sum("support"))
    raise ValueError(f"unknown average {average!r}; known: macro, micro, weighted")


def f1(conf: DataFrame, average: str = "macro") -> DataFrame:
    return class_scores(conf).agg(_f1(average).alias(f"f1_{average}"))


# --- ROC-AUC -------------------------------------------------------------------


def cumulative_pos_neg(
    df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Distinct scores with their positives, negatives and the negatives below them."""
    rows = df.select(*by, F.col(score).cast("double").alias("score"), positive.cast("boolean").alias("__p"))
    counts = rows.groupBy(*by, "score").agg(
        F.sum(F.when(F.col("__p"), 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("__p"), 0).otherwise(1)).alias("neg"),
    )
    return running_sums(counts, by, "score", {"neg_below": F.col("neg")})


def _auc(cumulative: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs ranked right over all pairs, ties half; NULL where a side is missing."""
    right = F.col("pos").cast("double") * (F.col("neg_below").cast("double") + F.col("neg").cast("double") / 2)
    grouped = cumulative.groupBy(*by) if by else cumulative.groupBy()
    sums = grouped.agg(F.sum(right).alias("__r"), F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    pairs = F.col("__p").cast("double") * F.col("__n").cast("double")
    return sums.select(*by, F.when(pairs > 0, F.col("__r") / pairs).alias("auc"))


def auc_binary(df: DataFrame, score: str, label: str, positive=1) -> DataFrame:
    return _auc(cumulative_pos_neg(df, score, F.col(label) == positive))


def auc_ovr_macro(df: DataFrame, probs: str, label: str) -> DataFrame:
    """Mean one-vs-rest AUC over the columns of ``probs``; NULL if any is undefined."""
    long = df.select(F.col(label).alias("__y"), F.posexplode(probs).alias("cls", "score"))
    per_class = _auc(cumulative_pos_neg(long, "score", F.col("__y") == F.col("cls"), ["cls"]), ["cls"])
    undefined = F.sum(F.when(F.col("auc").isNull(), 1).otherwise(0))
    return per_class.agg(F.when(undefined == 0, F.avg("auc")).alias("auc"))


def auc_or_zero(auc: DataFrame, rejects: DataFrame | None = None, rejects_path: str | None = None) -> DataFrame:
    """AUC with 0.0 where undefined; the rows that caused it go to ``rejects_path``."""
    if rejects is not None and rejects_path is not None:
        if auc.filter(F.col("auc").isNull()).limit(1).count():
            rejects.write.mode("overwrite").parquet(rejects_path)
    return auc.select(F.coalesce("auc", F.lit(0.0)).alias("auc"))


def with_scores(df: DataFrame, logits: str) -> DataFrame:
    """Add ``probs`` and ``prediction`` to rows of logits."""
    return df.withColumn("probs", softmax(F.col(logits))).withColumn("prediction", argmax(F.col(logits)))


def seq_cls_metrics(
    df: DataFrame, logits: str, label: str, n_classes: int | None = None, rejects_path: str | None = None
) -> DataFrame:
    """One row: precision, recall, accuracy, f1_macro, f1_micro, f1_weighted, roc_auc_macro."""
    if n_classes is None:
        head = df.select(F.size(logits).alias("c")).first()
        n_classes = head["c"] if head else 0
    scored = with_scores(df, logits)
    if n_classes == 1:
        single = scored.withColumn("__s", 1 / (1 + F.exp(-F.get(F.col(logits), F.lit(0)).cast("double"))))
        auc = auc_binary(single, "__s", label)
    elif n_classes == 2:
        auc = auc_binary(scored.withColumn("__s", F.get(F.col("probs"), F.lit(1))), "__s", label)
    else:
        auc = auc_ovr_macro(scored, "probs", label)
    auc = auc_or_zero(auc, scored.select(logits, "probs", label), rejects_path)
    base = class_scores(confusion(scored, label, "prediction")).agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        _f1("micro").alias("accuracy"),
        *[_f1(a).alias(f"f1_{a}") for a in ("macro", "micro", "weighted")],
    )
    names = base.columns
    none = F.lit(None).cast("double")
    both = base.withColumn("roc_auc_macro", none).unionByName(
        auc.select(*[none.alias(c) for c in names], F.col("auc").alias("roc_auc_macro"))
    )
    return both.agg(*[F.max(c).alias(c) for c in [*names, "roc_auc_macro"]])


# --- entities ------------------------------------------------------------------


def entity_scores(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Micro precision, recall and F1 over exact entities, and token accuracy.

    Chunks of one sequence are compared inside its row, so only four sums travel.
    """
    true, pred = entity_chunks(F.col(true_col)), entity_chunks(F.col(pred_col))
    chunks = df.select(
        true.alias("__t"), pred.alias("__p"), F.col(true_col).alias("__tags"), F.col(pred_col).alias("__guess")
    )
    same = F.size(F.filter(F.zip_with("__tags", "__guess", lambda a, b: a == b), lambda x: x))
    counts = chunks.select(
        F.size(F.array_intersect("__t", "__p")).alias("hits"),
        F.size("__t").alias("true"),
        F.size("__p").alias("pred"),
        same.alias("same"),
        F.size("__tags").alias("tokens"),
    )
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns])
    return sums.select(
        _ratio(F.col("hits"), F.col("pred")).alias("precision"),
        _ratio(F.col("hits"), F.col("true")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("pred") + F.col("true")).alias("f1"),
        _ratio(F.col("same"), F.col("tokens")).alias("accuracy"),
    )


def token_cls_metrics(
    df: DataFrame, logits: str, labels: str, tags: Sequence[str], mask: int = -100
) -> DataFrame:
    """Entity scores from logits per position and label ids; masked positions drop out."""
    guessed = df.select(F.transform(logits, argmax).alias("__g"), labels)
    pairs = guessed.select(drop_masked(F.col("__g"), F.col(labels), mask).alias("__x"))
    ids = pairs.select(
        F.transform("__x", lambda x: x["pred"]).alias("__pi"),
        F.transform("__x", lambda x: x["label"]).alias("__ti"),
    )
    named = decode_tags(decode_tags(ids, tags, "__pi", "pred"), tags, "__ti", "true")
    return entity_scores(named, "true", "pred")


def prefix_metrics(metrics: DataFrame, prefix: str) -> DataFrame:
    return metrics.select(*[F.col(c).alias(f"{prefix}_{c}") for c in metrics.columns])
