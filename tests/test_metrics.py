"""Classification and entity scores against golden values and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from notemill.operators import metrics as mx


def preds(spark, labels, guesses):
    return spark.createDataFrame(list(zip(labels, guesses)), "label int, pred int")


def test_sequence_golden(spark):
    conf = mx.confusion(preds(spark, [0, 0, 1, 1], [0, 1, 1, 1]), "label", "pred")
    both = mx.macro_precision_recall(conf).first()
    assert math.isclose(both["precision"], 5 / 6) and both["recall"] == 0.75
    assert math.isclose(mx.f1(conf, "macro").first()[0], 0.7333333333333333)
    assert mx.f1(conf, "micro").first()[0] == 0.75
    assert math.isclose(mx.f1(conf, "weighted").first()[0], 0.7333333333333333)
    assert mx.accuracy(preds(spark, [0, 0, 1, 1], [0, 1, 1, 1]), "label", "pred").first()[0] == 0.75
    with pytest.raises(ValueError, match="micro"):
        mx.f1(conf, "samples")


def test_class_without_predictions_scores_zero(spark):
    conf = mx.confusion(preds(spark, [0, 1, 2], [0, 0, 0]), "label", "pred")
    rows = {r["cls"]: (r["precision"], r["recall"], r["f1"]) for r in mx.class_scores(conf).collect()}
    assert rows[1] == (0.0, 0.0, 0.0) and rows[0] == (1 / 3, 1.0, 0.5)


def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores)), "label int, score double")


@pytest.mark.parametrize(
    "labels,scores,auc",
    [
        ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75),
        ([0, 1, 0, 1], [0.5, 0.5, 0.5, 0.5], 0.5),
        ([1, 1], [0.2, 0.4], None),
    ],
)
def test_auc_golden(spark, labels, scores, auc):
    assert mx.auc_binary(scored(spark, labels, scores), "score", "label").first()["auc"] == auc


def brute_auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y]
    neg = [s for y, s in zip(labels, scores) if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_random_with_hot_score(spark):
    rng = random.Random(2)
    labels = [rng.randint(0, 1) for _ in range(600)]
    scores = [0.25 if rng.random() < 0.4 else round(rng.gauss(0.3 + 0.1 * y, 0.2), 3) for y in labels]
    got = mx.auc_binary(scored(spark, labels, scores), "score", "label").first()["auc"]
    assert math.isclose(got, brute_auc(labels, scores), abs_tol=1e-12)


def test_auc_ovr(spark):
    rng = random.Random(4)
    rows = [([rng.random() for _ in range(3)], rng.randint(0, 2)) for _ in range(90)]
    df = spark.createDataFrame(rows, "probs array<double>, label int")
    per = [brute_auc([y == c for _, y in rows], [p[c] for p, _ in rows]) for c in range(3)]
    assert math.isclose(mx.auc_ovr_macro(df, "probs", "label").first()["auc"], sum(per) / 3, abs_tol=1e-12)
    assert mx.auc_ovr_macro(df.filter("label < 2"), "probs", "label").first()["auc"] is None


def test_undefined_auc_keeps_rows(spark, tmp_path):
    rows = spark.createDataFrame([([0.1, 0.9], 1), ([0.7, 0.3], 1)], "logits array<double>, label int")
    out = mx.seq_cls_metrics(rows, "logits", "label", rejects_path=str(tmp_path / "bad")).first()
    assert out["roc_auc_macro"] == 0.0 and out["accuracy"] == 0.5
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_seq_cls_metrics_shapes(spark):
    two = spark.createDataFrame([([2.0, 0.0], 0), ([0.0, 1.0], 1), ([0.0, 3.0], 0)], "logits array<double>, label int")
    row = mx.seq_cls_metrics(two, "logits", "label").first()
    assert row["roc_auc_macro"] == 0.5 and math.isclose(row["accuracy"], 2 / 3)
    single = spark.createDataFrame([([2.0], 1), ([-1.0], 0)], "logits array<double>, label int")
    assert mx.seq_cls_metrics(single, "logits", "label").first()["roc_auc_macro"] == 1.0
    assert set(mx.prefix_metrics(two.limit(0).select("label"), "test").columns) == {"test_label"}


def test_entity_golden(spark):
    df = spark.createDataFrame(
        [(["O", "B-p", "I-p", "O"], ["O", "B-p", "I-p", "O"]), (["B-t"], ["O"])],
        "t array<string>, p array<string>",
    )
    row = mx.entity_scores(df, "t", "p").first()
    assert (row["precision"], row["recall"], row["accuracy"]) == (1.0, 0.5, 0.8)
    assert math.isclose(row["f1"], 2 / 3)
    none = mx.entity_scores(df.select(F.array(F.lit("O")).alias("t"), F.array(F.lit("O")).alias("p")), "t", "p").first()
    assert tuple(none) == (0.0, 0.0, 0.0, 1.0)


def test_token_metrics_mask(spark):
    tags = ["O", "B-t", "I-t"]

    def logit(i):
        return [1.0 if k == i else 0.0 for k in range(3)]

    df = spark.createDataFrame(
        [([logit(2), logit(1), logit(2), logit(1)], [-100, 1, 2, -100]), ([logit(1)], [0])],
        "logits array<array<double>>, labels array<int>",
    )
    row = mx.token_cls_metrics(df, "logits", "labels", tags).first()
    assert (row["precision"], row["recall"]) == (0.5, 1.0)
    assert math.isclose(row["accuracy"], 2 / 3)
