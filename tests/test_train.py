"""Baselines and search."""

import pytest
from pyspark.sql import functions as F

from notemill.operators import train
from notemill.plans import flows


def texts(spark, n=80):
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("good fine well "), F.col("id"))).otherwise(
            F.concat(F.lit("bad poor ill "), F.col("id"))
        ).alias("text"),
        (F.col("id") % 2).cast("int").alias("label"),
    )


def test_text_classifier(spark):
    row = flows.classify_text(texts(spark), "id", "text", "label", n_features=1 << 10).first()
    assert row["eval_f1_macro"] > 0.9 and row["test_roc_auc_macro"] > 0.9


def test_two_classes_after_an_observation(spark):
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    row = flows.classify_text(texts(spark), "id", "text", "label", n_features=1 << 10).first()
    assert row["eval_f1_macro"] > 0.9
    vectors = spark.range(60).select(
        F.array(F.col("id") % 2 + F.rand(1) * 0.1, F.rand(2)).alias("v"), (F.col("id") % 2).cast("int").alias("label")
    )
    model = train.fit_linear_probe(vectors, "v", "label", max_iter=3)
    assert train.score(model, train.as_features(vectors, "v")).filter("prediction = label").count() > 50


def test_token_classifier(spark):
    rows = [
        ("train" if i % 4 else "validation", i, ["saw", f"Dr{i % 5}", "today"], ["O", "B-DOC", "O"]) for i in range(40)
    ]
    df = spark.createDataFrame(rows, "split string, id int, tokens array<string>, labels array<string>")
    got = flows.classify_tokens(df, ["id"], n_features=1 << 10).first()
    assert got["eval_f1"] > 0.9 and got["eval_accuracy"] > 0.9


def test_equal_tokens_are_one_weighted_row(spark):
    rows = [(i, ["saw", f"Dr{i % 5}", "saw", "today"], [0, 1, 0, 0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, ids array<int>")
    counted = train.weighted_features(df, "tokens", "ids", ["id"]).collect()
    # The first and the second "saw" have other neighbours, the five names are words of their own.
    assert len(counted) == 8 and sum(r["n"] for r in counted) == 160
    every = train.token_features(df, "tokens", "ids", ["id"]).collect()
    assert {(*r["pieces"], r["tag_id"]) for r in every} == {(*r["pieces"], r["tag_id"]) for r in counted}
    assert ["w=saw", "s=x", "e=saw", "p=<x>", "n=Xx9"] in [r["pieces"] for r in counted]


SPACE = {"rate": ("log_uniform", 1e-5, 1e-3), "mix": ("choice", [0.0, 0.5, 1.0])}


def test_draws_are_fixed_and_in_range():
    trials = train.draw_trials("s", SPACE, 20)
    assert trials == train.draw_trials("s", SPACE, 20)
    assert trials != train.draw_trials("t", SPACE, 20)
    assert all(1e-5 <= t["rate"] <= 1e-3 for t in trials)
    assert {t["mix"] for t in trials} == {0.0, 0.5, 1.0}
    with pytest.raises(ValueError, match="log_uniform"):
        train.draw_trials("s", {"x": ("normal", 0, 1)}, 1)


def test_search_resumes(spark, tmp_path):
    rows = spark.range(60).select(
        "id", F.array(F.col("id") % 2 + F.rand(1) * 0.1, F.rand(2)).alias("v"), (F.col("id") % 2).cast("int").alias("label")
    )
    ready = train.as_features(rows, "v").persist()
    ran = []

    def fit(params):
        ran.append(params)
        return train.fit_linear_probe(rows, "v", "label", max_iter=3, regParam=params["rate"])

    store = str(tmp_path / "trials")
    first = train.search(fit, ready, "label", 2, SPACE, "s", n_trials=2, store=store)
    assert first.count() == 2 and len(ran) == 2
    more = train.search(fit, ready, "label", 2, SPACE, "s", n_trials=3, store=store)
    assert more.count() == 3 and len(ran) == 3
    best = train.best_trial(more).first()
    assert best["roc_auc_macro"] == more.agg(F.max("roc_auc_macro")).first()[0]
    ready.unpersist()


def test_failed_trial_keeps_the_others(spark, tmp_path):
    rows = spark.range(60).select(
        "id", F.array(F.col("id") % 2 + F.rand(1) * 0.1, F.rand(2)).alias("v"), (F.col("id") % 2).cast("int").alias("label")
    )
    ready = train.as_features(rows, "v").select("id", "features", "label").persist()
    last = train.draw_trials("s", SPACE, 3)[2]["rate"]
    ran = []

    def fit(params, broken=True):
        ran.append(params)
        if broken and params["rate"] == last:
            raise RuntimeError("no luck")
        return train.fit_linear_probe(ready, "v", "label", max_iter=3, regParam=params["rate"])

    store = str(tmp_path / "trials")
    with pytest.raises(RuntimeError):
        train.search(fit, ready, "label", 2, SPACE, "s", n_trials=3, store=store)
    assert spark.read.json(store).count() == 2
    del ran[:]
    done = train.search(lambda p: fit(p, False), ready, "label", 2, SPACE, "s", n_trials=3, store=store)
    assert done.count() == 3 and [r["rate"] for r in ran] == [last]
    ready.unpersist()
