"""Samples, splits, ranks and running totals."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from notemill.operators import ordered, sampling


def key(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_few_shot(spark):
    rows = [(i, 0) for i in range(5)] + [(i, 1) for i in range(5, 7)] + [(9, None)]
    df = spark.createDataFrame(rows, "id int, label int")
    got = sampling.few_shot(df, "label", 3, "id").collect()
    zeros = sorted((i for i in range(5)), key=key)[:3]
    assert sorted(r["id"] for r in got) == sorted(zeros + [5, 6])


def test_few_shot_hot_class(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 7).alias("label"), F.lit("w").alias("wide"))
    rows = df.collect()
    expected = set()
    for label in {r["label"] for r in rows}:
        ids = sorted((r["id"] for r in rows if r["label"] == label), key=lambda i: (key(i), i))
        expected |= set(ids[:20])
    got = sampling.few_shot(df, "label", 20, "id")
    assert {r["id"] for r in got.collect()} == expected
    assert got.columns == df.columns or set(got.columns) == set(df.columns)


def test_few_shot_splits_never_touch_test(spark):
    df = spark.range(60).select("id", (F.col("id") % 2).alias("y"), F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    got = sampling.few_shot_splits(df, "y", "id", train_n=2, eval_n=3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 4, "validation": 6, "test": 20}


@pytest.mark.parametrize("n,train", [(20, 18), (9, 8), (1, 0)])
def test_group_split(spark, n, train):
    df = spark.range(n * 3).select((F.col("id") % n).alias("g"))
    split = sampling.group_split(df, "g").collect()
    chosen = {r["g"] for r in split if r["split"] == "train"}
    assert chosen == set(sorted(range(n), key=key)[:train])
    assert len(split) == n


def test_group_split_by_site(spark):
    df = spark.createDataFrame([(s, g) for s in "ab" for g in range(10 if s == "a" else 21)], "site string, g int")
    split = sampling.group_split(df, "g", by="site").groupBy("site", "split").count().collect()
    assert {(r["site"], r["split"]): r["count"] for r in split} == {
        ("a", "train"): 9, ("a", "validation"): 1, ("b", "train"): 18, ("b", "validation"): 3,
    }


def test_halves_are_disjoint_and_odd_goes_to_second(spark):
    got = sampling.halve_split(spark.range(7), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"validation": 3, "test": 4}


def test_hash_rank_is_whole_order(spark):
    df = spark.range(3000).select("id", F.lit("x").alias("keep"))
    rows = ordered.hash_rank(df, ["id"], seed=7, hex_digits=1).orderBy("rank").collect()
    assert [r["id"] for r in rows] == sorted(range(3000), key=lambda i: (key(i, 7), i))
    assert [r["rank"] for r in rows] == list(range(1, 3001))
    assert rows[0]["total"] == 3000 and rows[0]["keep"] == "x"


def test_running(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randint(0, 9) if rng.random() > 0.1 else None) for g in "ab" for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    for inclusive in (True, False):
        out = ordered.running(
            df, ["g"], ["i"], F.floor(F.col("i") / 16),
            {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("count", F.lit(1))}, inclusive,
        )
        got = {(r["g"], r["i"]): (r["s"], r["m"], r["n"]) for r in out.collect()}
        for g in "ab":
            seen = []
            for _, i, v in sorted(r for r in rows if r[0] == g):
                upto = seen + [v] if inclusive else seen
                known = [x for x in upto if x is not None]
                assert got[(g, i)] == (sum(known), max(known) if known else None, len(upto))
                seen.append(v)


def test_quantile_bucket_follows_order(spark):
    df = spark.range(2000).select((F.rand(1) * F.rand(2)).alias("v")).unionAll(spark.range(500).select(F.lit(0.5)))
    rows = ordered.quantile_bucket(df, "v", 16).orderBy("v").collect()
    buckets = [r["__bucket"] for r in rows]
    assert buckets == sorted(buckets) and len(set(buckets)) > 8
    same = ordered.quantile_bucket(spark.range(10).select(F.lit(1.0).alias("v")), "v", 4)
    assert same.select("__bucket").distinct().count() == 1


def test_merge_and_preview(spark):
    a = spark.createDataFrame([(1, "x")], "id int, text string")
    b = spark.createDataFrame([(2, "y", "z")], "id int, text string, more string")
    rows = {(r["corpus"], r["id"], r["more"]) for r in sampling.merge_corpora({"a": a, "b": b}).collect()}
    assert rows == {("a", 1, None), ("b", 2, "z")}
    second = sorted(range(50), key=key)[1]
    assert sampling.preview_row(spark.range(50), "id").first()["id"] == second
    assert [r["id"] for r in sampling.take(spark.range(9), 2, "id").collect()] == [0, 1]


def test_sizes(spark):
    df = spark.createDataFrame([("train", "a", 0), ("train", "a", 1), ("test", "b", 5)], "split string, doc string, y int")
    assert sampling.class_count(df, "y").first()["n_classes"] == 2
    got = {tuple(r) for r in sampling.split_sizes(df, "doc", "n_sentences").collect()}
    assert got == {("train", 1, 2), ("test", 1, 1)}
    assert sampling.split_sizes(df).count() == 2


def test_running_sums_follow_doubles_and_start_no_job(spark):
    values = [0.0, -0.5, 0.5, 1e-310, -1e-310, 1.0, 1.0 + 2**-52, 0.999999, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), 3.5, 0.75]
    rows = [(g, v, k + 1) for g in ("a", "b") for k, v in enumerate(values)] + [("a", 0.9 + k * 1e-9, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy-sums", "")
    out = ordered.running_sums(df, ["g"], "v", {"below": F.col("n")})
    assert tracker.getJobIdsForGroup("lazy-sums") in ([], ())
    got = [(r["g"], str(r["v"]), r["below"]) for r in out.collect()]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = []
    for g in ("a", "b"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] != r[1], r[1]))
        total = 0
        for _, v, n in mine:
            want.append((g, str(v), total))
            total += n
    assert sorted(got) == sorted(want)


def test_dense_codes(spark):
    df = spark.createDataFrame([(f"t{k % 700:04d}",) for k in range(3000)] + [("O",)] * 5, "tag string").repartition(6)
    got = {r["tag"]: r["tag_id"] for r in ordered.dense_codes(df, "tag", "tag_id", first=F.col("tag") == "O").collect()}
    assert got == {"O": 0, **{f"t{k:04d}": k + 1 for k in range(700)}}
    assert ordered.dense_codes(df.limit(0), "tag", "tag_id").collect() == []


def test_halves_spread_rows_without_an_id(spark):
    df = spark.createDataFrame([(None if k % 2 else k, k) for k in range(200)], "id int, k int")
    got = sampling.halve_split(df, "id").collect()
    assert sorted(r["k"] for r in got) == list(range(200)) and len({r["split"] for r in got if r["id"] is None}) == 1
