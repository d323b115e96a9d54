from collections import Counter, defaultdict
from math import comb

import odd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from notemill.llm import mixing
from notemill.llm.queries import QUERIES
from notemill.llm.scratch import Scratch


def filled(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not full:
            target.update({s: weight[s] * level for s in open_})
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_query_against_brute_force(spark, sf, documents):
    rows = QUERIES["op6_mixing"](spark, sf).collect()
    source = {r["doc_id"]: r["source"] for r in documents[0].select("doc_id", "source").collect()}
    sizes = defaultdict(int)
    for i, text in documents[1]:
        sizes[source[i]] += len(text.replace("\x0b", " ").replace("\x0c", " ").split(None)) if text else 0
    want = filled(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * len(r["draws"]) <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.05 * want[s]
    again = {(r["doc_id"], r["taken"]) for r in QUERIES["op6_mixing"](spark, sf).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


@pytest.mark.parametrize("n,k,m", [(10, 4, 5), (40, 39, 3), (6, 0, 3), (6, 6, 2), (1, 1, 0), (300, 120, 150)])
def test_hypergeometric_inverts_the_distribution(spark, n, k, m):
    total, below, steps = comb(n, m), 0.0, []
    for x in range(max(0, m + k - n), min(k, m) + 1):
        p = comb(k, x) * comb(n - k, m - x) / total
        if p > 1e-5:
            steps += [(below + p * 0.01, x), (below + p * 0.99, x)]
        below += p
    df = spark.createDataFrame(steps, "u double, x long").select(
        "x", mixing.hypergeometric(F.lit(n), F.lit(k), F.lit(m), F.col("u")).alias("got")
    )
    assert all(r["x"] == r["got"] for r in df.collect())


def test_tree_keeps_quotas_and_even_shards(spark):
    q = [700, 1, 0, 55, 1024]
    leaves = mixing.split_quotas(spark.createDataFrame([(q,)], "q array<long>"), 3, 1, Scratch(spark, "t")).collect()
    assert sorted(r["shard"] for r in leaves) == list(range(8))
    assert [sum(r["q"][i] for r in leaves) for i in range(5)] == q
    sums = [sum(r["q"]) for r in leaves]
    assert max(sums) - min(sums) <= 2 and min(x for r in leaves for x in r["q"]) >= 0


def test_mixed_rows_follow_the_plan(spark, documents):
    docs = documents[0]
    mixture = mixing.mix(docs)
    want = Counter({r["id"]: len(r["draws"]) for r in mixture.rows.collect()})
    rows = mixture.mixed.collect()
    assert Counter(r["doc_id"] for r in rows) == +want
    blocks = Counter()
    for r in mixture.plan.collect():
        for d in r["draws"]:
            blocks[d["shard"]] += 1
    assert max(blocks.values()) - min(blocks.values()) <= 3
    local = [(r["shard"], r["place"]) for r in mixing.shuffled(mixture.mixed).collect()]
    assert sorted(local) == local


def test_odd_rows(spark):
    docs = odd.odd(spark)
    mixture = mixing.mix(docs)
    rows = mixture.rows.collect()
    assert len(rows) == len(odd.TEXTS) and {r["size"] for r in rows if r["id"] in (1, 2, 3)} == {0}
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert set(mixture.mixed.columns) == set(docs.columns)
    sizes = {r["source"]: r["source_size"] for r in rows}
    want = filled(sizes)
    assert all(r["target"] == pytest.approx(want[r["source"]]) for r in rows)
    assert mixing.mix(odd.none(spark)).rows.count() == mixing.mix(odd.none(spark)).mixed.count() == 0


def test_no_python_on_the_main_path(spark, sf):
    plan = QUERIES["op6_mixing"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_taken_is_counted_in_the_written_shards(spark, tmp_path):
    rows = [(i, f"word {i} and some more", "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame([*rows, rows[0], rows[0], (1, "unlike text", "b")], "doc_id long, text string, source string")
    mixture = mixing.mix(docs, depth=1)
    written = mixing.write(mixture.mixed, f"{tmp_path}/mixed")
    for folder in tmp_path.glob("mixed/shard=*"):
        places = [x for file in sorted(folder.glob("*.parquet")) for x in pq.ParquetFile(file).read(["place"])["place"].to_pylist()]
        assert places == sorted(places)
    got = mixing.taken(mixture.rows, written).select("id", "size", "draws", "taken").collect()
    assert len(got) == docs.count() and all(r["taken"] == r["size"] * len(r["draws"]) for r in got)
    assert sum(r["taken"] for r in got) == written.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
