import re
from collections import Counter, defaultdict

import odd
from test_decontam import brute_distance
from test_neardup import brute, plan_of

import corpus_pipeline as cp
from notemill.llm import decontam, mixing, quality
from test_mixing import filled
from test_tokenids import check


def test_stages_against_brute_force(spark, sf, documents):
    """Each stage on what its predecessor kept, beside a plain computation of the same."""
    docs = documents[0]
    columns = docs.columns
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "token_ids"]
    by = dict(cp.STAGES)
    texts = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    at = spark.conf.get("spark.checkpoint.dir") + "/pipeline-test"

    def staged(df, name):
        df.write.parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    good = staged(by["quality"](spark, docs, sf), "quality")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    assert texts(good) == [(i, t) for i, t in documents[1] if scores[i] >= 0.3] and good.columns == columns

    one = staged(by["near_duplicates"](spark, good, sf), "one")
    rows = texts(good)
    kept = brute(rows, 5, 80)
    assert texts(one) == [(i, t) for i, t in rows if kept[i][2]] and sorted(one.columns) == sorted(columns)

    clean = staged(by["decontamination"](spark, one, sf), "clean")
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left, rows = dict(texts(clean)), texts(one)
    fold = lambda t: "".join(map(chr, decontam.folded(t)))
    for i, t in rows:
        if i not in left:
            assert min(brute_distance(fold(b), fold(t)) - decontam.budget(len(b)) for b in bench) <= 0
        else:
            assert not any(fold(b) in fold(t) for b in bench)

    drawn = staged(by["mixing"](spark, clean, sf), "drawn")
    assert sorted(drawn.columns) == sorted(columns)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in left.items()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i in left:
        sizes[source[i]] += size[i]
    counts = Counter(i for i, _ in texts(drawn))
    assert max(counts.values()) <= 2 and set(counts) <= set(left)
    for i, n in counts.items():
        taken[source[i]] += n * size[i]
    for s, want in filled(sizes).items():
        assert abs(taken[s] - want) <= max(0.05 * want, 20)

    rows = by["token_ids"](spark, drawn, sf).collect()
    check(rows, texts(drawn))
    whole = sorted(tuple(r) for r in cp.run(spark, sf).collect())
    assert whole == sorted(tuple(r) for r in rows)


def test_odd_rows(spark, sf):
    docs = odd.odd(spark)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert sorted(out.columns) == sorted(docs.columns)
        rows = out.collect()
        if name == "near_duplicates":
            assert Counter(r["doc_id"] for r in rows) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1, 8: 1, None: 2}
        if name == "decontamination":
            assert len(rows) == len(odd.TEXTS)
        none = stage(spark, odd.none(spark), sf)
        assert none.count() == 0 and sorted(none.columns) == sorted(docs.columns)
    assert cp.token_ids(spark, docs, sf).count() == len(odd.TEXTS)


def test_rows_that_share_an_id_are_dropped_only_where_linked(spark, sf):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    near = prose(1) + " tail"
    rows = [
        (1, prose(1)), (1, prose(2)), (1, prose(3)), (2, near), (2, prose(4)), (3, prose(2)), (None, prose(5)), (None, prose(5)),
        (None, None), (None, None), (None, ""), (4, None), (4, None), (4, " "),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in cp.one_of_each(spark, docs, sf).collect())
    want = [(1, prose(1)), (1, prose(2)), (1, prose(3)), (2, prose(4)), (None, prose(5))]
    assert got == Counter([*want, *[r for r in rows if not (r[1] or "").strip()]])


def test_groups_and_runs_of_blocks_are_not_broadcast(spark, sf, monkeypatch):
    """Groups have a row for each document, and runs of blocks are exploded: Spark rates both too low."""
    plans, table = {}, cp.Scratch.table

    def seen(self, df, name):
        plans[name] = plan_of(df)
        return table(self, df, name)

    monkeypatch.setattr(cp.Scratch, "table", seen)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = plan_of(cp.one_of_each(spark, docs, sf))
    mixing.mix(docs)
    assert "SortMergeJoin [__key#" in kept and "Broadcast" not in plans["met"]
    assert "SortMergeJoin [rank#" in plans["plan"] and "Broadcast" not in plans["plan"]
