import zlib

import numpy as np
import odd

from notemill.llm import quality
from notemill.llm.queries import QUERIES


def auc(good, bad):
    return float((np.array(good)[:, None] > np.array(bad)[None]).mean())


def test_held_out_rows_are_ranked(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op10_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(rows[r["doc_id"]]["score"], r["quality"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    assert auc([s for s, q in held if q], [s for s, q in held if not q]) > 0.95
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 < r["score"] < 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    size = quality.BUCKETS + quality.N_DENSE
    model = quality.Model(
        0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)), rng.normal(size=quality.N_DENSE), np.ones(quality.N_DENSE)
    )
    texts = [b"a b a c|d!! E", b"", b"one two two"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    distinct, bucket, value, dense = quality.features(data, offsets)
    got = quality.logits(model, distinct, bucket, value, dense)
    edges = np.concatenate([[0], np.cumsum(distinct)])
    for t in range(3):
        x = {int(b): v for b, v in zip(bucket[edges[t] : edges[t + 1]], value[edges[t] : edges[t + 1]])}
        x |= {quality.BUCKETS + j: v for j, v in enumerate(np.clip(dense[t] - model.mean, -5, 5) * 0.5)}
        keys = sorted(x)
        want = model.w0 + sum(model.w[k] * x[k] for k in keys)
        want += sum(model.v[a] @ model.v[b] * x[a] * x[b] for i, a in enumerate(keys) for b in keys[i + 1 :])
        assert np.isclose(got[t], want)


def test_labels_of_held_out_rows_do_not_matter(spark, documents):
    docs = documents[0]
    ids = [i for i, _ in documents[1]]
    rows = [(i, i % 2) for i in ids]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in rows]
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (rows, flipped))
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()


def test_odd_rows(spark):
    docs = odd.odd(spark)
    labels = spark.createDataFrame([(5, 1), (5, 0), (4, 0), (None, 1), (7, None), (99, 1), (8, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(odd.TEXTS) and all(0 < r["score"] < 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert sorted(rows[0].asDict()) == sorted(docs.columns)
    empty = quality.train(odd.none(spark), labels)
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(odd.none(spark), model).count() == 0
    assert quality.train(docs, labels.filter("false")).w0 == 0.0


def test_one_row_an_id_comes_to_the_driver(spark, documents, monkeypatch):
    docs = documents[0].select("doc_id", "text").limit(40)
    ids = [r["doc_id"] for r in docs.collect()]
    hot = next(i for i in ids if zlib.crc32(str(i).encode()) % 5)
    many = docs.unionByName(spark.range(300).selectExpr(f"{hot}L AS doc_id", "concat('text number ', id) AS text"))
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    sizes, collect = [], type(docs).collect

    def counted(frame):
        rows = collect(frame)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(type(docs), "collect", counted)
    a = quality.train(many, labels)
    b = quality.train(many.repartition(7), labels)
    assert max(sizes) <= len(ids) and (a.w == b.w).all() and (a.v == b.v).all()
