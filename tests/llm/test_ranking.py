import math
import re
from collections import Counter

import numpy as np
import odd
import pytest

from notemill.llm import ranking
from notemill.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, k=10):
    """(number of the item, rank, id, score) by the definition, pair by pair."""
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lower(text))) if t in c)
            if s > 0:
                rows.append((-s, i is None, i if i is not None else 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_query_against_the_definition(spark, sf, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(QUERIES["op13_ranked_search"](spark, sf)) == plain(documents[1], items)


@pytest.mark.parametrize("slice_chars", [20, 300, 8_000_000])
def test_ties_repeats_and_slices(spark, slice_chars, monkeypatch):
    rng = np.random.default_rng(5)
    pool = ["alpha", "Beta", "gamma", "straße", "çа", "x1", "9", "ÄB", "delta"]
    docs = [(int(i) if i % 50 else None, " ".join(rng.choice(pool, rng.integers(0, 6)))) for i in range(400)]
    docs += [(1000 + i, "alpha,beta; same") for i in range(300)] + [(7, None), (8, "--"), (9, "alpha " * 5000)]
    items = [(k % 3, " ".join(rng.choice(pool, 4))) for k in range(9)] + [(20, ""), (21, None), (22, "unseen"), (None, "alpha beta"), (24, "same SAME alpha")]
    for name, size in (("DOC_TILE", 32), ("ITEM_TILE", 4), ("TERM_TILE", 2)):
        monkeypatch.setattr(ranking, name, size)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert got(ranking.search(d, i, k=7, slice_chars=slice_chars)) == plain(docs, items, 7)


def test_vocabulary_tiles_keep_sums_exact():
    weight = np.full(40, 1 << 32, np.int64)
    (tile,) = ranking.item_tiles([(0, list(range(40)))], weight)
    assert all(len(t) * (1 << 32) * ranking.IMPACT < ranking.EXACT for t in tile.terms) and len(tile.terms) > 1
    impacts = np.full(40, 999_983, np.int64)
    assert ranking.scores(np.array([0, 40]), np.arange(40), impacts, tile)[0, 0] == 40 * (1 << 32) * 999_983


def test_equal_hashes_are_compared_by_letters():
    vocabulary = ranking.Vocabulary.of([b"alpha", b"beta"])
    data = np.frombuffer(b"alpha gamma", np.uint8)
    vocabulary.hashes[:] = np.sort(ranking.word_hashes(data, np.array([0, 6]), np.array([5, 5]), space=ranking._BREAK))
    vocabulary.starts[:], vocabulary.lengths[:] = 0, 5
    assert (vocabulary.find(data, np.array([0, 6]), np.array([5, 5])) >= 0).tolist() == [True, False]


def test_terms_are_those_of_the_pattern():
    text = "Ab\x00C-d9_ÄÖ x\x7fy`z{q Straße Ÿ𝔘 \U0001f600"
    assert [t.decode() for t in ranking.terms(text)] == TERM.findall(lower(text))


def test_odd_rows(spark):
    docs = odd.odd(spark).withColumnRenamed("place", "Rank").withColumnRenamed("node", "ITEM")
    items = spark.createDataFrame([(1, "one TWO", 5), (2, "words of no id", 6)], "item_id long, text string, doc_id long")
    assert got(ranking.search(docs, items)) == plain([(i, t) for i, t, _ in odd.TEXTS], [(1, "one TWO"), (2, "words of no id")])
    assert got(ranking.search(odd.none(spark), items)) == [] and got(ranking.search(docs, items.limit(0))) == []


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two")], "name string, body string")
    items = spark.createDataFrame([("q", "two")], "item string, body string")
    rows = got(ranking.search(docs, items, id_col="name", text_col="body", item_col="item", item_text_col="body"))
    assert [r[:3] for r in rows] == [] or [r[2] for r in sorted(rows, key=lambda r: r[1])] == ["a", "b", None]
