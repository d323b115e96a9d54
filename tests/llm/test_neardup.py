import random
import re
from collections import Counter, defaultdict

import odd
import pytest

from notemill.llm import neardup
from notemill.llm.components import components
from notemill.llm.queries import QUERIES
from notemill.llm.scratch import Scratch

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = defaultdict(list)
    for i in sorted(sets):
        shared = Counter()
        for s in sets[i]:
            shared.update(index[s])
            index[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def check(result, rows, width, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in result.collect()}
    assert got == brute(rows, width, percent)


def test_query_against_brute_force(spark, sf, documents):
    check(QUERIES["op5_near_dup"](spark, sf), documents[1], 3, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_chains_and_families(spark, percent):
    """Chains whose ends are unlike, and copies around the threshold that no hub settles alone."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for _ in range(4):
        text = [word() for _ in range(120)]
        for _ in range(15):
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
            text = list(text)
            text[rng.randrange(120)] = word()
            text[rng.randrange(120)] = word().upper()
    base = [word() for _ in range(150)]
    for _ in range(60):
        text = list(base)
        for _ in range(rng.randrange(1, 7)):
            text[rng.randrange(150)] = word()
        rows.append((2000 + len(rows), " ".join(text)))
    assert len({i for i, _ in rows}) == len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(neardup.near_duplicates(docs, width=3, percent=percent), rows, 3, percent)


def test_settling_block_against_block(spark, monkeypatch):
    """Links that only meet across blocks of a crowded bucket are found."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(100)]
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(5):
            text[rng.randrange(100)] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(neardup.near_duplicates(docs, width=2, percent=75), rows, 2, 75)


def test_components_against_union_find(spark, tmp_path):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    loops_only = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges + edges[:20], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {i: find(i) for i in root if i not in loops_only}


def test_odd_rows(spark):
    rows = neardup.near_duplicates(odd.odd(spark)).collect()
    assert len(rows) == len(odd.TEXTS)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    for i in (1, 2, 3):
        assert by[i] == [(0, i, True)]
    assert by[5] == [(2, 5, True)] and by[6] == [(2, 5, False)] * 2
    assert by[7] == [(1, 7, True)] and by[8] == [(1, 8, True)]
    assert sorted(by[None]) == [(0, None, True), (1, None, True)]
    assert neardup.near_duplicates(odd.none(spark)).count() == 0


def test_joins_that_grow_with_the_documents_are_not_broadcast(spark, sf, monkeypatch):
    """An exploded table is rated without its factor, and stored ids by their compressed size."""
    plans, table = {}, Scratch.table

    def seen(self, df, name):
        plans[name] = plan_of(df)
        return table(self, df, name)

    monkeypatch.setattr(Scratch, "table", seen)
    plans["result"] = plan_of(QUERIES["op5_near_dup"](spark, sf))
    names = ["met", "named", "stars-1", "result"]
    assert all("SortMergeJoin" in plans[n] for n in names)
    assert not [n for n in names if "Broadcast" in plans[n]]


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
