import random

import odd
from hypothesis import given, settings
from hypothesis import strategies as st

from notemill.llm import decontam as d
from notemill.llm.queries import QUERIES


def brute_distance(item, text):
    """Least edits of ``item`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(deadline=None, max_examples=80)
@given(st.text("ab", min_size=1, max_size=12), st.text("abc", max_size=20))
def test_alignment_against_full_table(item, text):
    a, t = d.folded(item), d.folded(text)
    found = d.align(a, t, -len(item), len(text), len(item))
    assert found and found[2] == brute_distance(item, text)
    start, end, edits = found
    assert 0 <= start <= end <= len(text) and brute_distance_whole(item, text[start:end]) == edits


def brute_distance_whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_grams_are_equal_for_equal_runs_only():
    points = d.folded("abcdefghij-abcdefghij")
    code = d.grams(points, 10)
    assert len(code) == len(points) - 9 and code[0] == code[11] and len(set(code.tolist())) == len(code) - 1


def planted(rng, item, edits):
    text = list(item)
    for _ in range(edits):
        k = rng.randrange(len(text))
        what = rng.randrange(3)
        if what == 0:
            text[k] = "Z"
        elif what == 1:
            del text[k]
        else:
            text.insert(k, "Q")
    return "".join(text)


def test_every_item_within_the_budget_is_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("etaoins", k=rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randrange(10, 60))) for i in range(12)]
    docs, want = [], {}
    for i in range(60):
        k = rng.randrange(12)
        budget = d.budget(len(items[k][1]))
        edits = rng.choice([0, 1, budget // 2, budget, 4 * budget + 8])
        docs.append((i, prose(40) + " " + planted(rng, items[k][1], edits).upper().replace(" ", "\n") + " " + prose(30)))
    docs.append((60, prose(500)))
    fold = lambda t: t.lower().replace("\n", " ")
    for i, text in docs:
        for k, item in items:
            n = brute_distance(fold(item), fold(text))
            if n <= d.budget(len(item)):
                want[i, k] = n
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (d.INDEX_CHARS, 700):
        rows = d.mark(frame, bench, index_chars=size).collect()
        got = {(r["doc_id"], x["item_id"]): x["edits"] for r in rows for x in r["leaks"]}
        assert got == want
        for r in rows:
            for x in r["leaks"]:
                assert brute_distance_whole(fold(dict(items)[x["item_id"]]), fold(r["text"][x["start"] : x["end"]])) == x["edits"]


def test_query_finds_the_exact_passages(spark, sf, documents):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontamination"](spark, sf).collect()}
    exact = {(i, k) for i, text in documents[1] for k, item in bench.items() if item in text}
    assert exact and exact <= got
    texts = dict(documents[1])
    for i, k in got - exact:
        assert brute_distance(d.folded(bench[k]).tolist(), d.folded(texts[i]).tolist()) <= d.budget(len(bench[k]))


def test_odd_rows(spark):
    docs = odd.odd(spark)
    item = "long winded text of many words long winded text of many words"
    items = [(1, item), (2, None), (3, ""), (4, "no id here"), (5, item), (None, item)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = d.mark(docs, bench).collect()
    assert len(rows) == len(odd.TEXTS) and sorted(rows[0].asDict()) == sorted(docs.columns)
    assert {r["doc_id"] for r in rows if r["leaks"]} == {4}
    assert {x["item_id"] for r in rows for x in r["leaks"]} == {1, 5}
    assert d.mark(odd.none(spark), bench).count() == 0
    assert all(not r["leaks"] for r in d.mark(docs, bench.filter("false")).collect())


def test_short_and_unnamed_items_and_other_alphabets(spark):
    long = "an item of well over forty characters that nobody has named"
    items = [(1, "tiny"), (2, "ab"), (3, "twelve chars"), (None, long), (4, "Το γρήγορο καφέ αλεπούδι πηδάει πάνω από το σκυλί ΟΔΥΣΣΕΥΣ"),
             (5, "Съешь же ещё этих мягких французских булок, да выпей чаю"), (6, " \t"), (7, "")]
    docs = [(1, "so TINY it is"), (2, "cab"), (3, "a b"), (4, "with Twelve\nCHARS, twelve chars"), (5, "x " + long.upper()),
            (6, "x " + items[4][1].upper()), (7, "y " + items[5][1].upper()), (8, "y " + items[4][1].lower() + " z"), (9, "twelve-chars")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (d.INDEX_CHARS, 30):
        got = {r["doc_id"]: [(x["item_id"], x["start"], x["end"], x["edits"]) for x in r["leaks"]]
               for r in d.mark(frame, bench, index_chars=size, min_chars=0).collect()}
        assert got[1] == [(1, 3, 7, 0)] and got[2] == [(2, 1, 3, 0)] and got[3] == [] and got[9] == []
        assert got[4] == [(3, 5, 17, 0), (3, 19, 31, 0)]
        (unnamed,) = got[5]
        assert unnamed[0] < 0 and unnamed[1:] == (2, 2 + len(long), 0)
        assert [x[0] for x in got[6]] == [4] == [x[0] for x in got[8]] and got[6][0][3] == 0 == got[8][0][3]
        assert [x[0] for x in got[7]] == [5] and got[7][0][3] == 0
    assert [r["doc_id"] for r in d.mark(frame, bench).collect() if r["leaks"]] == [5, 6, 7, 8]
