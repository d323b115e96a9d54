"""Extra columns: names that differ in letter case only, working names, and maps, arrays and structs."""

import corpus_pipeline
import odd
import pytest

from notemill.llm import chat, decontam, licenses, mixing, neardup, ordermin, quality, ranking, repair, secrets, sharding, suffixes, tokenids
from notemill.runtime import fresh_path

CLASHES = [
    "Shard", "Score", "Leaks", "Findings", "License", "PLACE", "Row", "Slot", "Size", "Text_CRC32", "__text", "__same1", "__row", "__dir", "__line",
    "__key", "__n", "__block", "__draw", "__source", "__leaks", "__score", "id", "node", "key", "Tie", "Kept_", "a.b", "c`d",
]


@pytest.fixture(scope="module")
def wide(spark):
    """Rows of ``odd`` with clashing columns and nested ones."""
    nested = "map<string,int>", "array<map<int,string>>", "struct<m:map<string,int>,x:int>"
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in CLASHES)
    schema += ", " + ", ".join(f"nested{k} {kind}" for k, kind in enumerate(nested))
    row = lambda i, t, s: (i, t, s, *[f"own {c}" for c in CLASHES], {"x": 1, "y": 2}, [{1: "p"}, None], ({"z": 3}, 4))
    return spark.createDataFrame([row(*x) for x in odd.TEXTS], schema)


def untouched(rows, gone=()):
    """All columns but those that give way came through as they were."""
    gone = {c.lower() for c in gone}
    for r in rows:
        for c in CLASHES:
            if c.lower() not in gone:
                assert r[c] == f"own {c}"
        assert r["nested0"] == {"x": 1, "y": 2} and r["nested1"] == [{1: "p"}, None] and r["nested2"] == ({"z": 3}, 4)


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, 0), (6, 1), (7, 0), (8, 0)], "doc_id long, quality int")


BENCH = [(1, "long winded text of many words long winded text"), (2, "one two three four five six")]


def test_operators_that_carry_columns(spark, wide):
    n = len(odd.TEXTS)
    got = sharding.write(sharding.shard(wide, shards=3), fresh_path(spark, "t")).collect()
    untouched(got, ("size", "text_crc32", "row", "shard", "slot"))
    assert len(got) == n and sorted(r["row"] for r in got) == list(range(n))
    got = quality.score(wide, quality.train(wide, labels(spark))).collect()
    untouched(got, ("score",))
    assert len(got) == n and all(0 < r["score"] < 1 for r in got)
    for size in (10**6, 30):  # one slice, and several
        got = decontam.mark(wide, spark.createDataFrame(BENCH, "item_id long, text string"), index_chars=size, min_chars=0).collect()
        untouched(got, ("leaks",))
        assert len(got) == n and sum(bool(r["leaks"]) for r in got) == 4
    got = secrets.scan(wide, secrets.fit([])).collect()
    untouched(got, ("findings",))
    assert len(got) == n and all(r["findings"] == [] for r in got)
    got = licenses.scan(wide, path_col="__dir").collect()
    untouched(got, ("license",))
    assert len(got) == n and all(r["license"] is None for r in got)
    mixture = mixing.mix(wide)
    got = mixing.write(mixture.mixed, fresh_path(spark, "t")).collect()
    untouched(got, ("shard", "place"))
    assert len(got) and mixing.taken(mixture.rows, mixing.write(mixture.mixed, fresh_path(spark, "t"))).count() == n


def test_operators_that_return_their_own_columns(spark, wide):
    plain = wide.select("doc_id", "text", "source")
    rows = lambda df: sorted(map(str, df.collect()))
    for run in (neardup.near_duplicates, lambda d: suffixes.remove_repeats(d, length=200), ordermin.fingerprints):
        assert rows(run(wide)) == rows(run(plain))
    import public_tokenizers

    folder = fresh_path(spark, "t")
    tokenids.write(wide, folder, public_tokenizers.path("word_bpe_49k.json"))
    assert tokenids.read(spark, folder).count() == len(odd.TEXTS)
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    assert rows(ranking.search(wide, items, k=3)) == rows(ranking.search(plain, items, k=3))


def test_conversations(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "Hi.", "a", "b", {"x": 1}), (1, 1, "assistant", "Yes.", "a", "b", None)],
        "conv_id long, turn long, role string, text string, PART string, __at string, m map<string,int>",
    )
    plain = turns.select("conv_id", "turn", "role", "text")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(chat.format_turns(turns)) == rows(chat.format_turns(plain))
    assert rows(repair.repair(turns).rows) == rows(repair.repair(plain).rows)


def test_pipeline_stages(spark, sf, wide):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns
        untouched(out.collect())


def test_a_row_that_repeats_in_a_third_of_the_table(spark):
    rows = [(7, "the same row", "a")] * 10_000 + [(k, f"row {k}", "b") for k in range(100, 20_100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    placed = sharding.shard(docs, shards=4)
    got = placed.select("doc_id", "row", "shard", "slot").collect()
    assert sorted(r["row"] for r in got) == list(range(30_000)) and sum(r["doc_id"] == 7 for r in got) == 10_000
    assert {(r["shard"], r["slot"]) for r in got} == {(k % 4, k // 4) for k in range(30_000)}
    import public_tokenizers

    folder = fresh_path(spark, "t")
    tokenids.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    parts = spark.read.parquet(f"{folder}/blocks").selectExpr("part", "size(ids) AS n").groupBy("part").sum("n").collect()
    assert max(r[1] for r in parts) < 12_000 and len(parts) == 4  # even ranges, though one id and text has a third
    back = [(r["start"], r["n_tokens"]) for r in tokenids.read(spark, folder).orderBy("start").collect()]
    assert len(back) == 30_000 and all(a[0] + a[1] == b[0] for a, b in zip(back, back[1:]))
    prints = ordermin.fingerprints(docs).filter("doc_id = 7").select("fingerprint", "near_next").collect()
    assert len({r[0] for r in prints}) == 1 and sum(r[1] == 1.0 for r in prints) >= 9_999
