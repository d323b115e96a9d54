"""Vocabulary, encoding, alignment, padding."""

import pytest
from pyspark.sql import functions as F

from notemill.operators import encode as en


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_vocab(spark):
    rows = en.build_vocab(docs(spark, "b a b. a a", "c"), "text", size=3).orderBy("token_id").collect()
    assert [(r["token"], r["token_id"]) for r in rows] == [
        ("[PAD]", 0), ("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3), ("a", 4), ("b", 5), (".", 6),
    ]
    rare = en.build_vocab(docs(spark, "b a b. a a", "c"), "text", size=9, min_count=2).count()
    assert rare == 6
    with pytest.raises(ValueError, match="too large"):
        en.build_vocab(docs(spark, "a"), "text", size=10**9)


def test_encode_and_decode(spark):
    vocab = [*en.SPECIALS, "a", "b", "."]
    df = en.encode_text(docs(spark, "a b.", "zz a", "", "a a a a a"), "text", vocab, max_length=5)
    rows = {r["id"]: (r["input_ids"], r["n_pieces"]) for r in df.collect()}
    assert rows == {0: ([2, 4, 5, 6, 3], 3), 1: ([2, 1, 4, 3], 2), 2: ([2, 3], 0), 3: ([2, 4, 4, 4, 3], 5)}
    back = {r["id"]: r["decoded"] for r in en.decode(df, "input_ids", vocab).collect()}
    assert back[0] == "[CLS] a b . [SEP]" and back[1] == "[CLS] [UNK] a [SEP]"
    report = en.truncation_report(df, "n_pieces", 5).first()
    assert (report["n_rows"], report["n_cut"], report["share_cut"], report["max_pieces"], report["pieces_lost"]) == (4, 1, 0.25, 5, 2)


def test_subwords(spark):
    vocab = [*en.SPECIALS, "play", "##ing", "##s", "p", "##l", "a"]
    df = en.encode_text(docs(spark, "playing plays pl a", "pq a"), "text", vocab, subwords=True)
    rows = {r["id"]: r["input_ids"] for r in df.collect()}
    assert rows == {0: [2, 4, 5, 4, 6, 7, 8, 9, 3], 1: [2, 1, 9, 3]}
    assert en.decode(df.filter("id = 0"), "input_ids", vocab).first()["decoded"] == "[CLS] playing plays pl a [SEP]"


def test_piece_vocab_covers_its_corpus(spark):
    corpus = docs(spark, "alpha alphabet beta", "beta bet")
    vocab = en.vocab_list(en.build_piece_vocab(corpus, "text", 500))
    coded = en.encode_text(corpus, "text", vocab, subwords=True)
    assert coded.filter(F.array_contains("input_ids", en.UNK)).count() == 0
    unseen = en.encode_text(docs(spark, "alphabeta"), "text", vocab, subwords=True).first()
    assert en.UNK not in unseen["input_ids"] and unseen["n_pieces"] > 1


@pytest.mark.parametrize("a,b,kept", [(5, 5, (3, 2)), (1, 9, (1, 4)), (9, 1, (4, 1)), (2, 3, (2, 3)), (0, 9, (0, 5))])
def test_pair_budget(spark, a, b, kept):
    got = spark.range(1).select(*en.pair_budget(F.lit(a), F.lit(b), 8)).first()
    assert tuple(got) == kept


def test_pair_budget_is_one_by_one_removal(spark):
    df = spark.range(20).select(F.col("id").cast("int").alias("a")).crossJoin(spark.range(20).select(F.col("id").cast("int").alias("b")))
    ka, kb = en.pair_budget(F.col("a"), F.col("b"), 14)
    for row in df.select("a", "b", ka.alias("ka"), kb.alias("kb")).collect():
        a, b = row["a"], row["b"]
        while a + b > 11:
            if a > b:
                a -= 1
            else:
                b -= 1
        assert (row["ka"], row["kb"]) == (a, b), row


def test_encode_pair(spark):
    vocab = [*en.SPECIALS, "a", "b"]
    df = spark.createDataFrame([("a a a a", "b b b")], "x string, y string")
    assert en.encode_pair(df, "x", "y", vocab, max_length=8).first()["input_ids"] == [2, 4, 4, 4, 3, 5, 5, 3]


def test_words_and_alignment(spark):
    vocab = [*en.SPECIALS, "ab", ".", "c"]
    df = spark.createDataFrame([(["ab.", "c"], [5, 7])], "tokens array<string>, ner_tags array<int>")
    row = en.encode_ner(df, vocab).first()
    assert row["input_ids"] == [2, 4, 5, 6, 3]
    assert row["word_ids"] == [None, 0, 0, 1, None]
    assert row["piece_labels"] == [-100, 5, 5, 7, -100]
    assert en.encode_ner(df, vocab, first_piece_only=True).first()["piece_labels"] == [-100, 5, -100, 7, -100]
    short = en.encode_ner(df, vocab, max_length=4).first()
    assert short["word_ids"] == [None, 0, 0, None] and short["piece_labels"] == [-100, 5, 5, -100]


def test_padding(spark):
    df = spark.createDataFrame(
        [(i, [7] * (i % 5 + 1), [1] * (i % 5 + 1)) for i in range(11)], "id int, input_ids array<int>, piece_labels array<int>"
    )
    rows = en.pad_batches(df, 4, "id", label_arrays=["piece_labels"]).collect()
    assert len(rows) == 11
    batches = {}
    for r in rows:
        assert len(r["input_ids"]) == len(r["attention_mask"]) == len(r["piece_labels"]) == r["padded_len"]
        real = r["id"] % 5 + 1
        assert r["attention_mask"] == [1] * real + [0] * (r["padded_len"] - real)
        assert r["piece_labels"][real:] == [-100] * (r["padded_len"] - real)
        batches.setdefault(r["batch_id"], []).append(real)
    assert sorted(len(b) for b in batches.values()) == [3, 4, 4]
    assert all(max(b) == next(r["padded_len"] for r in rows if r["batch_id"] == k) for k, b in batches.items())


def test_batches_are_even_where_ids_repeat_or_are_missing(spark):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, k) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, k int").withColumn("input_ids", F.array_repeat(F.lit(5), F.col("k") % 4 + 1)).repartition(5)
    got = en.pad_batches(df, 16, "id").collect()
    assert sorted(r["k"] for r in got) == list(range(400))
    sizes = {}
    for r in got:
        sizes.setdefault(r["batch_id"], []).append(r)
    assert sorted(sizes) == list(range(25)) and all(len(b) == 16 for b in sizes.values())
    assert all(len({r["padded_len"] for r in b}) == 1 == len({len(r["input_ids"]) for r in b}) for b in sizes.values())
    # Rows of one id follow each other: it lies in as few batches as hold it.
    assert len({r["batch_id"] for r in got if r["id"] == 7}) <= 133 // 16 + 2


def greedy(word, known):
    out, at = [], 0
    while at < len(word):
        ends = [e for e in range(at + 1, len(word) + 1) if ("##" if at else "") + word[at:e] in known]
        if not ends:
            return [en.UNK]
        out.append(known[("##" if at else "") + word[at:max(ends)]])
        at = max(ends)
    return out


def test_subwords_against_brute_force(spark):
    import random

    rng = random.Random(11)
    parts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(14)}
    vocab = [*en.SPECIALS, *sorted(parts), *sorted("##" + p for p in parts if rng.random() < 0.7)]
    known = {t: i for i, t in enumerate(vocab)}
    rows = [[ "".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 8))] for _ in range(60)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, tokens array<string>")
    for got in en.encode_words(df, "tokens", vocab, subwords=True).collect():
        pieces = [greedy(w, known) for w in rows[got["id"]]]
        assert got["input_ids"] == [en.CLS, *[x for p in pieces for x in p], en.SEP]
        assert got["word_ids"][1:-1] == [i for i, p in enumerate(pieces) for _ in p]
