import random

import pyarrow as pa
import pytest

from notemill.operators import encode
from notemill.operators import subwords as sw


def words_of(spark, counts):
    return spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)


def merges_by_hand(counts, most, least=2):
    """Plain training: count all pairs anew for each merge."""
    state = {w: [w[0], *["##" + c for c in w[1:]]] for w in counts}
    out = []
    while len(out) < most:
        pairs = {}
        for w, parts in state.items():
            for a, b in zip(parts, parts[1:]):
                pairs[a, b] = pairs.get((a, b), 0) + counts[w]
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if n < least:
            break
        out.append((a, b, n))
        for parts in state.values():
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i : i + 2] = [a + b[2:]]
                i += 1
    return out, state


def corpus(seed, n, letters="abcd", longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(1, longest))): rng.randint(1, 40) for _ in range(n)}


@pytest.mark.parametrize("seed,letters,ahead,kept", [(1, "abcd", 8, 50_000), (2, "ab", 16, 50_000), (3, "abcdefgh", 8, 12), (4, "aé𝔘b", 5, 50_000)])
def test_merges_are_those_of_plain_training(spark, seed, letters, ahead, kept):
    counts = corpus(seed, 60, letters)
    got = sw.learn_merges(words_of(spark, counts), 40, ahead=ahead, kept=kept)
    want, state = merges_by_hand(counts, 40)
    assert [tuple(m) for m in got] == want
    vocab = sw.merge_vocab(words_of(spark, counts), got, encode.SPECIALS)
    table = sw.MergeTable(vocab, got, encode.UNK)
    ids = table.match(pa.array(sorted(counts)))
    assert [[vocab[i] for i in row] for row in ids.to_pylist()] == [state[w] for w in sorted(counts)]


def test_no_words_and_no_pairs(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert sw.learn_merges(none, 5) == [] and sw.merge_vocab(none, [], ["[PAD]"]) == ["[PAD]"]
    assert sw.learn_merges(words_of(spark, {"a": 9, "b": 3}), 5) == []


def test_unknown_and_empty_words():
    merges = [sw.Merge("a", "##b", 3)]
    table = sw.MergeTable(["[PAD]", "[UNK]", "a", "##b", "##a", "ab"], merges, 1)
    assert table.match(pa.array(["ab", "", "ax", "abab"[:3], None, "x"])).to_pylist() == [[5], [], [1], [5, 4], [], [1]]
    assert table.match(pa.array([], pa.string())).to_pylist() == []
    # Overlapping pairs are joined from the left.
    doubled = sw.MergeTable(["[PAD]", "[UNK]", "a", "##a", "##aa"], [sw.Merge("##a", "##a", 2)], 1)
    assert doubled.match(pa.array(["aaaa", "aaaaa"])).to_pylist() == [[2, 4, 3], [2, 4, 4]]


def longest(word, table):
    found, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in table), None)
        if end is None:
            return [encode.UNK]
        found.append(table[mark + word[at:end]])
        at = end
    return found


@pytest.mark.parametrize("seed", range(6))
def test_trie_against_longest_match_by_hand(seed):
    rng = random.Random(seed)
    letters = "abcé𝔘#"[: 3 + seed % 4]
    pieces = {"".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(60)} | {"##" + "".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(60)}
    tokens = [*encode.SPECIALS, *sorted(pieces)]
    table = {}
    for i, t in enumerate(tokens):
        table.setdefault(t, i)
    words = ["".join(rng.choices(letters + "x" * (k % 7 == 0), k=rng.randint(0, 14))) for k in range(500)]
    got = sw.Trie(tokens, encode.UNK).match(pa.array(words)).to_pylist()
    assert got == [longest(w, table) for w in words]


def test_trie_walks_whole_batches(monkeypatch):
    """The number of steps follows the longest word, not the number of words."""
    trie = sw.Trie([*encode.SPECIALS, "ab", "##ab", "##c"], encode.UNK)
    steps = 0

    class Counted:
        def __init__(self, a):
            self.a = a

        def __getitem__(self, k):
            nonlocal steps
            steps += 1
            return self.a[k]

    trie.base = Counted(trie.base)
    words = pa.array([f"ab{'abc' * (k % 4)}" for k in range(5000)])
    assert len(trie.match(words)) == 5000 and steps < 60


def test_lookups_keep_null_and_empty_rows(spark):
    df = spark.createDataFrame([(1, ["ab", "abab"]), (2, []), (3, None)], "k int, w array<string>")
    ids = sw.lookup(sw.Trie(["[PAD]", "[UNK]", "ab", "##ab"], 1))
    got = {r["k"]: r["i"] for r in df.select("k", ids("w").alias("i")).collect()}
    assert got[1] == [[2], [2, 3]] and not got[2] and not got[3]


def test_words_are_matched_and_handed_on_in_bounded_slices():
    import pyarrow as pa

    from notemill.operators import subwords

    trie = subwords.Trie(["[PAD]", "[UNK]", "a", "##b", "ab"], 1)
    words = pa.array([["ab", "abb", "x"] * 40_000] * 9 + [None, []], pa.list_(pa.string()))
    parts = list(subwords.coded_slices(trie, words))
    assert len(parts) > 1 and max(sum(len(r) for r in p.to_pylist()) for p in parts) <= 500_000
    flat = [r for p in parts for r in p.to_pylist()]
    assert len(flat) == 11 and flat[0][:3] == [[4], [4, 3], [1]] and flat[9:] == [[], []]


def test_trie_of_many_pieces_is_placed_in_bounded_time():
    import time

    from notemill.operators import subwords

    rng = random.Random(4)
    tokens = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüéñABCDEFGH", k=rng.randint(1, 4))) for _ in range(30_000)})
    began = time.process_time()
    trie = subwords.Trie(tokens, -1)
    assert time.process_time() - began < 5
    assert [r[0] for r in trie.match(pa.array(tokens)).to_pylist()] == list(range(len(tokens)))


def test_pair_sums_against_plain_counts():
    from notemill.operators import subwords

    rng = random.Random(6)
    words = ["".join(f"<{'##' if i else ''}{c}>" for i, c in enumerate(rng.choices("aäb😀", k=rng.randint(1, 6)))) for _ in range(200)]
    n = pa.array([rng.randint(1, 1 << 40) for _ in words])
    want = {}
    for word, times in zip(words, n.to_pylist()):
        parts = word[1:-1].split("><")
        for pair in zip(parts, parts[1:]):
            want[pair] = want.get(pair, 0) + times
    assert {(a, b): t for a, b, t in subwords._pair_sums(pa.array(words), n.to_numpy())} == want
    assert subwords._pair_sums(pa.array([], pa.string()), n.to_numpy()[:0]) == []
