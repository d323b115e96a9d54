import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from notemill.operators import conll, structured
from notemill.operators.metrics import entity_scores

TAGS = ["O", "B-A", "B-B", "I-A", "I-B"]


def legal(path):
    return all(not t.startswith("I-") or (p not in ("O", None) and p[2:] == t[2:]) for p, t in zip([None, *path], path))


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_against_all_paths(seed):
    rng = np.random.default_rng(seed)
    lengths = np.array([1, 2, 4, 5])
    scores, steps = rng.normal(size=(4, 5, 5)), rng.normal(size=(6, 5))
    got = structured.viterbi(scores, lengths, np.where(structured.allowed(TAGS), steps, -1e30))
    for s, n in enumerate(lengths):
        paths = [p for p in itertools.product(range(5), repeat=int(n)) if legal([TAGS[i] for i in p])]
        best = max(paths, key=lambda p: sum(scores[s, t, i] for t, i in enumerate(p)) + sum(steps[a, b] for a, b in zip([5, *p], p)))
        assert tuple(got[s, :n]) == best


def test_likelihood_and_its_slopes_against_all_paths():
    rng = np.random.default_rng(3)
    lengths, gold = np.array([1, 3, 4]), np.array([[1, 0, 0, 0], [0, 2, 4, 0], [1, 3, 3, 0]])
    scores, steps = rng.normal(size=(3, 4, 5)), np.where(structured.allowed(TAGS), rng.normal(size=(6, 5)), -1e30)

    def loss(scores, steps):
        out = 0.0
        for s, n in enumerate(lengths):
            value = lambda p: sum(scores[s, t, i] for t, i in enumerate(p)) + sum(steps[a, b] for a, b in zip([5, *p], p))
            paths = [p for p in itertools.product(range(5), repeat=int(n)) if legal([TAGS[i] for i in p])]
            out += np.log(sum(np.exp(value(p)) for p in paths)) - value(gold[s, :n])
        return out

    got, nodes, edges = structured.likelihood(scores, lengths, steps, gold)
    assert got == pytest.approx(loss(scores, steps))
    for cell in [(0, 0, 1), (1, 2, 4), (2, 3, 0), (2, 1, 3)]:
        moved = scores.copy()
        moved[cell] += 1e-6
        assert nodes[cell] == pytest.approx((loss(moved, steps) - got) / 1e-6, abs=1e-4)
    for cell in [(5, 0), (0, 0), (1, 3), (2, 4)]:
        moved = steps.copy()
        moved[cell] += 1e-6
        assert edges[cell] == pytest.approx((loss(scores, moved) - got) / 1e-6, abs=1e-4)
    assert nodes[0, 1:].any() == False and nodes[1, 3:].any() == False  # noqa: E712


def test_tags_that_break_the_scheme_are_read_as_chunks():
    ids = np.array([3, 3, 0, 4, 1, 4, 3])
    got = structured.lawful(ids, np.array([0, 6]), TAGS)
    assert [TAGS[i] for i in got] == ["B-A", "I-A", "O", "B-B", "B-A", "B-B", "B-A"]


def test_neighbours_stay_inside_a_sentence():
    rows = structured.features(pa.array(["Ab", "c9", "Ab"]), np.array([2, 0, 1]), 1 << 12)
    assert rows[0, 4] != rows[2, 4] and rows[0, 3] == rows[2, 3] and rows[0, 0] == rows[2, 0] and rows[1, 4] == rows[2, 4]


def corpus(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        tokens, tags = [], []
        for _ in range(rng.randint(1, 6)):
            kind = rng.choice("oAB")
            if kind == "o":
                tokens, tags = [*tokens, rng.choice(["the", "and", "went", "nine"])], [*tags, "O"]
            else:
                size = rng.randint(1, 3)
                tokens += ["mr" if kind == "A" else "st", *[rng.choice(["Oak", "Elm", "Fir"])] * (size - 1)][:size]
                tags += ["B-" + kind, *["I-" + kind] * (size - 1)]
        rows.append((k, tokens, tags))
    rows += [(n, [], []), (n + 1, None, None)]
    return spark.createDataFrame(rows, "k int, tokens array<string>, labels array<string>")


def test_entities_that_need_their_first_word(spark):
    """``Oak`` is part of either type: only the sequence tells which."""
    train = conll.encode_tags(corpus(spark, 1, 400), TAGS).repartition(4)
    tagger = structured.fit_tagger(train, TAGS)
    held = corpus(spark, 2, 200).filter("tokens is not null")
    named = structured.predict_tags(tagger, held)
    rows = named.collect()
    assert all(len(r["pred"]) == len(r["tokens"]) and legal(r["pred"]) for r in rows)
    assert entity_scores(named, "labels", "pred").first()["f1"] > 0.97
    assert named.select(conll.scheme_breaks(named["pred"]).alias("n")).filter("n > 0").count() == 0


def test_scheme_breaks(spark):
    df = spark.createDataFrame([(["I-A"],), (["B-A", "I-A", "I-B", "O", "I-B"],), ([],), (["B-A", "B-B", "I-B"],)], "t array<string>")
    assert [r[0] for r in df.select(conll.scheme_breaks(df["t"])).collect()] == [1, 2, 0, 0]


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "tokens array<string>, ner_tags array<int>")
    tagger = structured.fit_tagger(none, TAGS, n_features=64)
    rows = structured.predict_tags(tagger, spark.createDataFrame([(["a", "b"],), (None,)], "tokens array<string>")).collect()
    assert legal(rows[0]["pred"]) and rows[1]["pred"] in (None, [])
    with pytest.raises(ValueError):
        structured.fit_tagger(none, TAGS, n_features=1 << 26)


def test_scaled_sums_are_those_of_logarithms():
    rng = np.random.default_rng(3)
    tags = ["O", "B-A", "I-A", "B-B", "I-B"]
    steps = np.where(structured.allowed(tags), rng.normal(0, 2, (6, 5)), structured._NEVER)
    sizes = rng.integers(1, 12, 9)
    scores = rng.normal(0, 5, (9, int(sizes.max()), 5))
    for quick, exact in zip(structured._sums(scores, sizes, steps), structured._log_sums(scores, sizes, steps)):
        np.testing.assert_allclose(quick, exact, rtol=1e-9, atol=1e-9)
    scores[0, 0, 2] = 3000.0  # the start forbids this tag, so the shares of all others vanish beside it
    assert structured._sums(scores, sizes, steps) is None
    assert np.isfinite(structured.likelihood(scores, sizes, steps, np.zeros(scores.shape[:2], int))[0])
