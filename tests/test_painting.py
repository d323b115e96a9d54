"""Painting of intervals and labelled words of whole batches, against plain loops."""

import random
import time

import numpy as np
import pyarrow as pa

from notemill.operators.painting import label_batch, paint


def _plain(text, spans):
    """Words and labels of each line: a winner for each character, pieces of one type, then words."""
    out, start = [], 0
    for number, line in enumerate(text.split("\n")):
        chars = []
        for at in range(start, start + len(line) + 1):
            over = [s for s in spans if s["begin"] <= at < s["end"]]
            won = max(over, key=lambda s: s["span_idx"]) if over else None
            chars.append((won and won["type"], bool(won) and won["begin"] == at))
        found, at = [], 0
        while at < len(chars):
            stop = at
            while stop < len(chars) and chars[stop][0] == chars[at][0]:
                stop += 1
            words = line[at:stop].split()
            for k, w in enumerate(words):
                source = at if k == 0 else stop - 1 if k == len(words) - 1 else at + 1
                kind = chars[at][0]
                found.append((w, "O" if kind is None else ("B-" if chars[source][1] else "I-") + kind))
            at = stop
        if found:
            out.append((number, start, [w for w, _ in found], [t for _, t in found]))
        start += len(line) + 1
    return out


def _batch(texts, spans):
    kind = pa.list_(pa.struct([("span_idx", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
    got = label_batch(pa.array(texts, pa.string()), pa.array(spans, kind), ("begin", "end"), True).to_pylist()
    return [[(x["line_no"], x["line_start"], x["tokens"], x["labels"]) for x in rows] for rows in got]


def test_paint():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.randrange(1, 50)
        lo = np.array([rng.randrange(size) for _ in range(rng.randrange(8))], int)
        hi = np.array([rng.randrange(b + 1, size + 1) for b in lo], int)
        want = [max((i for i in range(len(lo)) if lo[i] <= at < hi[i]), default=-1) for at in range(size)]
        assert paint(size, lo, hi).tolist() == want


def test_batch_against_loops():
    rng = random.Random(5)
    texts, spans = [], []
    for _ in range(400):
        text = "".join(rng.choices("ab \n\t é𝔘　\x85", k=rng.randrange(60)))
        texts.append(text)
        spans.append([
            {"span_idx": i, "begin": b, "end": b + rng.randrange(30), "type": rng.choice(["X", "Y", None, ""])}
            for i in rng.sample(range(20), rng.randrange(7)) for b in [rng.randrange(-3, len(text) + 3)]
        ])
    assert _batch(texts, spans) == [_plain(t, s) for t, s in zip(texts, spans)]


def test_odd_batches():
    one = [{"span_idx": 0, "begin": 0, "end": 1, "type": "X"}]
    assert _batch([], []) == []
    assert _batch([None, "", "a b", "a"], [one, one, None, one]) == [
        [], [], [(0, 0, ["a", "b"], ["O", "O"])], [(0, 0, ["a"], ["B-X"])]]
    kind = pa.list_(pa.struct([("span_idx", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
    middle = pa.array([one, [], one, None], kind).slice(2)
    assert label_batch(pa.array(["q", "r", "s", "t"]).slice(2), middle, ("begin", "end"), True).to_pylist()[0][0]["labels"] == ["B-X"]


def test_nested_spans_cost_no_more_than_their_characters():
    size = 400_000
    spans = [[{"span_idx": i, "begin": i, "end": size - i, "type": "X"} for i in range(100_000)]]
    start = time.time()
    rows = _batch(["a" * size], spans)
    assert rows[0][0][3] == ["B-X"] and time.time() - start < 20


def test_a_large_batch_is_handed_on_in_bounded_slices():
    import pyarrow as pa

    from notemill.operators import painting

    texts = pa.array([f"word{k} 123 " * 2000 for k in range(60)] + [None, ""])
    kind = pa.list_(pa.struct([("span_idx", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
    spans = pa.array([[{"span_idx": 0, "begin": 0, "end": 5, "type": f"T{k % 3}"}] for k in range(60)] + [None, []], kind)
    parts = list(painting.label_slices(texts, spans, ("begin", "end"), True))
    longest = max(len(t.as_py() or "") for t in texts)
    assert len(parts) > 1 and max(len(p) for p in parts) * longest <= 500_000 + 2 * longest
    assert pa.concat_arrays(parts).equals(painting.label_batch(texts, spans, ("begin", "end"), True))
    assert [p for part in parts for p in part.to_pylist()][3][0]["labels"][:2] == ["B-T0", "O"]
