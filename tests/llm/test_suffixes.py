import hashlib
import random
from collections import Counter

import numpy as np
import odd
import pytest

from notemill.llm import suffixes as s
from notemill.llm.queries import QUERIES


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        kept = bytes(c for c, m in zip(t, mark) if not m)
        out.append((len(t), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(rows, ids, texts, length):
    want = sorted(zip(ids, *zip(*brute(texts, length))), key=str)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=str)
    assert got == want


@pytest.mark.parametrize("stop", [1, 3, 8])
def test_common_prefixes_against_comparison(stop):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab", k=rng.randrange(1, 40))).encode() for _ in range(12)] + [b"aaaaaaaaaaaaa", b""]
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    data[ends] = 0
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    left = ends[owner] - np.arange(len(data)) + 1
    order = s.suffix_order(data, left, stop)
    tails = [bytes(data[p : p + left[p]].astype(np.uint8)) for p in range(len(data))]
    for a, b in zip(order, order[1:]):
        assert tails[a][:stop] <= tails[b][:stop]
    found = s.common_prefixes(data, order, stop)
    for k in range(1, len(order)):
        a, b = tails[order[k - 1]], tails[order[k]]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        if a != b:
            assert found[k] == (n if n < stop else -1)


def test_equal_windows_share_their_anchor():
    rng = random.Random(9)
    part = bytes(rng.choices(b"abc", k=400))
    texts = [b"x" * 7 + part + b"tail", part, bytes(rng.choices(b"abc", k=300))]
    offsets = np.cumsum([0, *map(len, texts)])
    owner, start, end, anchor, _ = s.pieces(np.frombuffer(b"".join(texts), np.uint8), offsets, 200)
    by = {}
    for t, a, b, h in zip(owner, start, end, anchor):
        assert 200 <= b - a <= 368
        for i in range(a, b - 199):
            by.setdefault(texts[t][i : i + 200], set()).add(int(h))
    assert all(len(x) == 1 for x in by.values())
    assert len(by) == len({t[i : i + 200] for t in texts for i in range(len(t) - 199)})


def corpus(rng):
    word = lambda: "".join(rng.choices("etaoinshrdé ", k=rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    texts = []
    for _ in range(60):
        text = prose(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(shared)
            a = rng.randrange(0, len(part) // 2)
            text += part[a : a + rng.randrange(100, 400)] + prose(rng.randrange(0, 40))
        texts.append(text)
    texts += [texts[0], texts[1], texts[1], "ab" * 300, "z" * 1000, "z" * 200, "z" * 199, "", shared[0] + shared[0]]
    return texts


@pytest.mark.parametrize("group_bytes,hot,length", [(1 << 21, 20_000, 200), (1, 20_000, 200), (1 << 21, 3, 200), (1 << 21, 20_000, 150), (1 << 21, 0, 200), (1, 1, 150)])
def test_corpora_against_brute_force(spark, group_bytes, hot, length):
    texts = corpus(random.Random(length + hot))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = s.remove_repeats(docs, length, group_bytes=group_bytes, hot=hot).collect()
    check(rows, range(len(texts)), [t.encode() for t in texts], length)
    for r in rows:
        if r["kept"] is not None:
            assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


def test_long_texts_go_in_overlapping_parts(spark, monkeypatch):
    monkeypatch.setattr(s, "SLICE", 1000)
    texts = [t * 2 for t in corpus(random.Random(1))[:20]] + ["q" * 3500]
    import pyarrow as pa

    found = {}
    for row, shift, data, offsets in s._sliced(pa.array(texts), 200):
        owner, start, end, anchor, content = s.pieces(data, offsets, 200)
        for t, a, b in zip(owner, start, end):
            found.setdefault(row + t, set()).update(range(a + shift, b + shift - 199))
    for k, t in enumerate(texts):
        assert found.get(k, set()) == set(range(max(0, len(t.encode()) - 199)))


def test_query_against_brute_force(spark, sf, documents):
    ids, texts = zip(*documents[1])
    check(QUERIES["op8_suffix_dedup"](spark, sf).collect(), ids, [t.encode() for t in texts], 200)


@pytest.mark.parametrize("width", s.WIDTHS)
def test_parts_of_pieces_hold_every_window_once(width):
    texts = [t.encode() for t in corpus(random.Random(width))]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    owner, start, end, anchor, _ = s.pieces(data, offsets, 200)
    by, cut = {}, [texts[t][a:b] for t, a, b in zip(owner, start, end)]
    for piece, place, h in zip(cut, s.anchors_of(cut, 200), anchor):
        at = []
        for first, last, common in s.parted(piece, place, 200, width):
            assert 0 <= last - first - 200 < width and len(common.split(b":", 1)[1]) == 201 - width
            at += range(first, last - 199)
            for i in range(first, last - 199):
                by.setdefault(piece[i : i + 200], set()).add((int(h), common))
        assert sorted(at) == list(range(len(piece) - 199))
    assert all(len(x) == 1 for x in by.values())


def test_odd_rows(spark):
    rows = s.remove_repeats(odd.odd(spark)).collect()
    check(rows, [i for i, _, _ in odd.TEXTS], [(t or "").encode() for _, t, _ in odd.TEXTS], 200)
    assert s.remove_repeats(odd.none(spark)).count() == 0
    with pytest.raises(ValueError):
        s.remove_repeats(odd.none(spark), length=100)


def test_pieces_that_differ_in_the_middle_alone(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        base = rng.choices(range(97, 123), k=700)
        texts += [bytes(base), bytes([*base[:350], 65, *base[351:]])]
    frame = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    check(s.remove_repeats(frame, length=300).collect(), range(len(texts)), texts, 300)
