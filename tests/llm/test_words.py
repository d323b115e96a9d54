import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from notemill.llm import words as w

TEXT = st.text(alphabet="aAbZ \n\t\x0b\x0c\r\x1c\xa0é𝔘.", max_size=40)


def found(texts, chunk=16):
    out = []
    for start, end, data, offsets in w.text_slices(pa.array(texts, pa.string()), chunk):
        starts, lengths, counts = w.words(data, offsets)
        edges = np.concatenate([[0], np.cumsum(counts)])
        hashes = w.word_hashes(data, starts, lengths)
        for i in range(end - start):
            a, b = edges[i], edges[i + 1]
            out.append([(data[s : s + n].tobytes().decode(), h) for s, n, h in zip(starts[a:b], lengths[a:b], hashes[a:b])])
    return out


@settings(deadline=None, max_examples=60)
@given(st.lists(TEXT, max_size=6))
def test_words_are_runs_between_six_bytes(texts):
    got = found(texts)
    assert [[x for x, _ in t] for t in got] == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


def test_hash_folds_ascii_case_only():
    (a, b, c, d), = found(["Ab aB É é"], 64)
    assert a[1] == b[1] and c[1] != d[1]


def test_long_word():
    assert len(found(["x" * 100_000 + " y"], 1 << 20)[0]) == 2


def test_shingles_of_short_and_long_texts():
    counts = np.array([0, 1, 2, 3, 5])
    hashes = np.arange(11, dtype=np.uint64) + np.uint64(5)
    out, n = w.shingles(hashes, counts, 3)
    assert n.tolist() == [0, 1, 1, 1, 3] and len(set(out.tolist())) == 6
    again, _ = w.shingles(hashes[3:6], np.array([3]), 3)
    assert again[0] == out[2]
