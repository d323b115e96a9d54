import hashlib

import numpy as np
import odd
from hypothesis import given, settings
from hypothesis import strategies as st

from notemill.llm import ordermin as o
from notemill.llm.queries import QUERIES
from notemill.llm.words import mix


def brute(points, k=o.K):
    """The definition, element by element."""
    codes, numbered = o.elements(points, k)
    if not len(codes):
        return []
    keys = [mix(numbered ^ s) for s in o._SEEDS]
    out = []
    for e in range(o.ENTRIES):
        def rank(p):
            for r, key in enumerate(keys):
                if int(key[p]) >> (64 - o._BITS) == e:
                    return (r, int(key[p]))
            return (len(keys), int(mix(numbered[p : p + 1] ^ o._OWN[e])[0]))

        chosen = sorted(sorted(range(len(codes)), key=rank)[: o.TUPLE])
        value = np.zeros(1, np.uint64)
        with np.errstate(over="ignore"):
            for p in chosen:
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + codes[p : p + 1])
        out.append(int(value[0] >> np.uint64(48)))
    return out


@settings(deadline=None, max_examples=25)
@given(st.text("abc é", max_size=300))
def test_fingerprint_against_its_definition(text):
    points = o._points(text)
    assert o.fingerprint(points).tolist() == brute(points)


def test_long_texts_take_the_short_way_to_the_same_entries():
    rng = np.random.default_rng(2)
    points = rng.integers(97, 123, 6000).astype(np.uint32)
    assert o.fingerprint(points).tolist() == brute(points)


def test_occurrences_are_numbered():
    codes, numbered = o.elements(o._points("abcdefgh" * 3))
    assert len(set(codes.tolist())) == 8 and len(set(numbered.tolist())) == len(codes)


def test_order_counts():
    a, b = "".join(chr(97 + i % 26) + str(i) for i in range(300)), ""
    b = a[len(a) // 2 :] + a[: len(a) // 2]
    own, moved = o.fingerprint(o._points(a)), o.fingerprint(o._points(b))
    assert o.likeness(own, own) == 1 and o.likeness(own, moved) < 0.8


def expected(docs):
    out = []
    for k, (i, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        change = o.edited(text, after)
        prints = [o.fingerprint(o._points(x)) for x in (text, change, after)]
        hexed = [p.astype(">u2").tobytes().hex() for p in prints]
        out.append((
            i, len(text), hashlib.sha256(change.encode()).hexdigest(), hexed[0], hexed[1], o.likeness(prints[0], prints[1]),
            o.likeness(prints[0], prints[2]),
        ))
    return out


def test_query_against_direct_computation(spark, sf, documents):
    rows = sorted(QUERIES["op9_fingerprints"](spark, sf).collect())
    assert [tuple(r) for r in rows] == sorted(expected(documents[1]))
    near = np.array([(r["near_edited"], r["near_next"]) for r in rows if r["n_chars"] > 200])
    assert (near[:, 0] > near[:, 1]).mean() > 0.97


def test_odd_rows(spark):
    docs = [(i, x) for i, x, _ in odd.TEXTS if i is not None]
    rows = [tuple(r) for r in o.fingerprints(odd.odd(spark).filter("doc_id IS NOT NULL")).collect()]
    assert sorted(rows) == sorted(expected(docs))
    everything = o.fingerprints(odd.odd(spark)).collect()
    assert len(everything) == len(odd.TEXTS) and sum(r["doc_id"] is None for r in everything) == 2
    assert o.fingerprints(odd.none(spark)).count() == 0


def test_sole_document_follows_itself(spark):
    docs = spark.createDataFrame([(3, "a sole document of some words")], "doc_id long, text string")
    assert [tuple(r) for r in o.fingerprints(docs).collect()] == expected([(3, "a sole document of some words")])
