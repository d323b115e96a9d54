"""Order MinHash: fingerprints that are sensitive to edit distance.

The elements of a text are its occurrence-numbered k-mers. For each entry of the
fingerprint a random order picks its ``TUPLE`` least elements; put back in the order of
the text and hashed, they are the entry. Texts agree in an entry if they hold the same
k-mers in the same order there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.llm.decontam import grams
from notemill.llm.scratch import Scratch, partitions
from notemill.llm.words import mix, stream

K = 8
TUPLE = 2
ENTRIES = 64
_BITS = 6
_ROUNDS = 3
_U = np.uint64
_SEEDS = stream(41, _ROUNDS)
_OWN = stream(42, ENTRIES)


def elements(points: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-mer, and of each k-mer with its occurrence number; a shorter text is one k-mer."""
    if 0 < len(points) < k:
        codes = grams(points, len(points))
    else:
        codes = grams(points, k)
    n = len(codes)
    if n < 2:
        return codes, codes
    if n <= 1 << 20:
        low = _U((1 << 20) - 1)
        packed = np.sort((codes & ~low) | np.arange(n, dtype=_U))
        order, same = None, (packed[1:] ^ packed[:-1]) <= low
    else:
        order = np.argsort(codes, kind="stable")
        same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return codes, codes
    order = (packed & low).astype(np.int64) if order is None else order
    rank = np.arange(n)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), rank, 0))
    times = rank - first
    again = times > 0
    numbered = codes.copy()
    with np.errstate(over="ignore"):
        numbered[order[again]] = mix(codes[order[again]] + times[again].astype(_U) * _U(0x9E3779B97F4A7C15))
    return codes, numbered


def _least(keys: np.ndarray, want: int) -> np.ndarray:
    """Places of the ``want`` least keys of every bucket (the leading bits), in order of key.

    Of many keys, only those below a bound are sorted; where a bucket then runs short,
    all are.
    """
    n = len(keys)
    places = None
    if n > 4096:
        bound = int((1 << (64 - _BITS)) * min(1.0, 24.0 * want * ENTRIES / n))
        places = np.flatnonzero((keys & _U((1 << (64 - _BITS)) - 1)) < _U(bound))
        buckets = np.bincount((keys[places] >> _U(64 - _BITS)).astype(np.int64), minlength=ENTRIES)
        if (buckets < want).any():
            places = None
    if places is None:
        places = np.arange(n)
    places = places[np.argsort(keys[places], kind="stable")]
    bucket = (keys[places] >> _U(64 - _BITS)).astype(np.int64)
    counts = np.bincount(bucket, minlength=ENTRIES)
    rank = np.arange(len(places)) - np.repeat(np.cumsum(counts) - counts, counts)
    return places[rank < want]


def fingerprint(points: np.ndarray, k: int = K) -> np.ndarray:
    """``ENTRIES`` numbers of 16 bits; none for an empty text.

    An element's order in an entry is the first of ``_ROUNDS`` hashes that deals it
    there, then that hash; elements dealt elsewhere follow by a hash of the entry's own. So one hash
    of a long text fills all entries, and a short text's entries follow the same law.
    """
    if not len(points):
        return np.zeros(0, np.uint16)
    codes, numbered = elements(points, k)
    want = min(TUPLE, len(codes))
    chosen = np.full((ENTRIES, TUPLE), -1, np.int64)
    have = np.zeros(ENTRIES, np.int64)
    for seed in _SEEDS:
        keys = mix(numbered ^ seed)
        places = _least(keys, TUPLE)
        entry = (keys[places] >> _U(64 - _BITS)).astype(np.int64)
        if not have.any():
            counts = np.bincount(entry, minlength=ENTRIES)
            rank = np.arange(len(places)) - np.repeat(np.cumsum(counts) - counts, counts)
            chosen[entry, rank] = places
            have = counts
        else:
            for e, p in zip(entry.tolist(), places.tolist()):
                if have[e] < want and p not in chosen[e]:
                    chosen[e, have[e]] = p
                    have[e] += 1
        if (have >= want).all():
            break
    for e in np.flatnonzero(have < want).tolist():
        for p in np.argsort(mix(numbered ^ _OWN[e]), kind="stable").tolist():
            if p not in chosen[e]:
                chosen[e, have[e]] = p
                have[e] += 1
                if have[e] == want:
                    break
    chosen = np.sort(chosen[:, :want], axis=1)
    out = np.zeros(ENTRIES, _U)
    with np.errstate(over="ignore"):
        for t in range(want):
            out = mix(out * _U(0x9E3779B97F4A7C15) + codes[chosen[:, t]])
    return (out >> _U(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries; an empty text is like an empty one only."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _compared(name, text: str, own: np.ndarray, next_text: str, next_print: np.ndarray) -> list:
    change = edited(text, next_text)
    other = fingerprint(_points(change))
    return [
        name, len(text), hashlib.sha256(change.encode("utf-8", "surrogatepass")).digest(), own.astype(">u2").tobytes(),
        other.astype(">u2").tobytes(), likeness(own, other), likeness(own, next_print),
    ]


_RESULT = "n_chars long, edited_sha256 binary, print binary, edited_print binary, near_edited double, near_next double"


def _batch(rows: list[list], id_type: pa.DataType, names: list[str], extra: list[pa.DataType] = ()) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), *extra]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and their likeness.

    Returns id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``
    (hex), ``near_edited`` and ``near_next``. The edited text has its last half replaced
    by the start of the next document's, in ascending order of id, nulls first, rows of
    one id by text; the first follows the last, and a sole document itself. A null text
    is empty: its fingerprint is the empty string. Texts shorter than a k-mer have one
    element. Texts move once, to their range of ids; between ranges only the last and
    first text of each meet. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ordermin")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(texts.dtypes)["id"]
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    # Rows equal in both are spread by their place in the input, so a row that repeats often does not fill one task.
    dealt = texts.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *keys, "tie")
    dealt = dealt.sortWithinPartitions(*keys, "text")
    dealt = dealt.select("id", "text", F.spark_partition_id().alias("part"))
    fields = ["id", *[f.split()[0] for f in _RESULT.split(", ")]]
    names = [*fields, "part", "edge", "text"]
    more = [pa.int32(), pa.string(), pa.string()]

    def rows(batches):
        last = part = id_type = None
        for batch in batches:
            out, id_type = [], batch.column(0).type
            if batch.num_rows and part is None:
                part = batch.column(2)[0].as_py()
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                own = fingerprint(_points(text))
                if last is None:
                    out.append([name, len(text), None, own.tobytes(), None, None, None, part, "first", text])
                else:
                    out.append([*_compared(*last, text, own), part, None, None])
                last = (name, text, own)
            if out:
                yield _batch(out, id_type, names, more)
        if last is not None:
            yield _batch([[last[0], len(last[1]), None, last[2].tobytes(), None, None, None, part, "last", last[1]]], id_type, names, more)

    done = scratch.table(dealt.mapInArrow(rows, f"id {kind}, {_RESULT}, part int, edge string, text string"), "done")
    inner = done.filter("edge IS NULL").select(*fields)
    ends = done.filter("edge = 'last'").select("part", "id", "text", "print")
    order = Window.orderBy("part")  # one row for each range partition
    following = ends.select(
        "part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next")
    )
    starts = done.filter("edge = 'first'").select(
        F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("print").alias("next_print")
    )
    met = ends.join(following, "part").join(starts, "next").select("id", "text", "print", "next_text", "next_print")

    def across(batches):
        for batch in batches:
            out = [
                _compared(name, text, np.frombuffer(own, np.uint16), after, np.frombuffer(after_print, np.uint16))
                for name, text, own, after, after_print in zip(*[batch.column(i).to_pylist() for i in range(5)])
            ]
            if out:
                yield _batch(out, batch.column(0).type, fields)

    outer = met.mapInArrow(across, f"id {kind}, {_RESULT}")
    return inner.unionByName(outer).select(
        F.col("id").alias(id_col), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        F.lower(F.hex("print")).alias("fingerprint"), F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
