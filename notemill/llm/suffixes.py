"""Repeated byte strings by bounded backward extension on Burrows-Wheeler transforms.

A window is a run of ``length`` bytes. Each window has an anchor, its least k-gram by
hash; neighbouring windows of one anchor form a piece. Equal windows have equal anchors,
so windows that repeat lie in pieces of one anchor: pieces are gathered by it, equal
pieces collapse to one with a count, and those whose anchor occurs once are done. What is
left goes to transforms of some hundred kilobytes each. There, intervals of suffixes are
extended to the left breadth-first, which yields the common prefixes of neighbouring
suffixes by increasing length; it stops at ``length``. Neighbours without a value by then
share a whole window. An anchor with very many pieces is parted by longer context: windows with
the anchor at one of a few neighbouring places have most of their bytes in common, and equal windows
have equal common bytes, so these take the anchor's part and each part has its own transform.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.scratch import Scratch, partitions
from notemill.llm.words import mix, stream, text_slices

LENGTH = 200
ANCHOR = 32
#: Bytes of pieces in a transform; one anchor's pieces are never parted up to HOT of them (some 6 MB, 3 seconds of a task).
GROUP_BYTES = 1 << 18
HOT = 20_000
#: A crowded anchor is parted by the place of the anchor in the window, this many places to a part; then finer.
WIDTHS = (64, 8, 1)
SLICE = 1 << 22

_U = np.uint64
_BYTE = stream(51, 256)
_MUL = stream(52, 8) | _U(1)


def _runs(data: np.ndarray, widths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of the runs of each width (powers of two) at every place."""
    run, width, power, out = _BYTE[data], 1, _MUL[0], {}
    with np.errstate(over="ignore"):
        while True:
            if width in widths:
                out[width] = run
            if width >= max(widths) or len(run) <= width:
                break
            run, width, power = run[:-width] * power + run[width:], 2 * width, power * power
    for w in widths:
        out.setdefault(w, np.zeros(0, _U))
    return out


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Text, start, end, anchor hash and content hash of the pieces of each text of a slice."""
    width = length - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(_U), none.astype(_U)
    runs = _runs(data, (ANCHOR, 128))
    with np.errstate(over="ignore"):
        gram = mix(runs[ANCHOR])
    n = len(gram)
    low = _U((1 << 24) - 1)
    blocks = -(-n // width)
    keys = np.full(blocks * width, np.iinfo(np.uint64).max, _U)
    keys[:n] = (gram & ~low) | np.arange(n, dtype=_U)
    table = keys.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = n - width + 1
    anchor = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & low).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(count), side="right") - 1
    valid = np.flatnonzero(np.arange(count) + length <= offsets[text + 1])
    if not len(valid):
        return none, none, none, none.astype(_U), none.astype(_U)
    change = (anchor[valid[1:]] != anchor[valid[:-1]]) | (text[valid[1:]] != text[valid[:-1]])
    first = np.concatenate([[0], np.flatnonzero(change) + 1])
    last = np.append(first[1:], len(valid)) - 1
    start, end, owner = valid[first], valid[last] + length, text[valid[first]]
    whole = runs[128]
    with np.errstate(over="ignore"):
        content = (end - start).astype(_U)
        # A piece has 2 * length - ANCHOR bytes at most; runs from its start on cover them all, the last ones end with it.
        for k in range(-(-(2 * length - ANCHOR) // 128)):
            content += whole[np.minimum(start + 128 * k, end - 128)] * _MUL[k + 1]
        content = mix(content)
    return owner, start - offsets[owner], end - offsets[owner], gram[anchor[valid[first]]], content


def _sliced(column: pa.Array, length: int):
    """Slices of texts as ``text_slices``, a text over ``SLICE`` in overlapping parts: row, shift, bytes, offsets."""
    for row, end, data, offsets in text_slices(column, SLICE // 4):
        if len(data) <= SLICE:
            yield row, 0, data, offsets
        else:
            for at in range(0, len(data) - length + 1, SLICE - length + 1):
                part = data[at : at + SLICE]
                yield row, at, part, np.array([0, len(part)])


# --- one transform -------------------------------------------------------------------


def _ranked(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs of small numbers, and the rank of each pair from 1."""
    n = len(high)
    place = max(n - 1, 1).bit_length()
    pair = (high << bits) | low
    if int(high.max(initial=0)).bit_length() + bits + place <= 63:
        packed = np.sort((pair << place) | np.arange(n))  # sorts several times as fast as an order of pairs
        order, ranked = packed & ((1 << place) - 1), packed >> place
    else:
        order = np.argsort(pair)
        ranked = pair[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]) + 1
    return order, rank


def suffix_order(chars: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes, sorted by their first ``depth`` characters at least.

    ``chars`` are byte values plus 1, 0 ends a piece; ``left`` counts the characters up to and with
    the end. Prefixes double in length, four characters first.
    """
    n = len(chars)
    halves = []
    for start in (0, 2):
        half = np.zeros(n, np.int64)
        for k in (start, start + 1):
            half <<= 9
            half[: n - k] |= np.where(left[: n - k] > k, chars[k:], 0)
        halves.append(half)
    order, rank = _ranked(halves[0], halves[1], 18)
    size, bits = 4, n.bit_length()
    while size < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: n - size] = np.where(left[: n - size] > size, rank[size:], 0)
        order, rank = _ranked(rank, ahead, bits)
        size *= 2
    return order


def _same_neighbours(chars: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by their character, and for each the rows before and after with the same one."""
    by = np.argsort(chars.astype(np.uint16), kind="stable")
    after, before = np.full(n, n), np.full(n, -1)
    same = chars[by[1:]] == chars[by[:-1]]
    after[by[:-1][same]] = by[1:][same]
    before[by[1:][same]] = by[:-1][same]
    return by, before, after


def common_prefixes(chars: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before it; -1 where it is ``stop`` or longer.

    Intervals of suffixes that begin with the same string are extended by the character
    before them, all strings of one length at a time; an interval's end that has no value yet
    gets that length, and only such intervals go on.
    """
    n = len(chars)
    prefix = np.full(n + 1, -1, np.int32)
    before_char = np.where(order > 0, chars[order - 1], 0)
    counts = np.bincount(chars, minlength=257)
    block_end = np.cumsum(counts)
    by, before, after = _same_neighbours(before_char, n)
    target = np.empty(n, np.int64)
    # Rows of one preceding character keep their order in that character's block.
    within = np.cumsum(np.bincount(before_char, minlength=257)) - np.bincount(before_char, minlength=257)
    target[by] = np.arange(n) - within[before_char[by]] + (block_end - counts)[before_char[by]]
    used = np.flatnonzero(counts)
    low, high = (block_end - counts)[used], block_end[used]
    prefix[high] = 0
    prefix[0] = 0
    for size in range(1, stop):
        sizes = high - low
        rows = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        top, bottom = np.repeat(high, sizes), np.repeat(low, sizes)
        extends = before_char[rows] > 0
        ends = np.sort(target[rows[extends & (after[rows] >= top)]]) + 1
        begins = np.sort(target[rows[extends & (before[rows] < bottom)]])
        new = prefix[ends] < 0
        low, high = begins[new], ends[new]
        if not len(low):
            break
        prefix[high] = size
    return prefix[:n]


def repeated_starts(texts: list[bytes], weights: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Places of each text where a window starts that occurs again among the texts.

    A text of weight two or more stands for that many equal ones.
    """
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    data[ends] = 0
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    left = ends[owner] - np.arange(len(data)) + 1
    order = suffix_order(data, left, length)
    shared = common_prefixes(data, order, length) < 0
    twice = shared | np.append(shared[1:], False)
    hit = np.zeros(len(data), bool)
    hit[order[twice]] = True
    hit |= np.array(weights)[owner] > 1
    hit &= left > length
    begin = ends - sizes
    return [np.flatnonzero(hit[b : b + s]) for b, s in zip(begin, sizes)]


# --- the corpus ----------------------------------------------------------------------


def _runs_of(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of consecutive numbers."""
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()


def _found_schema() -> str:
    return "anchor long, content long, firsts array<int>, lasts array<int>"


def _transformed(rows: DataFrame, length: int, group_bytes: int) -> DataFrame:
    """Repeated window starts of every distinct piece, from transforms of whole anchors."""
    dealt = rows.repartition(partitions(rows.sparkSession), "anchor").sortWithinPartitions("anchor", "content")

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            found = repeated_starts([h[2] for h in held], [h[3] for h in held], length)
            runs = [_runs_of(f) for f in found]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
                    pa.array([r[0] for r in runs], pa.list_(pa.int32())), pa.array([r[1] for r in runs], pa.list_(pa.int32())),
                ],
                names=["anchor", "content", "firsts", "lasts"],
            )

        for batch in batches:
            for anchor, content, data, n in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if size >= group_bytes and anchor != last:
                    yield flush()
                    held, size = [], 0
                held.append((anchor, content, data, n))
                size += len(data)
                last = anchor
        if held:
            yield flush()

    return dealt.select("anchor", "content", "bytes", "n").mapInArrow(run, _found_schema())


def anchors_of(pieces: list[bytes], length: int) -> list[int]:
    """Place of the anchor in each piece: that of the least gram of its first window."""
    if not pieces:
        return []
    heads = np.frombuffer(b"".join(p[:length] for p in pieces), np.uint8)
    grams = np.zeros(len(heads), _U)
    runs = _runs(heads, (ANCHOR,))[ANCHOR]
    grams[: len(runs)] = mix(runs) >> _U(24)
    return grams.reshape(len(pieces), length)[:, : length - ANCHOR + 1].argmin(axis=1).tolist()


def parted(data: bytes, anchor: int, length: int, width: int) -> list[tuple[int, int, bytes]]:
    """Parts of a piece: start, end and common bytes of its windows with the anchor at ``width`` neighbouring places."""
    count, out = len(data) - length + 1, []
    for k in range((anchor - count + 1) // width, anchor // width + 1):
        # Windows whose distance to the anchor is from k * width up to the next multiple.
        latest, earliest = anchor - k * width, anchor - (k + 1) * width + 1
        first, last = max(earliest, 0), min(latest, count - 1)
        out.append((first, last + length, b"%d:" % k + data[latest : earliest + length]))
    return out


def _repeated(strings: DataFrame, length: int, group_bytes: int, hot: int, scratch: Scratch, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Repeated window starts of distinct pieces ``(anchor, content, bytes, n)``, each in a transform.

    Pieces of an anchor with more than ``hot`` of them are parted by their common bytes, equal parts collapse, and the same
    goes on with these. With parts of one window each, an anchor has a single one, so this ends.
    """
    level = len(widths)
    crowded = strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot).select("anchor")
    crowded = scratch.table(crowded, f"crowded-{level}")
    if not widths or not crowded.limit(1).count():
        return _transformed(strings, length, group_bytes).filter(F.size("firsts") > 0)
    few = _transformed(strings.join(crowded, "anchor", "left_anti"), length, group_bytes).filter(F.size("firsts") > 0)

    def cut_up(batches):
        def number(value: bytes) -> int:
            return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little", signed=True)

        for batch in batches:
            rows, columns = [], [batch.column(i).to_pylist() for i in range(4)]
            for anchor, content, data, n, place in zip(*columns, anchors_of(columns[2], length)):
                for first, end, common in parted(data, place, length, widths[0]):
                    context = number(anchor.to_bytes(8, "little", signed=True) + common)
                    rows.append((anchor, content, first, context, number(data[first:end]), data[first:end], n))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            names = ["of_anchor", "of_content", "shift", "anchor", "content", "bytes", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    parts = strings.join(crowded, "anchor", "left_semi").select("anchor", "content", "bytes", "n").mapInArrow(
        cut_up, "of_anchor long, of_content long, shift int, anchor long, content long, bytes binary, n long"
    )
    parts = scratch.table(parts, f"parts-{level}")
    distinct = parts.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes"))
    distinct = scratch.table(distinct, f"parted-{level}")
    twice = distinct.groupBy("anchor").agg(F.sum("n").alias("times")).filter("times > 1").select("anchor")
    hits = scratch.table(_repeated(distinct.join(twice, "anchor"), length, group_bytes, hot, scratch, widths[1:]), f"parted-hits-{level}")
    shifted = lambda c: F.transform(c, lambda x: x + F.col("shift"))
    # At most as many rows meet in a piece as it has windows.
    back = parts.select("of_anchor", "of_content", "shift", "anchor", "content").join(hits, ["anchor", "content"])
    back = back.groupBy(F.col("of_anchor").alias("anchor"), F.col("of_content").alias("content")).agg(
        F.flatten(F.collect_list(shifted("firsts"))).alias("firsts"), F.flatten(F.collect_list(shifted("lasts"))).alias("lasts")
    )
    return few.unionByName(back)


def cut(data: bytes, firsts: list[int], lasts: list[int], length: int) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs and what is left, for windows that start in the given runs."""
    out, at, removed, spans = [], 0, 0, 0
    for first, last in sorted(zip(firsts, lasts)):
        end = last + length
        if first > at or not spans:
            out.append(data[at:first])
            spans += 1
            removed += end - first
            at = end
        elif end > at:
            removed += end - at
            at = end
    out.append(data[at:])
    return removed, spans, b"".join(out)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, hot: int = HOT
) -> DataFrame:
    """Remove every byte of a text that a repeated string of ``length`` bytes covers.

    A string repeats if it also starts anywhere else, in this text or another, overlaps
    included; matches never cross texts, and all are judged on the input. Returns id, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept_sha256`` and ``kept`` (the bytes left; null where nothing was
    removed). A null text is empty; texts under ``length`` bytes stay; equal rows are copies and lose all
    their windows. ``length`` is 129 to 300. No rows give no rows.
    """
    if not 128 < length <= 300:
        raise ValueError("length must be from 129 to 300")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = texts.withColumn("key", F.unhex(F.sha2("text", 256)))
    rows = scratch.table(
        keyed.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "rows"
    )

    def found(batches):
        for batch in batches:
            keys = batch.column(0)
            for row, shift, data, offsets in _sliced(batch.column(1), length):
                owner, start, end, anchor, content = pieces(data, offsets, length)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(owner + row)), pa.array((start + shift).astype(np.int32)), pa.array((end + shift).astype(np.int32)),
                        pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                    ],
                    names=["key", "start", "end", "anchor", "content"],
                )

    every = keyed.select("key", "text").mapInArrow(found, "key binary, start int, end int, anchor long, content long")
    # Equal texts give equal rows here, which meet before the shuffle.
    every = every.groupBy("anchor", "content", "key", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    every = scratch.table(every, "pieces")
    twice = every.groupBy("anchor").agg(F.sum("n").alias("times")).filter("times > 1").select("anchor")
    # Written first, so that the join's sides are plain and a very common anchor's rows can be split.
    twice = scratch.table(twice, "twice")
    repeated = scratch.table(every.join(twice, "anchor"), "repeated")
    scratch.drop("pieces", "twice")
    distinct = scratch.table(
        repeated.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.min(F.struct("key", "start", "end")).alias("x"))
        .select("anchor", "content", "n", "x.key", "x.start", "x.end"),
        "distinct",
    )
    candidates = scratch.table(
        keyed.select("key", "text").join(repeated.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")),
        "candidates",
    )
    asked = distinct.groupBy("key").agg(F.collect_list(F.struct("anchor", "content", "n", "start", "end")).alias("parts"))

    def sliced(batches):
        for batch in batches:
            for text, parts in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.as_py().encode()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p["anchor"] for p in parts], pa.int64()), pa.array([p["content"] for p in parts], pa.int64()),
                        pa.array([data[p["start"] : p["end"]] for p in parts], pa.binary()), pa.array([p["n"] for p in parts], pa.int64()),
                    ],
                    names=["anchor", "content", "bytes", "n"],
                )

    strings = scratch.table(
        candidates.join(asked, "key").select("text", "parts").mapInArrow(sliced, "anchor long, content long, bytes binary, n long"), "strings"
    )
    hits = _repeated(strings, length, group_bytes, hot, scratch)
    hits = scratch.table(hits, "hits")
    shifted = lambda c: F.transform(c, lambda x: x + F.col("start"))
    spans = repeated.join(hits, ["anchor", "content"]).groupBy("key").agg(
        F.flatten(F.collect_list(shifted("firsts"))).alias("firsts"), F.flatten(F.collect_list(shifted("lasts"))).alias("lasts")
    )

    def removed(batches):
        for batch in batches:
            done = [cut(t.as_py().encode(), a, b, length) for t, a, b in zip(batch.column(1), *[batch.column(i).to_pylist() for i in (2, 3)])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                    pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string()), pa.array([d[2] for d in done], pa.binary()),
                ],
                names=["key", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    changed = scratch.table(
        candidates.join(spans, "key").select("key", "text", "firsts", "lasts").mapInArrow(
            removed, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary"
        ),
        "changed",
    )
    scratch.drop("repeated", "distinct", "candidates", "strings", "hits")
    return rows.join(changed, "key", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept",
    )
