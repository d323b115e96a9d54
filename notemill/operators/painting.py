"""Words and BIO labels of annotated texts, for whole Arrow batches at once.

The texts of a batch lie end to end in one buffer of characters. Intervals are painted
over it by halving: one of length n is the union of two of the greatest power of two up to
n, and every power hands its marks down to the next lower one. So the work follows the
characters and the logarithm of the longest span, however many spans lie over each other,
and no Python loop runs over spans, lines or words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from notemill.functions.text import SPACE_CHARS

#: Bytes of text that are painted, and handed on, at once; a longer text goes alone.
_SLICE = 500_000

_SPACE = np.zeros(max(map(ord, SPACE_CHARS)) + 2, bool)
_SPACE[[ord(c) for c in SPACE_CHARS]] = True


def paint(size: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each place of ``0 .. size-1`` the last of the intervals ``[lo, hi)`` over it, -1 for none."""
    top = np.full(size, -1, np.int64)
    if not len(lo):
        return top
    level = np.frexp((hi - lo).astype(float))[1] - 1
    for k in range(int(level.max()), -1, -1):
        # Here a mark at place i stands for [i, i + 2**k).
        at = np.flatnonzero(level == k)
        np.maximum.at(top, lo[at], at)
        np.maximum.at(top, hi[at] - (1 << k), at)
        if k:
            half = 1 << (k - 1)
            lower = top.copy()
            np.maximum(lower[half:], top[:-half], out=lower[half:])
            top = lower
    return top


class Spans(NamedTuple):
    """Spans of a slice of texts, one entry each."""

    row: np.ndarray  # which text of the slice
    index: np.ndarray  # the greatest wins
    lo: np.ndarray
    hi: np.ndarray
    opens: np.ndarray  # whether the span begins at ``lo``
    kind: np.ndarray  # code of its type, -1 for none


def _spans(values: pa.Array, codes: np.ndarray, first: int, last: int, names: tuple[str, str]) -> Spans:
    """Entries of the lists ``first`` to ``last``; ``codes`` are those of all lists, ``values`` starts at offset 0."""
    import pyarrow.compute as pc

    at = values.offsets.to_numpy()[first : last + 1]
    flat = values.values.slice(at[0], at[-1] - at[0])
    row = np.repeat(np.arange(last - first), np.diff(at))

    def field(name: str) -> np.ndarray:
        return pc.fill_null(pc.cast(pc.struct_field(flat, name), pa.int64()), 0).to_numpy()

    lo, hi = field(names[0]), field(names[1])
    has = flat.type.get_field_index("opens") >= 0
    opens = pc.fill_null(pc.struct_field(flat, "opens"), False).to_numpy(zero_copy_only=False) if has else lo >= 0
    return Spans(row, field("span_idx"), lo, hi, opens, codes[at[0] : at[-1]])


def _whole(values: pa.Array) -> pa.Array:
    """The lists without entries hidden under a null one, so that offsets and flat entries agree."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(values), 0)
    offsets = np.concatenate([[0], np.cumsum(sizes.to_numpy())]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values.flatten())


def _words(texts: list[str], spans: Spans, n_kinds: int, by_line: bool) -> tuple[np.ndarray, ...]:
    """(row, line, line start, label code, characters of words, their bytes' ends) of the words of the texts."""
    buffer = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    n = len(buffer)

    lo = np.clip(spans.lo, 0, sizes[spans.row])
    hi = np.clip(spans.hi, 0, sizes[spans.row])
    order = np.lexsort((-np.arange(len(lo)), spans.opens, hi, lo, spans.index))
    order = order[(hi > lo)[order]]
    lo, hi = (lo + starts[spans.row])[order], (hi + starts[spans.row])[order]
    over = paint(n, lo, hi)
    inside = np.flatnonzero(over >= 0)
    kind, opening = np.full(n, -1, np.int64), np.zeros(n, bool)
    kind[inside] = spans.kind[order][over[inside]]
    opening[inside] = spans.opens[order][over[inside]] & (lo[over[inside]] == inside)

    row_edge = np.zeros(n, bool)
    row_edge[starts] = True
    line_edge = row_edge.copy()
    if by_line:
        line_edge[1:] |= buffer[:-1] == 10
    edge = line_edge.copy()
    edge[1:] |= kind[1:] != kind[:-1]

    space = _SPACE[np.minimum(buffer, len(_SPACE) - 1)]
    ended = np.concatenate([[True], space[:-1]])
    first = np.flatnonzero(~space & (ended | edge))
    piece_starts = np.flatnonzero(edge)
    piece = np.searchsorted(piece_starts, first, side="right") - 1
    begins = piece_starts[piece]
    lasts = np.append(piece_starts, n)[piece + 1] - 1
    heads = np.concatenate([[True], piece[1:] != piece[:-1]])[: len(piece)]
    tails = np.concatenate([piece[1:] != piece[:-1], [True]])[: len(piece)]
    # The first word takes the label of its piece's first character, the last word that of the
    # last character, the others that of the second.
    source = np.where(heads, begins, np.where(tails, lasts, np.minimum(begins + 1, n - 1)))
    label = np.where(kind[first] < 0, 0, 1 + kind[first] + np.where(opening[source], 0, n_kinds))

    row = np.searchsorted(starts, first, side="right") - 1
    line_starts = np.flatnonzero(line_edge)
    line = np.searchsorted(line_starts, first, side="right") - 1
    start = line_starts[line] - starts[row]
    number = line - np.searchsorted(line_starts, starts[row])

    shown = buffer[~space]
    width = 1 + (shown >= 0x80).astype(np.int64) + (shown >= 0x800) + (shown >= 0x10000)
    ends = np.cumsum(width)
    place = np.cumsum(~space)[first] - 1  # of a word's first character among those shown
    offsets = np.append(np.concatenate([[0], ends])[place], ends[-1] if len(ends) else 0)
    return row, number, start, label, shown, offsets


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Lists of ``values`` by their sorted owners ``0 .. n-1``."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def label_slices(texts: pa.Array, spans: pa.Array, names: tuple[str, str], by_line: bool) -> Iterator[pa.Array]:
    """Labelled words of each text, by its lines that have any (``by_line``) or as a whole, some texts at a time.

    ``spans`` hold ``span_idx``, ``type``, offsets under ``names`` and perhaps ``opens``. A null text has no words, a
    null list no spans.
    """
    import pyarrow.compute as pc

    spans = _whole(spans)
    types = pc.struct_field(spans.flatten(), "type").dictionary_encode()
    codes = pc.fill_null(types.indices, -1).to_numpy().astype(np.int64)
    known = types.dictionary.to_pylist()
    tags = pa.array(["O", *[f"B-{k}" for k in known], *[f"I-{k}" for k in known]], pa.string())
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    total = np.cumsum(lengths, dtype=np.int64)
    kind = pa.struct([("tokens", pa.list_(pa.string())), ("labels", pa.list_(pa.string()))])
    if by_line:
        kind = pa.list_(pa.struct([("line_no", pa.int32()), ("line_start", pa.int32()), *kind]))
    first = 0
    while first < len(texts):
        # Texts up to a bound of bytes, or one text of any length.
        before = total[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(total, before + _SLICE, side="right")))
        part = [t or "" for t in texts.slice(first, last - first).to_pylist()]
        row, line, start, label, shown, offsets = _words(part, _spans(spans, codes, first, last, names), len(known), by_line)
        data = shown.tobytes().decode("utf-32-le").encode()
        tokens = pa.StringArray.from_buffers(len(row), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        labels = tags.take(pa.array(label))
        if by_line:
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])])[: len(row)])
            of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(row))))
            lines = pa.StructArray.from_arrays(
                [
                    pa.array(line[new].astype(np.int32)), pa.array(start[new].astype(np.int32)),
                    _lists(of, len(new), tokens), _lists(of, len(new), labels),
                ],
                names=["line_no", "line_start", "tokens", "labels"],
            )
            yield _lists(row[new], last - first, lines).cast(kind)
        else:
            both = [_lists(row, last - first, tokens), _lists(row, last - first, labels)]
            yield pa.StructArray.from_arrays(both, names=["tokens", "labels"]).cast(kind)
        first = last
    if not len(texts):
        yield pa.array([], kind)


def label_batch(texts: pa.Array, spans: pa.Array, names: tuple[str, str], by_line: bool) -> pa.Array:
    """All slices of ``label_slices`` in one array."""
    return pa.concat_arrays(list(label_slices(texts, spans, names, by_line)))


def labelled_lines():
    """Arrow function (text, spans with ``begin`` and ``end``) -> its lines that have words, with their labels."""

    @F.arrow_udf("array<struct<line_no:int,line_start:int,tokens:array<string>,labels:array<string>>>")
    def lines(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            yield from label_slices(texts, spans, ("begin", "end"), True)

    return lines


def labelled_words():
    """Arrow function (line, clips with ``lo``, ``hi`` and ``opens``) -> its words and labels."""

    @F.arrow_udf("struct<tokens:array<string>,labels:array<string>>")
    def words(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lines, clips in batches:
            yield from label_slices(lines, clips, ("lo", "hi"), False)

    return words
