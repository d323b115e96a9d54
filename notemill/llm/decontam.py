"""Benchmark passages in documents: q-gram lemma filter, then banded alignment.

A text region within ``e`` edits of an item of ``n`` characters shares at least
``(n - q + 1) - e * q`` of the item's q-grams with it, all on diagonals at most ``e``
apart. Shared q-grams are counted in diagonal bands that overlap by half, so one band
holds them all; bands that reach the bound are verified by alignment within the band.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.columns import Aside
from notemill.llm.scratch import Scratch
from notemill.llm.words import mix, stream, text_slices

Q = 10
EDIT_RATE = 0.08
MIN_CHARS = 40
#: Characters of items that one pass over the documents looks for.
INDEX_CHARS = 8_000_000

LEAKS = T.ArrayType(
    T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()), T.StructField("edits", T.IntegerType()),
    ])
)

_U = np.uint64
_FOLD = np.arange(0x20000, dtype=np.uint32)  # no letter beyond has a case
for _c in range(len(_FOLD)):
    _low = chr(_c).lower()
    if len(_low) == 1:
        _FOLD[_c] = ord(_low.casefold() if len(_low.casefold()) == 1 else _low)
_FOLD[[9, 10, 11, 12, 13]] = 32


def folded(text: str | bytes) -> np.ndarray:
    """Code points in lower case where that is one letter, white space as blanks; lengths stay."""
    if isinstance(text, bytes):
        text = text.decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    low = points < len(_FOLD)
    points[low] = _FOLD[points[low]]
    return points


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place, built from runs of doubling length."""
    if len(points) < q:
        return np.zeros(0, _U)
    base = stream(31, 1)[0] | _U(1)
    with np.errstate(over="ignore"):
        run, width, power = mix(points.astype(_U) + _U(77)), 1, base
        out, done = None, 0
        bits = q
        while bits:
            if bits & 1:
                if out is None:
                    out, done = run, width
                else:
                    n = len(points) - done - width + 1
                    out, done = out[:n] * power + run[done : done + n], done + width
            bits >>= 1
            if bits:
                n = len(points) - 2 * width + 1
                run, width, power = run[:n] * power + run[width : width + n], 2 * width, power * power
        return mix(out)


def budget(n: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed for an item of ``n`` characters; the lemma must ask for one q-gram at least."""
    return max(0, min(int(n * rate), (n - q) // q))


@dataclass
class Index:
    ids: np.ndarray
    items: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    flags: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    where: np.ndarray  # item and place of each gram occurrence, by key
    place: np.ndarray


def build_index(rows: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE) -> Index:
    items = [folded(text) for _, text in rows]
    lengths = np.array([len(p) for p in items], np.int64)
    edits = np.array([budget(n, q, rate) for n in lengths], np.int64)
    codes = [grams(p, q) for p in items]
    key = np.concatenate([np.zeros(0, _U), *codes])
    where = np.repeat(np.arange(len(items)), [len(c) for c in codes])
    place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(c)) for c in codes]])
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    flags = np.zeros(1 << 22, bool)
    flags[(keys >> _U(42)).astype(np.int64)] = True
    return Index(
        np.array([i for i, _ in rows], np.int64), items, edits, lengths - q + 1 - edits * q, flags, keys,
        np.append(first, len(order)), where[order], place[order],
    )


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best (start, end, edits) of ``item`` in ``text`` on diagonals ``low .. high``, or None.

    A diagonal without any edit is looked for first; the first one is the answer. Else row
    i of the table holds the cost of the first i item characters ending at text place
    i + diagonal; moves along a row are a running minimum.
    """
    first, last = max(low, 0), min(high, len(text) - len(item))
    if first <= last and len(item):
        same = (np.lib.stride_tricks.sliding_window_view(text, len(item))[first : last + 1] == item).all(axis=1)
        if same.any():
            begin = first + int(same.argmax())
            return begin, begin + len(item), 0
    width = high - low + 1
    far = 1 << 20
    diagonals = np.arange(low, high + 1)
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)
    start = diagonals.copy()
    slope = np.arange(width)
    padded = np.concatenate([text.astype(np.int64), [-1]])
    for i in range(1, len(item) + 1):
        ends = i + diagonals
        inside = (ends >= 0) & (ends <= len(text))
        at = np.where((ends >= 1) & inside, ends - 1, len(text))
        best = cost + (padded[at] != item[i - 1])
        best = np.where(ends >= 1, best, far)
        begin = start
        down = np.append(cost[1:] + 1, far)
        better = down < best
        best = np.where(better, down, best)
        begin = np.where(better, np.append(start[1:], 0), begin)
        # Along the row: cost at d is the least of cost at d' plus d - d'.
        key = (best - slope) * (2 * width) + slope
        least = np.minimum.accumulate(key)
        source = least % (2 * width)
        cost = np.where(inside, best[source] + slope - source, far)
        start = begin[source]
    cost = np.where(inside, cost, far) if len(item) else cost
    k = int(np.argmin(cost))
    if cost[k] > budget:
        return None
    return int(start[k]), int(len(item) + diagonals[k]), int(cost[k])


def find(index: Index, points: np.ndarray, edges: np.ndarray, q: int = Q) -> list[list[tuple[int, int, int, int]]]:
    """Verified regions (item id, start, end, edits) of each text of a slice."""
    out: list[list] = [[] for _ in range(len(edges) - 1)]
    if not len(index.keys):
        return out
    code = grams(points, q)
    hits = np.flatnonzero(index.flags[(code >> _U(42)).astype(np.int64)])
    at = np.searchsorted(index.keys, code[hits])
    known = index.keys[np.minimum(at, len(index.keys) - 1)] == code[hits]
    hits, at = hits[known], at[known]
    text = np.searchsorted(edges, hits, side="right") - 1
    whole = hits + q <= edges[text + 1]
    hits, at, text = hits[whole], at[whole], text[whole]
    times = index.first[at + 1] - index.first[at]
    entry = np.repeat(index.first[at], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    item, place = index.where[entry], index.place[entry]
    text = np.repeat(text, times)
    diagonal = np.repeat(hits, times) - edges[text] - place
    # Too few shared q-grams with an item in a text leave no band that could reach the bound.
    pair = text * len(index.items) + item
    _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
    enough = count[back] >= index.need[item]
    text, item, place, diagonal = text[enough], item[enough], place[enough], diagonal[enough]
    if not len(text):
        return out
    step = index.edits[item] + 1
    band = diagonal // step
    rows = np.column_stack([np.tile(text, 2), np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(place, 2)])
    rows = np.unique(rows, axis=0)  # each q-gram of the item counts once in a band
    bands, shared = np.unique(rows[:, :3], axis=0, return_counts=True)
    for t, i, b in bands[shared >= index.need[bands[:, 1]]].tolist():
        step = int(index.edits[i]) + 1
        low, high = b * step, b * step + 2 * step - 1
        found = align(index.items[i], points[edges[t] : edges[t + 1]], low, high, int(index.edits[i]))
        if found:
            out[t].append((int(index.ids[i]), *found))
    return [_best(rows) for rows in out]


def _best(rows: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping regions of one item the one of fewest edits, then the first."""
    kept: list[tuple[int, int, int, int]] = []
    for row in sorted(set(rows), key=lambda r: (r[0], r[3], r[1], r[2])):
        if all(k[0] != row[0] or row[2] <= k[1] or row[1] >= k[2] for k in kept):
            kept.append(row)
    return sorted(kept, key=lambda r: (r[1], r[0]))


def _searched(index, names: list[str]):
    """Batches of the columns ``names`` and a text, to the former and the regions that the index finds."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def run(batches):
        for batch in batches:
            found = []
            for start, end, data, offsets in text_slices(batch.column(batch.num_columns - 1)):
                parts = [folded(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(end - start)]
                edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                points = np.concatenate(parts)
                by = [find(one, points, edges, q) for q, one in index.value]
                found += [_best(sum(f, [])) for f in zip(*by)] if len(by) > 1 else by[0]
            rows = [[{"item_id": i, "start": s, "end": e, "edits": n} for i, s, e, n in f] for f in found]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(rows, kind)], names=[*names, "__leaks"])

    return run


def mark(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", leaks_col: str = "leaks", item_col: str = "item_id",
    item_text_col: str = "text", index_chars: int = INDEX_CHARS, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Add ``leaks``: the regions of every text that are benchmark items up to small edits.

    A region has item id, start, end (code points) and edits, at most 8 percent of the
    item's characters; letter case and the kind of white space do not count. Items under
    ``min_chars`` characters are not looked for, unless it is 0: they occur in ordinary prose. Items under 20
    characters have no edits to spare and are found as they are. Null, empty and blank texts and items
    have no regions; equal items each get theirs; an item without an id goes under a negative number made of its
    text, unless an item with an id has that text; a column named ``leaks``, in any letter case, gives way; no
    rows give no rows. Items are indexed in slices of about ``index_chars`` characters, one alive at a time, so
    what tasks receive is bounded; each slice is one pass over the texts.
    """
    spark = docs.sparkSession
    usable = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    usable = usable.filter((F.length("t") >= min_chars) & F.rlike("t", F.lit(r"[^\s]")))
    named, unnamed = usable.filter("i IS NOT NULL"), usable.filter("i IS NULL").select("t").distinct()
    made = -F.xxhash64("t").bitwiseAND(F.lit((1 << 62) - 1)) - 1
    usable = named.unionByName(unnamed.join(named, "t", "left_anti").select(made.alias("i"), "t"))
    total = usable.agg(F.sum(F.length("t"))).first()[0] or 0
    slices = -(-total // index_chars) or 1
    aside = Aside(docs, leaks_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")

    def index_of(k: int):
        part = usable.filter(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k).distinct().orderBy("i", "t")
        by_gram: dict[int, list] = {Q: []}
        for r in part.toLocalIterator():
            # Items shorter than a gram are grams of their own length.
            by_gram.setdefault(min(len(r["t"]), Q), []).append((r["i"], r["t"]))
        return spark.sparkContext.broadcast([(q, build_index(items, q)) for q, items in by_gram.items()])

    if slices == 1:
        schema = T.StructType([*aside.fields, T.StructField("__leaks", LEAKS)])
        found = docs.select(*aside.take, text).mapInArrow(_searched(index_of(0), aside.working), schema)
        return found.select(*aside.give, F.col("__leaks").alias(leaks_col))

    # Rows are written with a number once; each slice is a job of its own that writes the rows with regions, and its
    # index is gone before the next is sent.
    scratch = Scratch(spark, "decontam")
    placed = scratch.table(docs.select(F.monotonically_increasing_id().alias("__n"), *aside.take, text), "rows")
    schema = T.StructType([T.StructField("__n", T.LongType()), T.StructField("__leaks", LEAKS)])
    for k in range(slices):
        index = index_of(k)
        found = placed.select("__n", "__text").mapInArrow(_searched(index, ["__n"]), schema)
        found.filter(F.size("__leaks") > 0).write.parquet(scratch.path(f"found/slice={k}"))
        index.destroy()
    by_slice = spark.read.schema(schema.add("slice", T.IntegerType())).parquet(scratch.path("found"))
    met = by_slice.groupBy("__n").agg(F.array_sort(F.collect_list(F.struct("slice", "__leaks"))).alias("__by"))
    met = met.select("__n", F.flatten(F.transform("__by", lambda x: x["__leaks"])).alias("__leaks"))
    return placed.drop("__text").join(met, "__n", "left").select(
        *aside.give, F.coalesce("__leaks", F.array().cast(LEAKS)).alias(leaks_col)
    )
