"""Sub-word vocabularies learned by pair merges, and two matchers that take a whole batch at once.

Learning works on the table of distinct words. A word is spelled ``<p><##l><##a>``, its first character plain and the
others marked, and a merge is a replacement in that string. Pair counts are not taken anew for each merge: the driver
holds the most frequent pairs with exact counts, and every job returns only how some merges change them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import text as tx
from notemill.functions.arrays import let
from notemill.runtime import drop_path, fresh_path

INNER = "##"
_BASES = 1024


class Merge(NamedTuple):
    left: str
    right: str
    n: int

    @property
    def joined(self) -> str:
        return self.left + self.right[len(INNER) :]


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``(word, n)`` of a text column."""
    words = df.select(F.explode(tx.word_pieces(F.col(text_col))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def spelled(word: Column) -> Column:
    marked = F.transform(F.split(word, ""), lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(INNER), c)))
    return F.concat(F.lit("<"), F.array_join(marked, "><"), F.lit(">"))


def _merged(symbols: Column, merges: Sequence[Merge]) -> Column:
    for m in merges:
        symbols = F.replace(symbols, F.lit(f"<{m.left}><{m.right}>"), F.lit(f"<{m.joined}>"))
    return symbols


def _pairs(symbols: Column, n: Column) -> Column:
    parts = F.split(F.substr(symbols, F.lit(2), F.length(symbols) - 2), "><")
    pair = lambda a, b: F.struct(a.alias("left"), b.alias("right"), n.alias("n"))
    return let(parts, lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), pair))


class _Counts:
    """Exact counts of the most frequent pairs; any other pair has at most ``floor``."""

    def __init__(self, rows: list, floor: int):
        self.n = {(r["left"], r["right"]): r["n"] for r in rows}
        self.floor = floor
        self.heap = [(-n, *pair) for pair, n in self.n.items()]
        heapq.heapify(self.heap)

    def best(self) -> Merge | None:
        while self.heap and self.n.get(self.heap[0][1:]) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return Merge(self.heap[0][1], self.heap[0][2], -self.heap[0][0]) if self.heap else None

    def set(self, pair: tuple[str, str], n: int) -> None:
        self.n[pair] = n
        if n > 0:
            heapq.heappush(self.heap, (-n, *pair))

    def first(self, most: int) -> list[Merge]:
        """The best pairs in order, up to one that shares a symbol with a better one."""
        out, used, taken = [], set(), []
        while len(out) < most:
            m = self.best()
            if m is None or (out and m.n <= self.floor) or {m.left, m.right} & used:
                break
            taken.append(heapq.heappop(self.heap))
            out.append(m)
            used |= {m.left, m.right, m.joined}
        for entry in taken:
            heapq.heappush(self.heap, entry)
        return out


def learn_merges(
    words: DataFrame, n_merges: int = 8000, min_count: int = 2, ahead: int = 16, kept: int = 50_000
) -> list[Merge]:
    """The merges of byte-pair training over ``(word, n)``, in the order they are learned.

    Each time the most frequent pair of adjacent symbols is joined everywhere, the least pair on ties. A job
    tries ``ahead`` merges in a row on the words that hold one of them; they count as long as each is still the best pair
    after those before it. At most ``kept`` pairs, and the changes by one job, come to the driver.
    """
    spark = words.sparkSession
    merges: list[Merge] = []
    pending: list[Merge] = []
    path = fresh_path(spark, "words")
    words.filter(F.length("word") > 1).select(spelled(F.col("word")).alias("symbols"), F.col("n").cast("long").alias("n")).write.parquet(path)
    names: set[str] = set()
    counts: _Counts | None = None
    while len(merges) < n_merges:
        if len(pending) >= 32:
            # The merges so far are written into the words, so that plans stay short.
            done = fresh_path(spark, "words")
            spark.read.parquet(path).select(_merged(F.col("symbols"), pending).alias("symbols"), "n").write.parquet(done)
            drop_path(spark, path)
            path, pending = done, []
        fresh = counts is None or len(counts.n) > 4 * kept or counts.best() is None or (counts.floor and counts.best().n <= counts.floor)
        if fresh:
            now = spark.read.parquet(path).select(_merged(F.col("symbols"), pending).alias("symbols"), "n")
            pairs = now.select(F.explode(_pairs(F.col("symbols"), F.col("n"))).alias("p")).groupBy("p.left", "p.right").agg(F.sum("p.n").alias("n"))
            top = pairs.orderBy(F.desc("n"), "left", "right").limit(kept).collect()
            counts = _Counts(top, top[-1]["n"] if len(top) == kept else 0)
        tried = counts.first(min(ahead, n_merges - len(merges)))
        if not tried or tried[0].n < min_count:
            break
        changes = _changes(spark.read.parquet(path), pending, tried)
        for i, m in enumerate(tried):
            best = counts.best()
            if best != m or m.n < min_count or (i and m.n <= counts.floor):
                break
            merges.append(m)
            pending.append(m)
            for left, right, n in changes.get(i, ()):
                if (left, right) in counts.n:
                    counts.set((left, right), counts.n[left, right] + n)
                elif m.joined in (left, right):
                    counts.set((left, right), n)
            if m.joined in names:
                # The symbol was there before, so counts of its pairs outside the list are not known.
                counts = None
                break
            names.add(m.joined)
    drop_path(spark, path)
    return merges


def _pair_sums(symbols: pa.Array, n: np.ndarray) -> list[tuple[str, str, int]]:
    """Counts of the adjacent symbols of some words."""
    import pyarrow.compute as pc

    parts = pc.split_pattern(pc.utf8_slice_codeunits(symbols, 1, -1), "><")
    coded = parts.flatten().dictionary_encode()
    code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    word = np.repeat(np.arange(len(n)), pc.list_value_length(parts).to_numpy())
    inside = np.flatnonzero(word[1:] == word[:-1])
    pairs, of = np.unique(code[inside] * size + code[inside + 1], return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, of, n[word[inside]])
    names = coded.dictionary.to_pylist()
    return [(names[p // size], names[p % size], t) for p, t in zip(pairs.tolist(), total.tolist())]


def _changes(rows: DataFrame, pending: Sequence[Merge], merges: Sequence[Merge]) -> dict[int, list[tuple[str, str, int]]]:
    """How each of some merges, one after the other, changes the counts of pairs.

    Arrow replaces in whole batches; only words that a merge changes are taken apart. The plan is the same for
    all merges, so no code is compiled anew.
    """

    def run(batches):
        import pyarrow.compute as pc

        def put(symbols, m):
            return pc.replace_substring(symbols, f"<{m.left}><{m.right}>", f"<{m.joined}>")

        sums: dict[tuple, int] = {}
        for batch in batches:
            symbols, n = batch.column(0), batch.column(1)
            for m in pending:
                symbols = put(symbols, m)
            for i, m in enumerate(merges):
                after = put(symbols, m)
                changed = pc.not_equal(symbols, after)
                times = n.filter(changed).to_numpy()
                for sign, side in ((-1, symbols), (1, after)):
                    for left, right, total in _pair_sums(side.filter(changed), times):
                        sums[i, left, right] = sums.get((i, left, right), 0) + sign * total
                symbols = after
        cells = [(*k, v) for k, v in sums.items() if v]
        if cells:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*cells), (pa.int32(), pa.string(), pa.string(), pa.int64()))], names=["i", "left", "right", "n"]
            )

    found = rows.select("symbols", "n").mapInArrow(run, "i int, left string, right string, n long")
    out: dict[int, list] = {}
    for r in found.groupBy("i", "left", "right").agg(F.sum("n").alias("n")).filter("n <> 0").collect():
        out.setdefault(r["i"], []).append((r["left"], r["right"], r["n"]))
    return out


def merge_vocab(words: DataFrame, merges: Sequence[Merge], specials: Sequence[str]) -> list[str]:
    """Specials, the marked and plain characters of the words, then the merged pieces in order."""
    marks = words.select(F.explode(F.split(F.substr(spelled(F.col("word")), F.lit(2), F.length(spelled(F.col("word"))) - 2), "><")).alias("c"))
    alphabet = [r["c"] for r in marks.distinct().orderBy("c").collect()]  # bounded by Unicode
    return list(dict.fromkeys([*specials, *alphabet, *[m.joined for m in merges]]))


# --- whole batches of words ------------------------------------------------------------


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words on end, and the number of each word's."""
    import pyarrow.compute as pc

    words = words.cast(pa.string()).fill_null("")
    sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
    if not len(words) or words.buffers()[2] is None:
        return np.zeros(0, np.uint32), sizes
    offsets = np.frombuffer(words.buffers()[1], np.int32)
    data = words.buffers()[2].slice(int(offsets[words.offset]), int(offsets[words.offset + len(words)] - offsets[words.offset]))
    return np.frombuffer(data.to_pybytes().decode().encode("utf-32-le"), np.uint32), sizes


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


class MergeTable:
    """Merges as sorted pairs of piece ids, applied to all words of a batch in step."""

    def __init__(self, tokens: Sequence[str], merges: Sequence[Merge], unknown: int):
        at = {t: i for i, t in enumerate(tokens)}
        self.size, self.unknown = len(tokens), unknown
        single = [sorted((ord(t[len(mark) :]), i) for t, i in at.items() if t.startswith(mark) and len(t) == len(mark) + 1) for mark in ("", INNER)]
        self.codes = [np.array([c for c, _ in s], np.uint32) for s in single]
        self.ids = [np.array([i for _, i in s], np.int64) for s in single]
        pairs = sorted((at[m.left] * self.size + at[m.right], rank, at[m.joined]) for rank, m in enumerate(merges))
        self.pairs, self.ranks, self.joined = (np.array([p[k] for p in pairs], np.int64) for k in range(3))

    def _first_ids(self, letters: np.ndarray, inner: np.ndarray) -> np.ndarray:
        out = np.full(len(letters), -1)
        for k, rows in ((0, ~inner), (1, inner)):
            if len(self.codes[k]):
                place = np.minimum(np.searchsorted(self.codes[k], letters), len(self.codes[k]) - 1)
                out = np.where(rows & (self.codes[k][place] == letters), self.ids[k][place], out)
        return out

    def match(self, words: pa.Array) -> pa.ListArray:
        """Piece ids of each word; a word with a character beyond the vocabulary is one unknown piece."""
        letters, sizes = _letters(words)
        word = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.ones(len(letters), bool)
        inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        ids = self._first_ids(letters, inner)
        bad = np.unique(word[ids < 0])
        keep = ~np.isin(word, bad)
        keep[(np.cumsum(sizes) - sizes)[bad]] = True
        ids[np.isin(word, bad)] = self.unknown
        ids, word = ids[keep], word[keep]
        never = np.int64(1) << 40
        last = np.full(len(sizes), -1)
        while len(ids) > 1 and len(self.pairs):
            key = ids[:-1] * self.size + ids[1:]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.where((self.pairs[place] == key) & (word[:-1] == word[1:]), self.ranks[place], never)
            # Merges are applied in the order learned: none before the last one that a word has had.
            rank[rank <= last[word[:-1]]] = never
            least = np.full(len(sizes), never)
            np.minimum.at(least, word[:-1], rank)
            here = np.flatnonzero((rank < never) & (rank == least[word[:-1]]))
            if not len(here):
                break
            # Of pairs that overlap, the first, third, … of a run.
            begins = np.r_[True, (np.diff(here) != 1) | (word[here[1:]] != word[here[:-1]])]
            start = np.maximum.accumulate(np.where(begins, np.arange(len(here)), 0))
            here = here[(np.arange(len(here)) - start) % 2 == 0]
            last[word[here]] = rank[here]
            ids[here] = self.joined[place[here]]
            stay = np.ones(len(ids), bool)
            stay[here + 1] = False
            ids, word = ids[stay], word[stay]
        return _lists(ids, np.bincount(word, minlength=len(sizes)))


class Trie:
    """Double-array trie over plain pieces and, from a root of their own, over marked ones.

    A state's child by a character lies at ``base[state] + character``, if ``check`` there names the state.
    """

    def __init__(self, tokens: Sequence[str], unknown: int):
        self.unknown = unknown
        self.codes = np.unique(np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)) if tokens else np.zeros(0, np.uint32)
        code_of = {c: k + 1 for k, c in enumerate(self.codes.tolist())}
        nodes: list[dict[int, int]] = [{}, {}]
        ends = {}
        for i, token in enumerate(tokens):
            marked = token.startswith(INNER) and len(token) > len(INNER)
            for root, text in ((0, token), (1, token[len(INNER) :])) if marked else ((0, token),):
                node = root
                for c in text:
                    nxt = nodes[node].get(code_of[ord(c)])
                    if nxt is None:
                        nxt = nodes[node][code_of[ord(c)]] = len(nodes)
                        nodes.append({})
                    node = nxt
                if text:
                    ends.setdefault(node, i)
        self._place(nodes, ends)

    def _place(self, nodes: list[dict[int, int]], ends: dict[int, int]) -> None:
        """Give every node a slot: children of a node go to the first base where all their slots are free."""
        width = len(self.codes) + 2
        size = 2 * len(nodes) + 4 * width
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, bool)
        taken[:2] = True
        slot, low, queue = {0: 0, 1: 1}, 2, [0, 1]
        for node in queue:
            children = np.array(sorted(nodes[node]), np.int64)
            if not len(children):
                continue
            while taken[low]:
                low += 1
            at = max(low - int(children[0]), 0)
            while True:
                if at + width + _BASES >= len(taken):
                    more = len(taken) + _BASES
                    base, check, value = (np.concatenate([a, np.full(more, f, np.int32)]) for a, f in ((base, 0), (check, -1), (value, -1)))
                    taken = np.concatenate([taken, np.zeros(more, bool)])
                # Many bases are looked at together.
                clash = np.zeros(_BASES, bool)
                for c in children.tolist():
                    clash |= taken[at + c : at + c + _BASES]
                free = int(clash.argmin())
                at += _BASES if clash[free] else free
                if not clash[free]:
                    break
            taken[at + children] = True
            base[slot[node]], check[at + children] = at, slot[node]
            for c, child in nodes[node].items():
                slot[child] = at + c
                value[at + c] = ends.get(child, -1)
                queue.append(child)
        used = int(np.flatnonzero(taken).max()) + width + 1
        self.base, self.check, self.value = base[:used], check[:used], value[:used]

    def match(self, words: pa.Array) -> pa.ListArray:
        """Greedy longest match of all words in step; a word with a part that no piece covers is one unknown piece."""
        letters, sizes = _letters(words)
        if len(self.codes):
            place = np.minimum(np.searchsorted(self.codes, letters), len(self.codes) - 1)
            code = np.where(self.codes[place] == letters, place + 1, 0)
        else:
            code = np.zeros(len(letters), np.int64)
        begin = np.cumsum(sizes) - sizes
        end = begin + sizes
        live = np.flatnonzero(sizes > 0)
        at, state = begin[live].copy(), np.zeros(len(live), np.int64)
        best, best_end = np.full(len(live), -1), begin[live].copy()
        found_word, found_id = [], []
        unknown = np.zeros(len(sizes), bool)
        while len(live):
            inside = at < end[live]
            c = np.where(inside, code[np.minimum(at, len(code) - 1)], 0)
            child = self.base[state] + c
            go = inside & (c > 0) & (self.check[child] == state)
            state = np.where(go, child, state)
            at = at + go
            hit = go & (self.value[state] >= 0)
            best = np.where(hit, self.value[state], best)
            best_end = np.where(hit, at, best_end)
            # Where the walk ends, the longest piece on it is taken and the next walk starts behind it.
            stop = ~go
            piece = stop & (best >= 0)
            unknown[live[stop & (best < 0)]] = True
            found_word.append(live[piece])
            found_id.append(best[piece])
            more = go | (piece & (best_end < end[live]))
            at, state, best = np.where(piece, best_end, at), np.where(piece, 1, state), np.where(piece, -1, best)
            live, at, state, best, best_end = live[more], at[more], state[more], best[more], best_end[more]
        word = np.concatenate([*found_word, np.zeros(0, np.int64)])
        ids = np.concatenate([*found_id, np.zeros(0, np.int64)])
        known = ~unknown[word]
        word, ids = np.r_[word[known], np.flatnonzero(unknown)], np.r_[ids[known], np.full(int(unknown.sum()), self.unknown)]
        order = np.argsort(word, kind="stable")
        return _lists(ids[order], np.bincount(word, minlength=len(sizes)))


#: Words that are matched, and handed on, at once; a longer array goes alone.
_SLICE = 500_000


def coded_slices(matcher: MergeTable | Trie, words: pa.Array) -> Iterator[pa.Array]:
    """Piece ids of arrays of words, some arrays at a time; each distinct word of these is matched once."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(words), 0).cast(pa.int64()).to_numpy()
    total, first = np.cumsum(sizes), 0
    while first < len(words):
        last = max(first + 1, int(np.searchsorted(total, total[first] - sizes[first] + _SLICE, side="right")))
        coded = words.slice(first, last - first).flatten().dictionary_encode()
        inner = matcher.match(coded.dictionary).take(coded.indices)
        offsets = np.concatenate([[0], np.cumsum(sizes[first:last])]).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(offsets), inner)
        first = last
    if not len(words):
        yield pa.array([], pa.list_(pa.list_(pa.int32())))


def lookup(matcher: MergeTable | Trie):
    """Arrow function ``array<string> -> array<array<int>>``."""

    @F.arrow_udf("array<array<int>>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            yield from coded_slices(matcher, words)

    return ids
