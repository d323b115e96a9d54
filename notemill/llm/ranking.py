"""Ranked lexical search: dense tiles of item weights times document impacts, top-k a tile.

A document's score for an item is a sum of integer products ``weight * impact`` over the item's
terms. Impacts of a tile of documents and weights of a tile of items, over the vocabulary
of these items alone, are multiplied by BLAS in float64. Vocabulary tiles are so narrow that no partial
sum reaches 2^53, so products and sums are exact; tiles are added up as 64-bit integers.

Items are searched slice by slice, each of a bounded size and written before the next begins: one
slice's vocabulary and weights are all that tasks are sent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from notemill.llm.scratch import Scratch
from notemill.llm.words import text_slices, word_hashes, words

#: About so many characters of items are searched at once.
SLICE_CHARS = 8_000_000
DOC_TILE, ITEM_TILE, TERM_TILE = 512, 64, 4096
EXACT = 1 << 53
#: No impact reaches this: ``(10^9 tf) div (1000 tf + 8 m)`` with ``m`` above 0.
IMPACT = 1_000_000

# Terms are runs of ASCII letters and digits and of all other characters beyond ASCII.
_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given stretches, one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)


@dataclass
class Vocabulary:
    """Distinct terms, in the order of their hashes, with their bytes on end."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    letters: np.ndarray

    @classmethod
    def of(cls, terms: list[bytes]) -> Vocabulary:
        letters = np.frombuffer(b"".join(terms), np.uint8)
        lengths = np.array([len(t) for t in terms], np.int64)
        starts = np.cumsum(lengths) - lengths
        hashes = word_hashes(letters, starts, lengths, lower=False, space=_BREAK)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two terms of the items share a 64-bit hash")
        order = np.argsort(hashes)
        return cls(hashes[order], starts[order], lengths[order], letters)

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, or -1; equal hashes are compared letter by letter."""
        if not len(self.hashes) or not len(starts):
            return np.full(len(starts), -1)
        hashes = word_hashes(data, starts, lengths, space=_BREAK)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[at] == lengths))
        size = lengths[hit]
        same = _LOWER[data[_ragged(starts[hit], size)]] == self.letters[_ragged(self.starts[at[hit]], size)]
        wrong = np.add.reduceat(~same, np.cumsum(size) - size, dtype=np.int64) if len(hit) else np.zeros(0, np.int64)
        out = np.full(len(starts), -1)
        out[hit[wrong == 0]] = at[hit[wrong == 0]]
        return out


def terms(text: str) -> list[bytes]:
    """Terms of one text, in order."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, lengths, _ = words(data, np.array([0, len(data)]), space=_BREAK)
    low = _LOWER[data].tobytes()
    return [low[s : s + n] for s, n in zip(starts, lengths)]


def _counts(vocabulary, key: T.StructField):
    """For ``mapInArrow``: (id, text) to id, number of terms, and places and counts of those in the vocabulary."""
    schema = T.StructType([key, T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyspark.sql.pandas.types as convert

        arrow = convert.to_arrow_schema(schema)
        known = vocabulary.value
        width = max(len(known.hashes), 1)
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                starts, lengths, n = words(data, offsets, space=_BREAK)
                place = known.find(data, starts, lengths)
                doc = np.repeat(np.arange(end - first), n)
                cells, tf = np.unique(doc[place >= 0] * width + place[place >= 0], return_counts=True)
                ends = np.searchsorted(cells, np.arange(end - first + 1) * width).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v, t)) for v, t in ((cells % width, pa.int32()), (tf, pa.int64()))]
                row = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first).cast(arrow.field(0).type), pa.array(n, pa.int64()), *[x.cast(f.type) for x, f in zip(lists, list(arrow)[2:])]], schema=arrow
                )
                yield row.filter(pc.greater(row.column(1), 0))

    return run, schema


@dataclass
class Tile:
    """Some items: their numbers, and dense weights over the narrow tiles of their own vocabulary."""

    items: np.ndarray
    terms: list[np.ndarray]
    weights: list[np.ndarray]


def item_tiles(items: list[tuple[int, list[int]]], weight: np.ndarray) -> list[Tile]:
    """``items`` holds numbers and distinct term places; ``weight`` is that of each place."""
    top = int(weight.max(initial=0))
    # So many products of a weight and an impact stay below 2^53 in sum.
    width = int(min(TERM_TILE, max(1, (EXACT - 1) // max(1, top * IMPACT))))
    tiles = []
    for a in range(0, len(items), ITEM_TILE):
        part = items[a : a + ITEM_TILE]
        used = np.unique(np.concatenate([np.array(t, np.int64) for _, t in part]))
        tile = Tile(np.array([i for i, _ in part]), [], [])
        for b in range(0, len(used), width):
            some = used[b : b + width]
            dense = np.zeros((len(some), len(part)))
            for k, (_, t) in enumerate(part):
                mine = np.intersect1d(some, t)
                dense[np.searchsorted(some, mine), k] = weight[mine]
            tile.terms.append(some)
            tile.weights.append(dense)
        tiles.append(tile)
    return tiles


def scores(ends: np.ndarray, ids: np.ndarray, impacts: np.ndarray, tile: Tile) -> np.ndarray:
    """Exact scores of a tile of documents (rows) for a tile of items (columns)."""
    docs = len(ends) - 1
    row = np.repeat(np.arange(docs), np.diff(ends))
    total = np.zeros((docs, len(tile.items)), np.int64)
    for some, dense in zip(tile.terms, tile.weights):
        at = np.minimum(np.searchsorted(some, ids), len(some) - 1)
        here = some[at] == ids
        block = np.zeros((docs, len(some)))
        block[row[here], at[here]] = impacts[here]
        total += (block @ dense).astype(np.int64)
    return total


def _best(table: pa.Table, k: int) -> pa.Table:
    """The k first rows of each item, by descending score, then id, nulls last."""
    order = pc.sort_indices(table, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end")
    table = table.take(order)
    item = table.column("item").to_numpy()
    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
    return table.filter(pa.array(rank < k))


def _multiply(tiles, n_docs: int, n_terms: int, k: int, key: T.StructField):
    """For ``mapInArrow``: counted documents to the k best of each item among the rows of a task."""
    schema = T.StructType([T.StructField("item", T.LongType()), key, T.StructField("score", T.LongType())])

    def run(batches):
        import pyspark.sql.pandas.types as convert

        arrow = convert.to_arrow_schema(schema)
        best, least = arrow.empty_table(), {}
        for batch in batches:
            n = batch.column(1).to_numpy()
            m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
            found = []
            for a in range(0, len(n), DOC_TILE):
                ids, tfs = batch.column(2).slice(a, DOC_TILE), batch.column(3).slice(a, DOC_TILE)
                ends = np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy())]
                ids, tf = ids.flatten().to_numpy(), tfs.flatten().to_numpy()
                impacts = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m[a : a + DOC_TILE], np.diff(ends)))
                for tile in tiles.value:
                    score = scores(ends, ids, impacts, tile)
                    # A row below the k-th of the task so far, or of this tile, is out; one level with it stays until ids decide.
                    bar = np.array([least.get(int(i), 1) for i in tile.items])
                    if len(score) > k:
                        bar = np.maximum(bar, np.partition(score, len(score) - k, axis=0)[len(score) - k])
                    doc, item = np.nonzero(score >= bar)
                    if len(doc):
                        key_column = batch.column(0).take(pa.array(doc + a)).cast(arrow.field(1).type)
                        part = pa.table([pa.array(tile.items[item]), key_column, pa.array(score[doc, item])], schema=arrow)
                        found.append(_best(part.rename_columns(["item", "id", "score"]), k))
            if found:
                best = _best(pa.concat_tables([best.rename_columns(["item", "id", "score"]), *found]), k)
                item, score = best.column("item").to_numpy(), best.column("score").to_numpy()
                last = np.flatnonzero(np.r_[item[1:] != item[:-1], True])
                many = np.diff(np.r_[-1, last]) >= k
                least = dict(zip(item[last[many]].tolist(), score[last[many]].tolist()))
        for out in best.rename_columns(arrow.names).to_batches():
            yield out

    return run, schema


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    Terms are runs of ``A-Za-z0-9`` and characters beyond ASCII, only A-Z lower-cased. With N documents that
    have a term, L terms in them, n in this one, a term in df documents and tf times in this one:
    the term weighs ``floor(1000 ln((2N+2)/(2df+1)))``, the document's m is ``10 + (90 n N) div L``, and the score sums
    weight times ``(10^9 tf) div (1000 tf + 8 m)`` over the item's distinct terms.

    Scores of 0 are left out; equal ones go by ascending id, nulls last. A null text has no terms. Every row is a
    document, also with an id that others have, and every row of ``items`` an item; items without terms or
    documents give no rows. Other columns are left out. A text of any length is one row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = texts.schema["id"]
    asked = scratch.table(
        items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
        .withColumn("item", F.monotonically_increasing_id()), "items",
    )
    size = asked.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    slices = max(1, -(-size // slice_chars))
    found = []
    for s in range(slices):
        # Dealt by hash, so each slice holds about ``slice_chars``; an item longer than that is one by itself.
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == s).select("item", "text").collect()
        said = [(r["item"], set(terms(r["text"]))) for r in part]
        vocabulary = Vocabulary.of(sorted(set().union(*[t for _, t in said])))
        order = {vocabulary.letters[a : a + n].tobytes(): i for i, (a, n) in enumerate(zip(vocabulary.starts, vocabulary.lengths))}
        placed = [(i, sorted(order[t] for t in t_set)) for i, t_set in said if t_set]
        if not placed:
            continue
        sent = spark.sparkContext.broadcast(vocabulary)
        counted = scratch.table(texts.mapInArrow(*_counts(sent, key)), f"counts-{s}")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(order), np.int64)
        # A row for each term of the slice at most.
        for r in counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
            df[r["id"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        tiles = spark.sparkContext.broadcast(item_tiles(placed, weight))
        hits = scratch.table(counted.filter(F.size("ids") > 0).mapInArrow(*_multiply(tiles, n_docs, n_terms, k, key)), f"best-{s}")
        found.append(hits)
        scratch.drop(f"counts-{s}")
        sent.destroy()
        tiles.destroy()
    if not found:
        return asked.limit(0).select("item_id", F.lit(1).alias("rank"), F.lit(None).cast(key.dataType).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    top = hits.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
