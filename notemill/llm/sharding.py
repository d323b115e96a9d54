"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

A row's place is ``permute(row number)`` on ``0 .. n-1``; its shard and slot are the
remainder and quotient of that place by the number of shards. All three can be computed
for any row number, and inverted, without looking at any data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.llm.columns import Aside, hashable
from notemill.llm.scratch import Scratch, partitions
from notemill.llm.words import mix, stream

#: Numbers of one repeated row that one task copies out.
COPIES = 4096

_U = np.uint64


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _rounds(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask, shift = _U((1 << half) - 1), _U(half)
    left, right = x >> shift, x & mask
    with np.errstate(over="ignore"):
        for key in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mix(left + key) & mask), left
            else:
                left, right = right, left ^ (mix(right + key) & mask)
    return (left << shift) | right


def permute(x, n: int, seed: int = 42, rounds: int = 6, back: bool = False) -> np.ndarray:
    """Image of row numbers under a keyed permutation of ``0 .. n-1``; ``back`` inverts it.

    The network permutes the next even power of two, which is less than four times
    ``n``; numbers that fall outside walk along their cycle until they are inside.
    """
    out = np.asarray(x).astype(_U)
    half, keys = _half_bits(n), stream(seed, rounds)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _rounds(out[todo], half, keys, back)
        todo = todo[out[todo] >= _U(n)]
    return out.astype(np.int64)


def place_of(rows, n: int, shards: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    at = permute(rows, n, seed)
    return at % shards, at // shards


def rows_at(shard, slot, n: int, shards: int, seed: int = 42) -> np.ndarray:
    """Row numbers that lie in the given shards and slots."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, seed, back=True)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str = "row") -> tuple[DataFrame, int]:
    """Number rows from 0 in the order of ``order``, and count them.

    Rows are ranged over partitions once and numbered there; only the number of rows of
    each partition is added up in one place. Rows equal in ``order`` are spread by
    their place in the input, so a key that many rows share does not fill one task.
    """
    spark = rows.sparkSession
    keys = [*[F.col(c).asc_nulls_first() for c in order], F.col("__tie")]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    local = scratch.table(dealt.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), f"{name}-local")
    part = F.shiftright("__at", 33)
    counts = local.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    total = local.count()
    # One row of two numbers for each range partition, however many rows there are.
    out = local.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(
        name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    return out.drop("__part", "__before", "__at"), total


def shard(
    docs: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All documents with their shard and slot, row counts at most one apart.

    Adds ``size`` (UTF-8 bytes plus 16), ``text_crc32``, ``row`` (the number in
    the order of id, checksum and size), ``shard`` and ``slot`` (gapless from 0); columns of
    these names, in any letter case, give way. A null text counts as empty, a null id comes first; rows equal in
    all three each get their own slot. An empty table gives no rows.

    Only ids and hashes are ranged and numbered. Texts move once, to their numbers: rows equal in
    every column are one there, with as many numbers as they are; where these are many, runs of them go to
    many tasks. Columns that hold maps are compared as JSON.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    aside = Aside(docs, "size", "text_crc32", "row", "shard", "slot")
    known = hashable(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measured = [(F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).cast("long").alias("text_crc32")]
    same = [F.xxhash64(F.lit(k), *[v for c in aside.names for v in (known[c].isNull(), known[c])]).alias(f"__same{k}") for k in (1, 2)]
    narrow, n = numbered(docs.select(F.col(id_col).alias("__id"), *measured, *same), ["__id", "text_crc32", "size", "__same1", "__same2"], scratch)
    equal = narrow.groupBy("__same1", "__same2").agg(
        F.min("row").alias("__first"), F.count(F.lit(1)).alias("__n"), F.first("size").alias("size"), F.first("text_crc32").alias("text_crc32")
    )
    whole = docs.select(*aside.take, *same).groupBy("__same1", "__same2").agg(F.first(F.struct(*aside.working)).alias("__row"))
    met = lambda some: whole.join(some, ["__same1", "__same2"]).select("__row.*", "size", "text_crc32", "__first", "__n")
    few, many = met(equal.filter(F.col("__n") <= COPIES)), met(equal.filter(F.col("__n") > COPIES))
    # A row that repeats more often is cut into runs of its numbers, which are dealt to all tasks before they are copied out.
    runs = many.withColumn("__run", F.explode(F.expr(f"sequence(__first, __first + __n - 1, {COPIES})")))
    runs = runs.withColumn("__n", F.least(F.lit(COPIES), F.col("__first") + F.col("__n") - F.col("__run"))).drop("__first")
    runs = runs.withColumnRenamed("__run", "__first").repartition(partitions(docs.sparkSession), "__first")
    numbers = few.unionByName(runs).select(
        *aside.working, "size", "text_crc32", F.explode(F.expr("sequence(__first, __first + __n - 1)")).alias("row")
    )

    @F.pandas_udf("long")
    def at(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    placed = numbers.withColumn("__place", at("row"))
    return placed.select(
        *aside.give, "size", "text_crc32", "row",
        F.pmod("__place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"`__place` div {int(shards)}").alias("slot"),
    )


def write(placed: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``shard`` as a folder for each shard, ordered by slot, and read them back."""
    dealt = placed.repartitionByRange(partitions(placed.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    return placed.sparkSession.read.schema(placed.schema).parquet(folder)
