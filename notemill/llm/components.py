"""Connected components of a link table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.scratch import Scratch


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), F.col("u") == F.col("c")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("u"), F.min("v")).alias("m"))
    larger = edges.select(F.col("v").alias("n"), F.col("u").alias("w"))  # every w has n as a smaller neighbour
    return larger.join(least.hint("merge"), F.col("n") == F.col("c")).select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(node, component) of every node with a link; the component is its least node.

    ``edges`` has columns ``a`` and ``b``; loops, repeats and nulls are left out. Each
    round is written to the shared folder; the driver sees its size and checksum only, as no join is a broadcast.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before, turn = scratch.table(now, f"{name}-0"), None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if mark == before or not mark[0]:
            break
        before, turn = mark, turn + 1
        new = scratch.table(_small_star(_large_star(now)), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        now = new
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
