"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a hash of its documents. A source's target in words
becomes an exact number of blocks to draw; these quotas are split down a binary tree,
where each node deals half of its blocks to either side as a random draw without
replacement would, until every output shard has its quota of each source. Each shard
then takes the next run of the source's permuted blocks and orders its rows by a hash.
Only tables with one row for each block, source or shard are ordered in one place. All
of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.functions.arrays import let
from notemill.llm.columns import Aside
from notemill.llm.scratch import Scratch, partitions

MAX_SOURCES = 100_000
BROADCAST_ROWS = 200_000
BLOCKS, SEED = 1024, 42


@dataclass
class Mixture:
    """``rows``: id, source, block, size, source_size, target, draws, taken of each document.
    ``plan``: the shards that each (source, block) goes to. ``mixed``: the documents
    drawn, once for each draw, with ``shard`` and ``place``, their order in it."""

    rows: DataFrame
    plan: DataFrame
    mixed: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Add ``rank``, ``weight`` and ``target`` to one row per source with its ``source_size``.

    Weights repeat along the sources in code point order, null last. A target stops at
    ``cap`` times the source's size, and the excess goes to the others by weight: all
    targets are the smaller of their cap and one level times their weight. Sorted by
    the level at which they are full, the first source that is not full sets it.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("weight", F.get(table, F.pmod("rank", F.lit(len(weights))))).withColumn(
        "__full_at", F.col("source_size") * cap / F.col("weight")
    )
    along = everything.orderBy("__full_at", "rank")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0))
    wanted = F.sum("source_size").over(everything) * share
    levels = weighed.withColumn("__level", (wanted - capped) / F.sum("weight").over(after)).withColumn(
        "__n", F.row_number().over(along)
    )
    open_at = F.min(F.when(F.col("__level") <= F.col("__full_at"), F.struct("__n", "__level"))).over(everything)
    level = F.coalesce(open_at["__level"], F.lit(float("inf")))
    return levels.select(
        "source", "source_size", "rank", "weight",
        F.least(F.col("source_size") * cap, level * F.col("weight")).alias("target"),
    )


def draws(blocks: DataFrame, sources: DataFrame, seed: int, top_ups: int = 2, orders: int = 8) -> DataFrame:
    """Blocks to draw, one row (source, rank, block, pass) for each draw.

    A source is drawn whole as often as its target holds its size. Of the rest, blocks in
    permuted order are drawn while they fit; then, up to ``top_ups`` times, the block that
    comes nearest to what is missing, if that brings the source nearer to its target. Of
    ``orders`` permutations the one that ends nearest to the target counts.
    """
    joined = blocks.join(sources, F.col("b_source").eqNullSafe(F.col("source"))).drop("b_source")
    size = F.greatest(F.col("source_size"), F.lit(1))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int")
    order = F.xxhash64(F.lit(seed), F.lit("order"), "trial", "rank", "block")
    per = Window.partitionBy("rank", "trial")
    chosen = (
        joined.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
        .withColumn("whole", whole)
        .withColumn("__rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .withColumn("__order", order)
        .withColumn("__sum", F.sum("words").over(per.orderBy("__order", "block").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("part", F.col("__sum") <= F.col("__rest"))
    )
    for _ in range(top_ups):
        missing = F.col("__rest") - F.coalesce(F.sum(F.when(F.col("part"), F.col("words"))).over(per), F.lit(0))
        chosen = chosen.withColumn("__missing", missing)
        gap = F.when(
            ~F.col("part") & (F.col("words") > 0) & (F.abs(F.col("__missing") - F.col("words")) < F.abs(F.col("__missing"))),
            F.struct(F.abs(F.col("__missing") - F.col("words")), F.col("__order"), F.col("block")),
        )
        chosen = chosen.withColumn("__gap", gap).withColumn("__best", F.min("__gap").over(per)).withColumn(
            "part", F.col("part") | F.coalesce(F.col("__gap") == F.col("__best"), F.lit(False))
        )
    drawn = F.coalesce(F.sum(F.when(F.col("part"), F.col("words"))).over(per), F.lit(0))
    ended = chosen.withColumn("__off", F.struct(F.abs(F.col("__rest") - drawn), F.col("trial")))
    best = F.min("__off").over(Window.partitionBy("rank"))
    passes = F.col("whole") + F.col("part").cast("int")
    return ended.withColumn("__best", best).filter((F.col("__off") == F.col("__best")) & (passes > 0)).select(
        "source", "rank", "block", F.explode(F.sequence(F.lit(1), passes)).alias("pass")
    )


def _log_factorial(n: Column) -> Column:
    """Stirling's series, eight places up."""
    z = n + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = F.lit(0.0)
    for i in range(1, 9):
        product = product + F.log(n + float(i))
    return series - product


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Number of good ones among ``drawn`` of ``total``, by inversion of ``u`` in (0, 1).

    The sum runs over the support, or over the 12 standard deviations around the mean
    where that is shorter; what lies beyond has a probability below 1e-30.
    """

    def mean(a: Column) -> Column:
        return F.when(a["n"] > 0, a["m"] * a["k"] / a["n"]).otherwise(0.0)

    def spread(a: Column, mu: Column) -> Column:
        n = a["n"]
        return F.when(n > 1, F.sqrt(mu * (1 - a["k"] / n) * (n - a["m"]) / (n - 1))).otherwise(0.0) * 12 + 12

    def bounds(a: Column, mu: Column, s: Column) -> Column:
        low = F.greatest(F.lit(0.0), a["m"] + a["k"] - a["n"], F.floor(mu - s).cast("double"))
        high = F.greatest(low, F.least(a["m"], a["k"], F.ceil(mu + s).cast("double")))
        return F.struct(low.alias("low"), high.alias("high"))

    def choose(a: Column, b: Column) -> Column:
        return _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)

    def invert(a: Column, b: Column) -> Column:
        n, k, m, low = a["n"], a["k"], a["m"], b["low"]
        first = F.exp(choose(k, low) + choose(n - k, m - low) - choose(n, m))
        zero = F.struct(first.alias("p"), F.lit(0.0).alias("below"), low.alias("at"))

        def step(acc: Column, i: Column) -> Column:
            x = i.cast("double")
            below = acc["below"] + acc["p"]
            ratio = (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))
            return F.struct(
                (acc["p"] * ratio).alias("p"),
                below.alias("below"),
                F.when(below < u, x + 1).otherwise(acc["at"]).alias("at"),
            )

        steps = F.sequence(low.cast("long"), b["high"].cast("long"))
        return F.least(F.aggregate(steps, zero, step, lambda acc: acc["at"]), b["high"]).cast("long")

    args = F.struct(total.cast("double").alias("n"), good.cast("double").alias("k"), drawn.cast("double").alias("m"))

    def within(a: Column) -> Column:
        return let(mean(a), lambda mu: let(spread(a, mu), lambda s: let(bounds(a, mu, s), lambda b: invert(a, b))))

    return let(args, within)


def split_quotas(quotas: DataFrame, depth: int, seed: int, scratch: Scratch) -> DataFrame:
    """Split one row ``q`` (blocks of each source) into ``2 ** depth`` shards.

    At every node the left side gets half of the blocks, a multivariate hypergeometric
    draw taken source by source; the right side gets the others. Each level, a row for each
    node, is written before the next is planned.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), "q")
    for level in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        none = F.array().cast("array<bigint>")
        zero = F.struct(total.alias("rest"), F.floor(total / 2).cast("long").alias("need"), none.alias("left"))

        node = F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"))

        def step(acc: Column, x: Column) -> Column:
            bits = F.pmod(F.xxhash64(node, x["i"]), F.lit(1 << 52))  # noqa: B023
            u = (bits.cast("double") + 0.5) / float(1 << 52)
            got = hypergeometric(acc["rest"], x["q"], acc["need"], u)
            return F.struct(
                (acc["rest"] - x["q"]).alias("rest"),
                (acc["need"] - got).alias("need"),
                F.concat(acc["left"], F.array(got)).alias("left"),
            )

        indexed = F.transform("q", lambda q, i: F.struct(q.alias("q"), i.alias("i")))
        left = F.aggregate(indexed, zero, step, lambda acc: acc["left"])
        sides = nodes.select("shard", "q", left.alias("__left")).select(
            F.explode(
                F.array(
                    F.struct((F.col("shard") * 2).alias("shard"), F.col("__left").alias("q")),
                    F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("q", "__left", lambda a, b: a - b).alias("q")),
                )
            ).alias("n")
        )
        nodes = scratch.table(sides.select("n.shard", "n.q"), f"level-{level}")
    return nodes


def block_of(name: Column, text: Column, blocks: int = BLOCKS, seed: int = SEED) -> Column:
    """Block of a document, a hash of its id and text."""
    return F.pmod(F.xxhash64(F.lit(seed), name, text), F.lit(blocks)).cast("int")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    blocks: int = BLOCKS,
    depth: int = 3,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mixture:
    """Draw ``share`` times all words from the sources by weight, into ``2 ** depth`` shards.

    A document's block is a hash of its id and text, so reruns agree and repeated rows
    go together. No document is drawn more than ``cap`` times, rounded up. A null text has size 0, a null
    source is a source of its own, and an empty table gives no rows. Documents of size 0
    go where their block goes. ``mixed`` has all columns of ``docs``; there, columns named
    ``shard`` or ``place``, in any letter case, give way to the operator's. Over 100,000 sources are refused.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    block = block_of(F.col(id_col), F.col(text_col), blocks, seed)
    sized = scratch.table(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            block.alias("block"), word_count(F.col(text_col)).alias("size"),
        ),
        "sized",
    )
    sums = scratch.table(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    per_source = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = scratch.table(targets(per_source, weights, share, cap), "sources")
    n_sources = sources.count()
    if n_sources > MAX_SOURCES:
        raise ValueError(f"{n_sources} sources; at most {MAX_SOURCES} fit the quota row of a shard")
    drawn = scratch.table(draws(sums.withColumnRenamed("source", "b_source"), sources, seed), "draws")

    permuted = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), "rank", "pass", "block"), "pass", "block")
    items = drawn.withColumn("idx", (F.row_number().over(permuted) - 1).cast("long"))
    counts = drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    whole = sources.select("rank").join(counts, "rank", "left").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", F.coalesce("n", F.lit(0)).cast("long").alias("n")))),
            lambda x: x["n"],
        ).alias("q")
    )
    leaves = split_quotas(whole, depth, seed, scratch).select("shard", F.posexplode("q").alias("rank", "n"))
    upto = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = leaves.withColumn("__from", F.coalesce(F.sum("n").over(upto), F.lit(0))).filter("n > 0").select(
        "rank", "shard", F.explode(F.sequence(F.col("__from"), F.col("__from") + F.col("n") - 1)).alias("idx")
    )
    # A row for each block of every source, which Spark rates as one for each shard: never to be broadcast.
    plan = scratch.table(
        items.join(runs.hint("merge"), ["rank", "idx"]).groupBy("source", "block").agg(
            F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws")
        ),
        "plan",
    )
    # One row a block; broadcast only as far as that stays small, joined by shuffles beyond.
    small = plan.count() <= BROADCAST_ROWS
    keyed = plan.select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), "draws")
    keyed = F.broadcast(keyed) if small else keyed
    known = sources.select(F.col("source").alias("s_source"), "source_size", "target")
    known = F.broadcast(known) if n_sources <= BROADCAST_ROWS else known

    rows = (
        sized.join(keyed, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")), "left")
        .join(known, F.col("source").eqNullSafe(F.col("s_source")))
        .select(
            "id", "source", "block", "size", "source_size", "target",
            F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:bigint>>")).alias("draws"),
        )
        .withColumn("taken", F.col("size") * F.size("draws"))
    )
    aside = Aside(docs, "shard", "place")
    under = {c.lower(): w for c, w in zip(aside.names, aside.working)}
    named = [F.col(under[c.lower()]) for c in (id_col, text_col)]
    mixed = (
        docs.select(*aside.take, F.col(source_col).cast("string").alias("__source"), block.alias("__block"))
        .join(keyed, F.col("__source").eqNullSafe(F.col("p_source")) & (F.col("__block") == F.col("p_block")))
        .select(*aside.working, F.explode("draws").alias("__draw"))
        .select(
            *aside.give, F.col("__draw.shard").alias("shard"),
            F.xxhash64(F.lit(seed), F.col("__draw.shard"), F.col("__draw.pass"), *named).alias("place"),
        )
    )
    return Mixture(rows, plan, mixed)


def shuffled(mixed: DataFrame) -> DataFrame:
    """The drawn rows of each shard together, in their local order."""
    n = partitions(mixed.sparkSession)
    return mixed.repartitionByRange(n, "shard", "place").sortWithinPartitions("shard", "place")


def write(mixed: DataFrame, folder: str) -> DataFrame:
    """Write the drawn rows as a folder for each shard, in their local order, and read them back."""
    shuffled(mixed).write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    return mixed.sparkSession.read.schema(mixed.schema).parquet(folder)


def taken(
    rows: DataFrame, written: DataFrame, blocks: int = BLOCKS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``rows`` of a mixture with ``taken`` from the words of each document in the shards as written.

    Rows of one id, source, block and size share the copies evenly.
    """
    key = ["id", "source", "block", "size"]
    copies = written.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        block_of(F.col(id_col), F.col(text_col), blocks, seed).alias("block"), word_count(F.col(text_col)).alias("size"),
    )
    both = rows.select(*key, F.lit(1).alias("n"), F.lit(0).cast("long").alias("words")).unionByName(
        copies.withColumn("n", F.lit(0)).withColumn("words", F.col("size").cast("long"))
    )
    found = both.groupBy(*[F.col(c).alias(f"w_{c}") for c in key]).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    met = rows.drop("taken").join(found, [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in key])
    return met.withColumn("taken", F.expr("words div n")).drop(*[f"w_{c}" for c in key], "n", "words")
