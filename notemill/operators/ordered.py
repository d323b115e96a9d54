"""Global ranks and running totals that never put one order into one task.

Both work in two levels: rows fall into buckets that follow the order, each bucket
is ranked or summed on its own, and the bucket totals (a small table) give the
offset to add. ``by`` groups may be as large as the whole input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.functions.naming import seeded_key
from notemill.runtime import stage

_ONE = "__one"
_BUCKET = "__bucket"


def hash_rank(
    df: DataFrame,
    id_cols: Sequence[str],
    seed: int = 42,
    by: Sequence[str] = (),
    rank_col: str = "rank",
    total_col: str = "total",
    hex_digits: int = 3,
) -> DataFrame:
    """Rank (from 1) of each row in the seeded order, and the row count, per ``by``.

    The order is md5 of seed and ids, so its leading hex digits cut it into
    ``16 ** hex_digits`` even buckets whatever the ids are. Ids must be unique; NULL is
    an id and a group like others.
    """
    key = seeded_key(seed, *[F.col(c) for c in id_cols])
    keyed = df.withColumn("__key", key).withColumn(
        _BUCKET, F.conv(F.substring("__key", 1, hex_digits), 16, 10).cast("int")
    ).withColumn(_ONE, F.lit(1))
    groups = [_ONE, *by]
    totals = keyed.groupBy(*groups, _BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*groups).orderBy(_BUCKET)
    whole = Window.partitionBy(*groups)
    offsets = totals.select(
        *[F.col(c).alias(f"__at_{i}") for i, c in enumerate([*groups, _BUCKET])],
        F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias(total_col),
    )
    local = F.row_number().over(Window.partitionBy(*groups, _BUCKET).orderBy("__key", *id_cols))
    same = [F.col(c).eqNullSafe(F.col(f"__at_{i}")) for i, c in enumerate([*groups, _BUCKET])]
    return (
        keyed.withColumn("__local", local)
        .join(offsets, same)
        .select(*df.columns, (F.col("__before") + F.col("__local")).alias(rank_col), total_col)
    )


def dense_codes(df: DataFrame, col: str, out: str, first: Column | None = None) -> DataFrame:
    """``(col, out)``: distinct values numbered from 0 in their order, those where ``first`` holds before all others.

    Values are ranged over partitions, staged, and numbered there; a row for each partition is all that
    is added up in one place, so the number of values does not matter.
    """
    spark = df.sparkSession
    order = [~first if first is not None else F.lit(False), F.col(col)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(col).distinct().repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = stage(ranged.withColumn("__at", F.monotonically_increasing_id()), "codes")
    part = F.shiftright("__at", 33)
    starts, total = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        starts.append((r["part"], total))
        total += r["count"]
    offsets = spark.createDataFrame(starts, "__part long, __start long")
    met = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row for each partition
    return met.select(col, (F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias(out))


def quantile_bucket(df: DataFrame, order_col: str, n_buckets: int | None = None) -> DataFrame:
    """Add an INT bucket that follows a DOUBLE column's order in about even shares.

    The bounds (at most ``n_buckets`` numbers) are approximate quantiles; they only
    steer balance, every row keeps its exact place in the order.
    """
    if n_buckets is None:
        n_buckets = min(1000, max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    probabilities = [i / n_buckets for i in range(1, n_buckets)]
    found = df.stat.approxQuantile(order_col, probabilities, 0.5 / n_buckets)
    splits = [float("-inf"), *sorted(set(found) - {float("-inf"), float("inf")}), float("inf")]
    if len(splits) == 2:
        return df.withColumn(_BUCKET, F.lit(0))
    bucketizer = Bucketizer(splits=splits, inputCol=order_col, outputCol="__slot", handleInvalid="keep")
    return bucketizer.transform(df).withColumn(_BUCKET, F.col("__slot").cast("int")).drop("__slot")


def magnitude_buckets(c: Column) -> tuple[Column, Column]:
    """Two INT digits that follow a DOUBLE's order: the 64th of an octave, and its 16,384th part of that.

    Nothing about the data is asked beforehand. The logarithm never falls where its argument rises, so neither do the
    digits taken together; NaN comes last, as Spark sorts it.
    """
    size = (F.log2(F.abs(c)) + 1100) * 64
    signed = F.when(c > 0, size).when(c < 0, -size).otherwise(0.0)
    key = F.when(F.isnan(c), 1e6).when(c == float("inf"), 9e5).when(c == float("-inf"), -9e5).otherwise(signed)
    coarse = F.floor(key)
    return coarse.cast("int"), F.floor((key - coarse) * 16384).cast("int")


def running_sums(df: DataFrame, by: Sequence[str], order_col: str, sums: dict[str, Column]) -> DataFrame:
    """Sums of all rows before each in the order of a DOUBLE column, whose values are unique within ``by``.

    Three levels: inside a fine bucket, over the fine buckets of a coarse one (16,384 at most), and over the coarse
    ones. Planning starts no job.
    """
    coarse, fine = magnitude_buckets(F.col(order_col))
    work = df.withColumn("__coarse", coarse).withColumn("__fine", fine).withColumn(_ONE, F.lit(1))
    groups = [_ONE, *by]
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    parts = work.groupBy(*groups, "__coarse", "__fine").agg(*[F.sum(v).alias(f"__t_{n}") for n, v in sums.items()])
    inner = parts
    for n in sums:
        inner = inner.withColumn(f"__c_{n}", F.coalesce(F.sum(f"__t_{n}").over(before([*groups, "__coarse"], "__fine")), zero))
    whole = parts.groupBy(*groups, "__coarse").agg(*[F.sum(f"__t_{n}").alias(f"__t_{n}") for n in sums])
    for n in sums:
        whole = whole.withColumn(f"__w_{n}", F.coalesce(F.sum(f"__t_{n}").over(before(groups, "__coarse")), zero))
    offsets = inner.join(whole.select(*groups, "__coarse", *[f"__w_{n}" for n in sums]), [*groups, "__coarse"])
    for n, v in sums.items():
        work = work.withColumn(f"__l_{n}", F.coalesce(F.sum(v).over(before([*groups, "__coarse", "__fine"], order_col)), zero))
    met = work.join(offsets.select(*groups, "__coarse", "__fine", *[f"__{k}_{n}" for n in sums for k in "cw"]), [*groups, "__coarse", "__fine"])
    return met.select(*df.columns, *[(F.col(f"__l_{n}") + F.col(f"__c_{n}") + F.col(f"__w_{n}")).alias(n) for n in sums])


def running(
    df: DataFrame,
    by: Sequence[str],
    order_cols: Sequence[str],
    bucket: Column | str,
    aggregates: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``, ``max`` or ``count`` per ``by`` group in the order of ``order_cols``.

    ``bucket`` must not fall where ``order_cols`` rises (for instance the hour of a
    timestamp, or a step number divided by 4096). ``aggregates`` maps each new column
    to ``(kind, value)``. Order columns must be unique within a group; groups are not NULL.
    """
    bucket = F.col(bucket) if isinstance(bucket, str) else bucket
    groups = [_ONE, *by]
    work = df.withColumn(_ONE, F.lit(1)).withColumn("__slice", bucket)
    kinds = {"sum": F.sum, "max": F.max, "count": F.count}
    end = 0 if inclusive else -1
    within = Window.partitionBy(*groups, "__slice").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*groups).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = work.groupBy(*groups, "__slice").agg(
        *[kinds[kind](value).alias(f"__t_{name}") for name, (kind, value) in aggregates.items()]
    )
    carry = totals.select(
        *groups,
        "__slice",
        *[
            (F.max if kind == "max" else F.sum)(f"__t_{name}").over(before).alias(f"__c_{name}")
            for name, (kind, _) in aggregates.items()
        ],
    )
    local = work
    for name, (kind, value) in aggregates.items():
        local = local.withColumn(f"__l_{name}", kinds[kind](value).over(within))

    def merged(name: str, kind: str) -> Column:
        inner, outer = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind == "max":
            return F.greatest(inner, outer)
        zero = F.lit(0)
        return F.coalesce(inner, zero) + F.coalesce(outer, zero)

    joined = local.join(carry, [*groups, "__slice"])
    return joined.select(
        *df.columns,
        *[merged(name, kind).alias(name) for name, (kind, _) in aggregates.items()],
    )
