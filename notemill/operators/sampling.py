"""Class counts, seeded samples, splits and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.functions.naming import seeded_key
from notemill.operators.ordered import hash_rank
from notemill.operators.rows import spread_join



def class_count(df: DataFrame, label_col: str) -> DataFrame:
    """Number of classes, on the train split where ``df`` has splits."""
    if "split" in df.columns:
        df = df.filter(F.col("split") == "train")
    return df.agg(F.countDistinct(label_col).alias("n_classes"))


def class_sizes(df: DataFrame, label_col: str) -> DataFrame:
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def split_sizes(df: DataFrame, doc_col: str | None = None, rows_name: str = "n_rows") -> DataFrame:
    """Rows per split, and documents per split where rows are sentences."""
    if doc_col is None:
        return df.groupBy("split").agg(F.count(F.lit(1)).alias(rows_name))
    per_doc = df.groupBy("split", doc_col).agg(F.count(F.lit(1)).alias("__n"))
    return per_doc.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("__n").alias(rows_name))


def rows_of_class(df: DataFrame, label_col: str, value) -> DataFrame:
    return df.filter(F.col(label_col) == value)


def few_shot(df: DataFrame, label_col: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """First ``n`` rows per class in the seeded order; smaller classes stay whole.

    The seeded key cuts a class into 4,096 even buckets in order; only the ids of the
    buckets that hold its first ``n`` are ranked, however large the class and ``n`` are.
    The chosen ids then pick the wide rows.
    """
    keys = df.select(label_col, id_col).filter(F.col(label_col).isNotNull())
    keys = keys.withColumn("__key", seeded_key(seed, F.col(id_col))).withColumn(
        "__bucket", F.conv(F.substring("__key", 1, 3), 16, 10).cast("int")
    )
    before = Window.partitionBy(label_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = keys.groupBy(label_col, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    needed = totals.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).filter(F.col("__before") < n)
    survivors = keys.join(needed.select(label_col, "__bucket"), [label_col, "__bucket"], "left_semi")
    whole = Window.partitionBy(label_col).orderBy("__key", id_col)
    chosen = survivors.withColumn("__r", F.row_number().over(whole)).filter(F.col("__r") <= n)
    if set(df.columns) == {label_col, id_col}:
        return chosen.select(*df.columns)
    return df.join(chosen.select(id_col, label_col), [id_col, label_col], "left_semi")


def few_shot_splits(
    df: DataFrame,
    label_col: str,
    id_col: str,
    train_n: int | None = None,
    eval_n: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Sample the train and validation splits; the test split is never sampled."""
    rest, parts = df, []
    for split, n in (("train", train_n), ("validation", eval_n)):
        if n is not None:
            parts.append(few_shot(df.filter(F.col("split") == split), label_col, n, id_col, seed))
            rest = rest.filter(F.col("split") != split)
    for part in parts:
        rest = rest.unionByName(part)
    return rest


def group_split(
    df: DataFrame,
    key: Sequence[str] | str,
    frac: float = 0.9,
    by: Sequence[str] | str = (),
    seed: int = 42,
    names: tuple[str, str] = ("train", "validation"),
) -> DataFrame:
    """One row per group with its split: the first ``floor(frac * N)`` in seeded order.

    ``by`` makes the cut within each site.
    """
    key = [key] if isinstance(key, str) else list(key)
    by = [by] if isinstance(by, str) else list(by)
    groups = df.select(*by, *key).distinct()
    ranked = hash_rank(groups, key, seed, by)
    cut = F.floor(F.col("total") * F.lit(float(frac)))
    side = F.when(F.col("rank") <= cut, F.lit(names[0])).otherwise(F.lit(names[1]))
    return ranked.select(*by, *key, side.alias("split"))


def assign_split(df: DataFrame, split_map: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Rows with the split of their group; groups missing from the map drop out.

    A NULL key is a group of its own, and a group with very many rows is spread over tasks.
    """
    return spread_join(df, split_map, [key] if isinstance(key, str) else list(key))


def halve_split(
    df: DataFrame, id_col: str, seed: int = 42, names: tuple[str, str] = ("validation", "test")
) -> DataFrame:
    """Cut rows into two halves in seeded order; an odd row goes to the second.

    The order is over distinct ids: rows that share an id, or have none, stay together.
    """
    ranked = hash_rank(df.select(id_col).distinct(), [id_col], seed)
    side = F.when(F.col("rank") <= F.floor(F.col("total") / 2), F.lit(names[0])).otherwise(F.lit(names[1]))
    return spread_join(df.drop("split"), ranked.select(id_col, side.alias("split")), [id_col])


def with_test_split(df: DataFrame, id_col: str, has_test: bool, seed: int = 42) -> DataFrame:
    """Derive the test split from validation where a dataset has none."""
    if has_test:
        return df
    halves = halve_split(df.filter(F.col("split") == "validation"), id_col, seed)
    return df.filter(F.col("split") != "validation").unionByName(halves.select(*df.columns))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded_key(seed, F.col(id_col)), id_col)


def take(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def preview_row(df: DataFrame, id_col: str, seed: int = 42, i: int = 1) -> DataFrame:
    """Row ``i`` (from 0) of the seeded order."""
    return seeded_shuffle(df, id_col, seed).offset(i).limit(1)


def merge_corpora(corpora: dict[str, DataFrame]) -> DataFrame:
    """Union of corpora with the name of each in ``corpus``."""
    parts = [df.withColumn("corpus", F.lit(name)) for name, df in corpora.items()]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def id_set_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with the side that has them."""
    tagged = (
        left.select(key).withColumn("__l", F.lit(True)).withColumn("__r", F.lit(False))
        .unionAll(right.select(key).withColumn("__l", F.lit(False)).withColumn("__r", F.lit(True)))
    )
    sides = tagged.groupBy(key).agg(F.bool_or("__l").alias("__l"), F.bool_or("__r").alias("__r"))
    side = F.when(F.col("__l"), F.lit("left")).otherwise(F.lit("right"))
    return sides.filter(F.col("__l") != F.col("__r")).select(key, side.alias("only_in"))


def sentences_by_group(df: DataFrame, split_map: DataFrame, key: str, *order: str) -> DataFrame:
    """Sentences in document order within their group and split.

    Rows stay rows; the order becomes a range-partitioned sort, never a collected
    group.
    """
    return assign_split(df, split_map, key).orderBy("split", key, *order)
