"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType


def unroll(
    df: DataFrame, keep: Sequence[str], array: Column | str, item: str, pos: str | None = None
) -> DataFrame:
    """One row per array element, with ``keep`` columns and its position if named.

    For a plain explode of a computed column Catalyst adds a filter on the array's
    size below the computation, which then runs twice. The outer form has no such
    filter; the rows of empty arrays are dropped here instead.
    """
    place = pos or "__pos"
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, item)).filter(F.col(place).isNotNull())
    return rows if pos else rows.drop(place)


def spread_join(rows: DataFrame, facts: DataFrame, keys: Sequence[str], salts: int = 16) -> DataFrame:
    """Inner join of many rows with one small fact row per key; NULL keys meet NULL keys.

    As ``salted_join``, with the salt from the plain columns that are no key (the length and the first characters of
    strings), so that rows of one key go to many tasks wherever the facts are not small enough to broadcast.
    """
    plain = [f for f in rows.schema if f.name not in keys and not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    narrow = [x for f in plain for x in ([F.length(f.name), F.substring(f.name, 1, 32)] if isinstance(f.dataType, StringType) else [F.col(f.name)])]
    part = F.pmod(F.xxhash64(*narrow), F.lit(salts)).cast("int") if plain else F.lit(0)
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1 if plain else 0)))
    names = [c for c in facts.columns if c not in keys]
    right = facts.select(*[F.col(c).alias(f"__k_{i}") for i, c in enumerate(keys)], *names, copies.alias("__part"))
    same = [F.col(c).eqNullSafe(F.col(f"__k_{i}")) for i, c in enumerate(keys)]
    left = rows.drop(*names).withColumn("__salt", part)
    joined = left.join(right, [*same, F.col("__salt") == F.col("__part")])
    rest = [c for c in rows.columns if c not in keys and c not in names]
    return joined.select(*keys, *rest, *names)


def salted_join(rows: DataFrame, facts: DataFrame, key: str, salt_on: Sequence[str], salts: int = 16) -> DataFrame:
    """Inner join of many rows with one fact row per key, when one key may own most rows.

    Rows of a key are cut into ``salts`` parts by the hash of ``salt_on`` and each part
    meets its own copy of the key's facts.
    """
    part = F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = rows.withColumn("__salt", part)
    return left.join(facts.withColumn("__salt", copies), [key, "__salt"]).drop("__salt")
