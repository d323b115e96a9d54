"""The caller's columns under working names, so that none meets a name of an operator.

Spark takes names that differ in letter case for one, so names are compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Aside:
    """The columns of ``df`` but those called ``giving_way`` (in any letter case)."""

    def __init__(self, df: DataFrame, *giving_way: str):
        gone = {n.lower() for n in giving_way}
        self.names = [c for c in df.columns if c.lower() not in gone]
        self.working = [f"__c{i}" for i in range(len(self.names))]
        self.fields = [T.StructField(w, df.schema[c].dataType) for w, c in zip(self.working, self.names)]
        #: From the caller's names to working ones, and back.
        self.take = [_named(c).alias(w) for w, c in zip(self.working, self.names)]
        self.give = [F.col(w).alias(c) for w, c in zip(self.working, self.names)]


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns but ``used`` under working names, and the columns that give it its own form again."""
    rest = Aside(df, *used)
    back = dict(zip(rest.names, rest.give))
    kept = [c for c in df.columns if c not in back]
    return df.select(*[_named(c) for c in kept], *rest.take), [back.get(c, _named(c)) for c in df.columns]


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def hashable(df: DataFrame) -> dict[str, Column]:
    """The columns of ``df`` in a form that can be hashed: those that hold maps, whose order is not defined, as JSON."""
    return {f.name: F.to_json(F.struct(_named(f.name))) if _holds_map(f.dataType) else _named(f.name) for f in df.schema}
