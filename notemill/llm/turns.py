"""Rows of conversations in one global order, and digests of whole conversations."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.scratch import Scratch, partitions


def in_order(turns: DataFrame, scratch: Scratch, watch=None, schema=None) -> DataFrame:
    """Rows of ``conv_id``, ``turn``, ``role``, ``text`` and others, sorted over all partitions and written.

    Nulls come first; rows of one conversation and turn go by role, then by a hash of
    the text. Adds ``part`` (its range) and ``at`` (the place in it): ranges follow each
    other, and inside one the rows of a conversation are adjacent. A conversation of any size
    is spread over as many ranges as it fills, also where all its rows are equal. ``watch`` (a function
    for ``mapInArrow``, with its ``schema``) sees each range in its order before it is written.
    """
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("text"), F.col("__tie")]
    dealt = turns.withColumn("__tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = dealt.drop("__tie")
    if watch is not None:
        dealt = dealt.mapInArrow(watch, schema)
    place = F.monotonically_increasing_id()
    numbered = dealt.withColumn("part", F.shiftright(place, 33).cast("int")).withColumn("at", place.bitwiseAND(F.lit((1 << 33) - 1)))
    return scratch.table(numbered, "turns")


def digests(rows: DataFrame, order: list[str], columns: dict[str, str]) -> DataFrame:
    """SHA-256 of the strings of each conversation, joined in the order of ``order``.

    ``columns`` names the string columns and what separates their values; they come back as lower-case
    digests. Rows stream through, and only the running state of the conversation at hand is held; a
    digest is a chain, so one conversation's rows pass through one task.
    """
    session = rows.sparkSession
    key = rows.schema["conv_id"]
    dealt = rows.repartition(partitions(session), "conv_id").sortWithinPartitions("conv_id", *order)
    names, gaps = list(columns), [g.encode() for g in columns.values()]
    schema = T.StructType([key, *[T.StructField(c, T.StringType()) for c in names]])

    def run(batches):
        import pyspark.sql.pandas.types as convert

        arrow = convert.to_arrow_schema(schema)
        now, states, seen = None, None, False
        for batch in batches:
            done = []
            ids = batch.column(0).to_pylist()
            values = [batch.column(k + 1).cast(pa.binary()).to_pylist() for k in range(len(names))]
            for i, conv in enumerate(ids):
                if not seen or conv != now:
                    if seen:
                        done.append((now, *[s.hexdigest() for s in states]))
                    now, states, seen, first = conv, [hashlib.sha256() for _ in names], True, True
                for state, column, gap in zip(states, values, gaps):
                    if not first and gap:
                        state.update(gap)
                    state.update(column[i] or b"")
                first = False
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
        if seen:
            last = (now, *[s.hexdigest() for s in states])
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(last, arrow)], schema=arrow)

    return dealt.select("conv_id", *names).mapInArrow(run, schema)
