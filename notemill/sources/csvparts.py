"""CSV with line breaks in quoted fields, read by many tasks.

A line break ends a record where the number of quotes before it in the file is even (an escaped quote counts twice).
So one pass counts the quotes of each byte range, the counts are added up along each file, and every range is
then cut into records from its true state. Only records that cross a range's border are stitched.
"""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

WHOLE, OPEN, MIDDLE, CLOSE = range(4)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and the start of the byte range that each begins in; in the file's order inside a task."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _states(lines: DataFrame) -> dict[tuple[str, int], int]:
    """Whether each range begins inside quotes; a row for each range comes to the driver."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).cast("int").alias("odd")).collect()
    states, now, at = {}, 0, None
    for r in sorted(odd, key=lambda r: (r["file"], r["block"])):
        now = now if r["file"] == at else 0
        states[r["file"], r["block"]] = now
        now, at = now ^ r["odd"], r["file"]
    return states


def _pieces(states, header: list[str] | None):
    """For ``mapInArrow``: lines to (file, block, kind, text): whole records, and parts of those that cross a border."""

    def run(batches):
        import pyarrow.compute as pc

        at, inside, leading, held = None, 0, False, []

        def left_over():
            return [(*at, MIDDLE if leading else OPEN, "\n".join(held))] if held else []

        for batch in batches:
            files, blocks, values = batch.column(0), batch.column(1).to_numpy(), batch.column(2).fill_null("")
            coded = files.dictionary_encode()
            name, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            odd = (pc.count_substring(values, '"').to_numpy() & 1).astype(np.int64)
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(blocks) != 0)) + 1
            out, plain = [], []
            for a, b in zip([0, *cuts], [*cuts, len(values)]) if len(values) else ():
                here, first = (name[code[a]], int(blocks[a])), 0
                if here != at:
                    out += left_over()
                    at, inside, held = here, states.value[here], []
                    leading = bool(inside)
                    if header is not None and here[1] == 0:
                        names = next(csv.reader([values[int(a)].as_py().removeprefix("﻿").rstrip("\r")]), [])
                        if names != header:
                            raise ValueError(f"{here[0]} has the columns {names}, not {header}")
                        first = 1
                after = inside ^ (np.cumsum(odd[a + first : b]) & 1)
                before = np.r_[inside, after[:-1]][: len(after)]
                alone = (before == 0) & (after == 0)
                plain.append(a + first + np.flatnonzero(alone))
                # What is left are the lines of records with line breaks in them.
                for k in np.flatnonzero(~alone):
                    held.append(values[int(a + first + k)].as_py())
                    if not after[k]:
                        out.append((*at, CLOSE if leading else WHOLE, "\n".join(held)))
                        held, leading = [], False
                inside = int(after[-1]) if len(after) else inside
            rows = np.concatenate(plain) if plain else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [files.take(pa.array(rows)), pa.array(blocks[rows]), pa.array(np.full(len(rows), WHOLE), pa.int32()), values.take(pa.array(rows))],
                names=["file", "block", "kind", "text"],
            )
            if out:
                yield _batch(out)
        if at is not None and held:
            yield _batch(left_over())

    return run


def _batch(rows):
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "block", "kind", "text"])


def records(spark: SparkSession, path: str, header: list[str] | None) -> DataFrame:
    """``text`` of every record, the header (which must be ``header``) left out; blank lines between records are none."""
    lines = _lines(spark, path)
    states = spark.sparkContext.broadcast(_states(lines))
    pieces = lines.mapInArrow(_pieces(states, header), "file string, block long, kind int, text string")
    parts = pieces.filter(F.col("kind") != WHOLE)
    # A range has two parts at most: the end of a record, then the beginning of one.
    along = Window.partitionBy("file").orderBy("block", F.desc("kind"))
    numbered = parts.withColumn("record", F.sum((F.col("kind") == OPEN).cast("int")).over(along))
    ordered = F.array_sort(F.collect_list(F.struct("block", (-F.col("kind")).alias("kind"), "text")))
    stitched = numbered.groupBy("file", "record").agg(F.array_join(ordered["text"], "\n").alias("text")).select("text")
    every = pieces.filter(F.col("kind") == WHOLE).select("text").unionByName(stitched)
    return every.select(F.regexp_replace("text", r"\r$", "").alias("text")).filter("text <> ''")


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    names = [f.name for f in schema]
    return records(spark, path, names).select(F.from_csv("text", _ddl(schema), options).alias("r")).select("r.*")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
