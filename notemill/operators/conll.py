"""Sentences with tags: vocabularies, checks, cleaning, sentence ids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import text as tx
from notemill.functions.arrays import let
from notemill.operators.ordered import dense_codes, running
from notemill.operators.rows import unroll

_MAX_TAGS = 100_000


def label_vocab(spans: DataFrame) -> DataFrame:
    """``O``, then ``B-`` and ``I-`` of each annotated type."""
    types = spans.filter(F.col("type").isNotNull()).select("type").distinct()
    both = types.select(
        F.explode(F.array(F.concat(F.lit("B-"), "type"), F.concat(F.lit("I-"), "type"))).alias("tag")
    )
    outside = spans.sparkSession.range(1).select(F.lit("O").alias("tag"))
    return both.unionAll(outside)


def tag_vocab(df: DataFrame, tag_col: str = "labels") -> DataFrame:
    """``(tag, tag_id)`` over all splits; ``O`` is 0, the others follow by name."""
    tags = df.select(F.explode(F.array_distinct(tag_col)).alias("tag")).distinct()
    return dense_codes(tags, "tag", "tag_id", first=F.col("tag") == "O")


def tag_count(tags: DataFrame) -> DataFrame:
    return tags.agg(F.count(F.lit(1)).alias("n_tags"))


def tag_list(tags: DataFrame) -> list[str]:
    """Tags by id on the driver; a vocabulary, so its size is checked."""
    rows = tags.orderBy("tag_id").limit(_MAX_TAGS + 1).collect()
    if len(rows) > _MAX_TAGS:
        raise ValueError(f"more than {_MAX_TAGS} tags: this is not a tag vocabulary")
    return [row["tag"] for row in rows]


#: Beyond so many tags a hash table is asked; the search through an array would look at half of them for each token.
_FEW = 64


def _tag_array(tags: Sequence[str]) -> Column:
    return F.lit(list(tags)) if tags else F.array().cast("array<string>")


def _by_table(tags: Sequence[str], kind: str):
    """Arrow function from tags to ids, or with ``array<string>`` from ids to tags; what is unknown becomes NULL."""
    known = pa.array(list(tags), pa.string())

    @F.arrow_udf(kind)
    def coded(values: pa.Array) -> pa.Array:
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = values.flatten()
        if kind == "array<int>":
            found = pc.index_in(flat, value_set=known.cast(flat.type), skip_nulls=True)
        else:
            inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(known)))
            found = known.take(pc.if_else(inside, flat, pa.scalar(None, flat.type)).cast(pa.int32()))
        sizes = pc.list_value_length(values)
        ends = pc.cumulative_sum(pc.fill_null(sizes, 0)).to_numpy().tolist()
        offsets = pa.array([0, *ends], pa.int32(), mask=np.r_[~pc.is_valid(values).to_numpy(zero_copy_only=False), False])
        return pa.ListArray.from_arrays(offsets, found)

    return coded


def encode_tags(df: DataFrame, tags: Sequence[str], tag_col: str = "labels", out: str = "ner_tags") -> DataFrame:
    """Tag names to ids; a tag outside the vocabulary becomes NULL."""
    if len(tags) > _FEW:
        return df.withColumn(out, _by_table(tags, "array<int>")(F.col(tag_col)))
    known = _tag_array(tags)
    ids = F.transform(
        tag_col, lambda t: F.nullif(F.array_position(known, t), F.lit(0).cast("bigint")) - 1
    )
    return df.withColumn(out, ids.cast("array<int>"))


def decode_tags(df: DataFrame, tags: Sequence[str], id_col: str, out: str) -> DataFrame:
    if len(tags) > _FEW:
        return df.withColumn(out, _by_table(tags, "array<string>")(F.col(id_col)))
    known = _tag_array(tags)
    return df.withColumn(out, F.transform(id_col, lambda i: F.get(known, i)))


def unseen_labels(df: DataFrame, vocab: DataFrame, tag_col: str = "labels") -> DataFrame:
    """Tags that the vocabulary lacks, with their number."""
    found = unroll(df, [], tag_col, "tag").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return found.join(vocab.select("tag"), "tag", "left_anti")


def label_histogram(df: DataFrame, tag_col: str = "labels") -> DataFrame:
    return unroll(df, [], tag_col, "tag").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def label_format_violations(df: DataFrame, tag_col: str = "labels") -> DataFrame:
    """Labels that are neither ``O`` nor ``B-…`` nor ``I-…``, with their number."""
    return label_histogram(df, tag_col).filter(~F.rlike("tag", F.lit("^(O|B-.*|I-.*)$")))


def scheme_breaks(tags: Column) -> Column:
    """How often ``I-x`` follows neither ``B-x`` nor ``I-x`` in an array of tags."""

    def broken(seq: Column) -> Column:
        def odd(tag: Column, i: Column) -> Column:
            before = F.coalesce(F.when(i > 0, F.get(seq, i - 1)), F.lit("O"))
            return tag.startswith("I-") & ((before == "O") | (F.substring(before, 3, 2**31 - 1) != F.substring(tag, 3, 2**31 - 1)))

        return F.size(F.filter(F.transform(seq, odd), lambda x: x))

    return let(tags, broken)


def drop_empty_sentences(df: DataFrame) -> DataFrame:
    return df.filter(F.size("tokens") > 0)


def drop_unencodable(df: DataFrame, lengths_col: str, parallel: Sequence[str]) -> DataFrame:
    """Remove positions of zero pieces from the lengths and from all parallel arrays."""


    def kept(values: Column) -> Column:
        pairs = F.zip_with(values, lengths_col, lambda v, x: F.struct(v.alias("v"), x.alias("x")))
        return F.transform(F.filter(pairs, lambda p: p["x"] > 0), lambda p: p["v"])

    names = [*parallel, lengths_col]
    rest = [c for c in df.columns if c not in names]
    cleaned = df.select(*rest, *[kept(F.col(c)).alias(c) for c in names])
    return cleaned.filter(F.size(lengths_col) > 0).select(*df.columns)


def split_long_sentences(
    df: DataFrame, lengths_col: str, parallel: Sequence[str], max_len: int = 512
) -> DataFrame:
    """Cut sentences where the running piece count passes ``max_len``.

    The count restarts at 0 (not at the length of the token that overflowed), which
    no window can express: a fold per sentence collects the break positions only.
    Adds ``part``, the number of the piece within its sentence.
    """
    df = drop_unencodable(df, lengths_col, parallel)
    zero = F.struct(
        F.lit(0).alias("count"), F.lit(0).alias("pos"), F.array().cast("array<int>").alias("breaks")
    )

    def step(acc: Column, x: Column) -> Column:
        over = acc["count"] + x > max_len
        return F.struct(
            F.when(over, F.lit(0)).otherwise((acc["count"] + x).cast("int")).alias("count"),
            (acc["pos"] + 1).alias("pos"),
            F.when(over, F.concat(acc["breaks"], F.array(acc["pos"]))).otherwise(acc["breaks"]).alias("breaks"),
        )

    breaks = F.aggregate(F.col(lengths_col), zero, step)["breaks"]
    starts = df.withColumn("__starts", F.concat(F.array(F.lit(0)), breaks))
    n = F.size(lengths_col)
    stop = F.coalesce(F.get(F.col("__starts"), F.col("part") + 1), n)
    cut = unroll(starts, [*df.columns, "__starts"], "__starts", "__from", "part").withColumn(
        "__n", stop - F.col("__from")
    ).filter(F.col("__n") > 0)
    for name in [*parallel, lengths_col]:
        cut = cut.withColumn(name, F.slice(name, F.col("__from") + 1, F.col("__n")))
    return cut.drop("__starts", "__from", "__n")


def sentence_ids(lines: DataFrame, file_col: str, line_col: str, text_col: str) -> DataFrame:
    """Sentence number of each line: how many blank lines come before it in its file.

    A file of any length is summed in stretches of its lines.
    """
    blank = F.when(tx.is_blank(F.col(text_col)), F.lit(1)).otherwise(F.lit(0))
    return running(
        lines,
        [file_col],
        [line_col],
        F.floor(F.col(line_col) / 65536),
        {"sent_id": ("sum", blank)},
        inclusive=False,
    )
