"""Array expressions: scores, running totals, entity chunks, row-local resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FOLD_WIDTH = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    An expression that a lambda mentions is evaluated again for each element; a
    lambda's own variable is not. So arrays that lambdas index are bound here first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(c: Column) -> Column:
    def scaled(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
        return let(total, lambda t: F.transform(exps, lambda v: v / t))

    def exps(top: Column) -> Column:
        return F.transform(c, lambda v: F.exp(v.cast("double") - top))

    return let(let(F.array_max(c).cast("double"), exps), scaled)


def argmax(c: Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def running_starts(lengths: Column) -> Column:
    """Exclusive running totals of an INT array.

    A fold that appends to its own result copies it each time, so the array is
    folded in stretches of fixed width and the stretches are then shifted: the work
    stays linear in the array's size.
    """

    def fold(values: Column) -> Column:
        zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(
            values,
            zero,
            lambda acc, v: F.struct(
                (acc["total"] + v).cast("int").alias("total"),
                F.concat(acc["starts"], F.array(acc["total"])).alias("starts"),
            ),
        )

    empty = F.array().cast("array<int>")

    def by_stretch(values: Column) -> Column:
        n = F.size(values)
        stretches = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / _FOLD_WIDTH).cast("int")),
            lambda k: fold(F.slice(values, k * _FOLD_WIDTH + 1, F.lit(_FOLD_WIDTH))),
        )
        shifted = let(
            stretches,
            lambda parts: F.zip_with(
                parts,
                fold(F.transform(parts, lambda s: s["total"]))["starts"],
                lambda s, base: F.transform(s["starts"], lambda x: x + base),
            ),
        )
        return F.when(n <= 0, empty).when(n <= _FOLD_WIDTH, fold(values)["starts"]).otherwise(F.flatten(shifted))

    return let(lengths, by_stretch)


def tag_type(tag: Column) -> Column:
    """``B-x`` and ``I-x`` -> ``x``; ``O`` -> NULL."""
    return F.when(tag != "O", F.substring(tag, 3, 2**31 - 1))


def entity_chunks(tags: Column) -> Column:
    """Chunks of a BIO sequence as ``array<struct<begin, end, type>>``, end inclusive.

    A chunk opens at ``B-``, or where the previous tag is ``O`` or of another type;
    it closes where the next tag opens a chunk or is ``O``. Opens and closes come in
    the same order, so they pair by rank; no state is carried along the sequence.
    """

    def opens(tag: Column, before: Column) -> Column:
        broken = before.isNull() | (before == "O") | (tag_type(before) != tag_type(tag))
        return (tag != "O") & (tag.startswith("B-") | broken)

    def chunks(seq: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(seq) - 1)

        def closes(i: Column) -> Column:
            here, after = F.get(seq, i), F.get(seq, i + 1)
            return (here != "O") & (after.isNull() | (after == "O") | opens(after, here))

        pairs = F.zip_with(
            F.filter(positions, lambda i: opens(F.get(seq, i), F.get(seq, i - 1))),
            F.filter(positions, closes),
            lambda b, e: F.struct(
                b.alias("begin"), e.alias("end"), tag_type(F.get(seq, b)).alias("type")
            ),
        )
        none = F.array().cast("array<struct<begin:int,end:int,type:string>>")
        return F.when(F.size(seq) > 0, pairs).otherwise(none)

    return let(tags, chunks)


def drop_masked(pred: Column, label: Column, mask: int = -100) -> Column:
    """Pairs of a parallel prediction and label array, without masked labels."""
    pairs = F.zip_with(pred, label, lambda p, g: F.struct(p.alias("pred"), g.alias("label")))
    return F.filter(pairs, lambda x: x["label"] != mask)


def pad_to(c: Column, length: Column, value: int) -> Column:
    missing = F.greatest(length - F.size(c), F.lit(0)).cast("int")
    return F.concat(c, F.array_repeat(F.lit(value), missing))
