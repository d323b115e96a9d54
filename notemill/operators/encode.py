"""Vocabulary and encoding of a corpus.

A vocabulary is built from the corpus and holds at most ``size`` entries, so it is
small enough to travel with the tasks. Words are looked up batch by batch in Arrow:
the text is cut into pieces by JVM expressions, and one hash lookup per batch turns
the flattened pieces into ids. No encoding shuffles the text.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.functions import text as tx
from notemill.functions.arrays import let, pad_to
from notemill.functions.naming import seeded_key
from notemill.operators.ordered import running
from notemill.operators.subwords import Trie, lookup
from notemill.runtime import stage

# The special entries that open every vocabulary.
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
PAD, UNK, CLS, SEP = range(4)
MASK = -100
MAX_VOCAB = 500_000


def _ranked(counts: DataFrame, size: int) -> DataFrame:
    """Specials, then the ``size`` most frequent of ``(token, n)``, with ids."""
    if size > MAX_VOCAB:
        raise ValueError(f"a vocabulary of {size} entries is too large to send to tasks")
    # A sorted limit keeps the first ``size`` of each task before the tasks' rows meet.
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "token"))
    ranked = top.select("token", (rank + len(SPECIALS) - 1).cast("int").alias("token_id"), "n")
    specials = counts.sparkSession.createDataFrame(
        [(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, token_id int, n bigint"
    )
    return specials.unionAll(ranked)


def build_vocab(df: DataFrame, text_col: str, size: int = 30_000, min_count: int = 1) -> DataFrame:
    """``(token, token_id, n)``: specials, then the most frequent pieces."""
    counts = (
        df.select(F.explode(tx.word_pieces(F.col(text_col))).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    return _ranked(counts.filter(F.col("n") >= min_count), size)


def build_piece_vocab(
    df: DataFrame, text_col: str, size: int = 30_000, min_count: int = 1, max_piece: int | None = 4
) -> DataFrame:
    """As ``build_vocab``, with sub-word pieces: word heads, and ``##`` inner parts.

    Whole words are always candidates; heads and inner parts have at most ``max_piece``
    characters, or any number where it is None. Counts are taken on distinct words first,
    so parts are cut once per word of the vocabulary and not once per word of the corpus.
    """
    words = (
        df.select(F.explode(tx.word_pieces(F.col(text_col))).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    n = F.length("word")
    longest = n if max_piece is None else F.lit(max_piece)
    heads = F.transform(
        F.sequence(F.lit(1), F.least(n, longest)), lambda k: F.substring(F.col("word"), F.lit(1), k)
    )
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), n),
            lambda at: F.transform(
                F.sequence(F.lit(1), F.least(longest, n - at + 1)),
                lambda k: F.concat(F.lit("##"), F.substring(F.col("word"), at, k)),
            ),
        )
    )
    parts = F.when(n > 1, F.array_distinct(F.concat(F.array("word"), heads, inner))).otherwise(F.array("word"))
    counts = (
        words.select(F.explode(parts).alias("token"), "n")
        .groupBy("token").agg(F.sum("n").alias("n"))
    )
    return _ranked(counts.filter(F.col("n") >= min_count), size)


def vocab_list(vocab: DataFrame) -> list[str]:
    rows = vocab.orderBy("token_id").limit(MAX_VOCAB + len(SPECIALS) + 1).collect()
    if len(rows) > MAX_VOCAB + len(SPECIALS):
        raise ValueError("vocabulary is too large to send to tasks")
    return [row["token"] for row in rows]


def lookup_ids(tokens: Sequence[str]):
    """Arrow function ``array<string> -> array<int>``; unknown pieces become [UNK]."""
    known, unk = pa.array(list(tokens)), UNK

    @F.arrow_udf("array<int>")
    def ids(pieces: pa.Array) -> pa.Array:
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = pieces.flatten()
        found = pc.fill_null(pc.index_in(flat, value_set=known.cast(flat.type)), unk)
        sizes = pc.fill_null(pc.list_value_length(pieces), 0).cast(pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes)])
        return pa.ListArray.from_arrays(offsets, found.cast(pa.int32()))

    return ids


def lookup_pieces(tokens: Sequence[str]):
    """Arrow function ``array<string> -> array<array<int>>``: greedy longest match.

    All distinct words of a batch walk a trie in step; a word with a part that no entry
    covers becomes one [UNK].
    """
    return lookup(Trie(tokens, UNK))


def _framed(ids: Column) -> Column:
    return F.concat(F.array(F.lit(CLS)), ids, F.array(F.lit(SEP)))


def _piece_ids(c: Column, tokens: Sequence[str], subwords: bool) -> Column:
    pieces = tx.word_pieces(c)
    return F.flatten(lookup_pieces(tokens)(pieces)) if subwords else lookup_ids(tokens)(pieces)


def encode_text(
    df: DataFrame, text_col: str, tokens: Sequence[str], max_length: int = 480, subwords: bool = False
) -> DataFrame:
    """Add ``input_ids``, cut to ``max_length`` with both specials, and ``n_pieces``.

    In word mode the pieces are cut first, so only those that stay are looked up.
    """
    if not subwords:
        cut = df.withColumn("__pieces", tx.word_pieces(F.col(text_col))).withColumn(
            "__ids", lookup_ids(tokens)(F.slice("__pieces", 1, max_length - 2))
        )
        return cut.select(*df.columns, _framed(F.col("__ids")).alias("input_ids"), F.size("__pieces").alias("n_pieces"))
    ids = df.withColumn("__ids", _piece_ids(F.col(text_col), tokens, subwords))
    return ids.select(
        *df.columns,
        _framed(F.slice("__ids", 1, max_length - 2)).alias("input_ids"),
        F.size("__ids").alias("n_pieces"),
    )


def pair_budget(a: Column, b: Column, max_length: int) -> tuple[Column, Column]:
    """Lengths kept of a pair when the longer side loses one piece at a time."""
    budget = max_length - 3
    upper, lower = budget - budget // 2, budget // 2
    fits = a + b <= budget
    keep_a = F.when(fits | (a <= upper), a).when(b <= lower, budget - b).otherwise(F.lit(upper))
    keep_b = F.when(fits, b).when(a <= upper, budget - a).when(b <= lower, b).otherwise(F.lit(lower))
    return keep_a.cast("int"), keep_b.cast("int")


def encode_pair(
    df: DataFrame, a: str, b: str, tokens: Sequence[str], max_length: int = 480, subwords: bool = False
) -> DataFrame:
    """Add ``input_ids`` of two texts, longest side cut first."""
    if not subwords:
        # Both sides are cut first, so only pieces that stay are looked up.
        cut = df.withColumn("__a", tx.word_pieces(F.col(a))).withColumn("__b", tx.word_pieces(F.col(b)))
        keep_a, keep_b = pair_budget(F.size("__a"), F.size("__b"), max_length)
        find = lookup_ids(tokens)
        ids = cut.withColumn("__a", find(F.slice("__a", 1, keep_a))).withColumn("__b", find(F.slice("__b", 1, keep_b)))
        return ids.select(*df.columns, F.concat(_framed(F.col("__a")), F.col("__b"), F.array(F.lit(SEP))).alias("input_ids"))
    ids = df.withColumn("__a", _piece_ids(F.col(a), tokens, subwords)).withColumn(
        "__b", _piece_ids(F.col(b), tokens, subwords)
    )
    keep_a, keep_b = pair_budget(F.size("__a"), F.size("__b"), max_length)
    both = F.concat(_framed(F.slice("__a", 1, keep_a)), F.slice("__b", 1, keep_b), F.array(F.lit(SEP)))
    return ids.select(*df.columns, both.alias("input_ids"))


def word_ids(pieces: Column) -> Column:
    """Word position of each piece, from an array of pieces per word."""
    return F.flatten(F.transform(pieces, lambda p, i: F.array_repeat(i, F.size(p))))


def encode_words(
    df: DataFrame, tokens_col: str, tokens: Sequence[str], max_length: int = 480, subwords: bool = False
) -> DataFrame:
    """Add ``input_ids`` and ``word_ids`` (NULL at specials) for pre-split words."""
    if subwords:
        grouped = lookup_pieces(tokens)(F.col(tokens_col))
        work = df.withColumn("__grouped", grouped).withColumn("__ids", F.flatten("__grouped"))
    else:
        work = df.withColumn("__grouped", F.transform(tokens_col, tx.word_pieces)).withColumn(
            "__ids", lookup_ids(tokens)(F.flatten("__grouped"))
        )
    none = F.array(F.lit(None).cast("int"))
    words = F.slice(word_ids(F.col("__grouped")), 1, max_length - 2)
    return work.select(
        *df.columns,
        _framed(F.slice("__ids", 1, max_length - 2)).alias("input_ids"),
        F.concat(none, words, none).alias("word_ids"),
    )


def align_labels(words: Column, tags: Column, first_piece_only: bool = False) -> Column:
    """Tag id of each piece's word; specials (NULL) get -100."""

    def labels(ids: Column, tag_ids: Column) -> Column:
        def label(w: Column, i: Column) -> Column:
            repeated = F.coalesce(F.get(ids, i - 1) == w, F.lit(False))
            masked = w.isNull() | repeated if first_piece_only else w.isNull()
            return F.when(masked, F.lit(MASK)).otherwise(F.get(tag_ids, w))

        return F.transform(ids, label)

    return let(words, lambda ids: let(tags, lambda tag_ids: labels(ids, tag_ids)))


def encode_ner(
    df: DataFrame,
    tokens: Sequence[str],
    tokens_col: str = "tokens",
    tags_col: str = "ner_tags",
    max_length: int = 480,
    first_piece_only: bool = False,
    subwords: bool = False,
) -> DataFrame:
    """Add ``input_ids``, ``word_ids`` and the aligned ``piece_labels``."""
    encoded = encode_words(df, tokens_col, tokens, max_length, subwords)
    return encoded.withColumn(
        "piece_labels", align_labels(F.col("word_ids"), F.col(tags_col), first_piece_only)
    )


def pad_batches(
    df: DataFrame,
    batch_size: int,
    id_col: str,
    ids_col: str = "input_ids",
    label_arrays: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """Pad each batch of the seeded order to its longest row.

    Adds ``batch_id``, ``attention_mask`` and ``padded_len``. Every batch but the last has ``batch_size`` rows, also where
    ids repeat or are missing: equal ids follow each other, in 64 runs each, so that no id is one task's. What is ranked
    are ids and counts; the wide rows, staged so that their numbers stay, move once to meet their batch.
    """
    numbered = stage(df.withColumn("__row", F.monotonically_increasing_id()), "unbatched")
    key = seeded_key(seed, F.col(id_col))
    narrow = numbered.select(
        F.col(id_col).alias("__id"), "__row", key.alias("__key"), F.pmod("__row", F.lit(64)).cast("int").alias("__run"),
        F.conv(F.substring(key, 1, 3), 16, 10).cast("int").alias("__bucket"),
    )
    runs = narrow.groupBy("__bucket", "__key", "__id", "__run").agg(F.count(F.lit(1)).alias("__n"))
    starts = running(runs, [], ["__key", "__id", "__run"], "__bucket", {"__start": ("sum", F.col("__n"))}, inclusive=False)
    starts = starts.select(F.col("__id").alias("__of"), F.col("__run").alias("__in"), "__start")
    place = F.row_number().over(Window.partitionBy("__id", "__run").orderBy("__row"))
    ranked = narrow.select("__id", "__run", "__row", place.alias("__place")).join(
        starts, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__run") == F.col("__in"))
    )
    batches = ranked.select("__row", F.floor((F.col("__start") + F.col("__place") - 1) / batch_size).alias("batch_id"))
    met = numbered.join(batches, "__row").drop("__row")
    placed = met.withColumn("padded_len", F.max(F.size(ids_col)).over(Window.partitionBy("batch_id")))
    length = F.col("padded_len")
    mask = F.transform(ids_col, lambda _: F.lit(1))
    padded = placed.withColumn("attention_mask", pad_to(mask, length, 0)).withColumn(
        ids_col, pad_to(F.col(ids_col), length, PAD)
    )
    for name in label_arrays:
        padded = padded.withColumn(name, pad_to(F.col(name), length, MASK))
    return padded


def decode(df: DataFrame, ids_col: str, tokens: Sequence[str], out: str = "decoded") -> DataFrame:
    """Ids back to pieces joined by spaces; inner pieces rejoin their word."""
    known = pa.array(list(tokens))

    @F.arrow_udf("array<string>")
    def names(ids: pa.Array) -> pa.Array:
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = known.take(ids.flatten().cast(pa.int32()))
        sizes = pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes)])
        return pa.ListArray.from_arrays(offsets, flat)

    joined = F.array_join(names(F.col(ids_col)), " ")
    return df.withColumn(out, F.replace(joined, F.lit(" ##"), F.lit("")))


def piece_counts(tokens_col: str, vocab: Sequence[str] | None = None) -> Column:
    """Piece count of each token: in word mode, or in sub-words of a vocabulary."""
    if vocab is not None:
        return F.transform(lookup_pieces(vocab)(F.col(tokens_col)), F.size)
    return F.transform(tokens_col, lambda t: F.size(tx.word_pieces(t)))


def truncation_report(df: DataFrame, n_pieces_col: str, max_length: int = 480) -> DataFrame:
    over = F.col(n_pieces_col) + 2 > max_length
    n = F.count(F.lit(1))
    cut = F.sum(F.when(over, 1).otherwise(0))
    return df.agg(
        n.alias("n_rows"),
        cut.alias("n_cut"),
        (cut.cast("double") / n).alias("share_cut"),
        F.max(n_pieces_col).alias("max_pieces"),
        F.sum(F.greatest(F.col(n_pieces_col) + 2 - max_length, F.lit(0))).alias("pieces_lost"),
    )
