"""Token ids in compact files: canonical length-limited Huffman codes from global counts.

A folder holds ``codes`` (one row for each id: its count and code length) and ``blocks``
(about 262,144 ids of whole documents each, in document order). A block can be decoded
alone: it has its first id's global place, its documents' sizes, the bit stream, and the
bit offset of every 256th id. From those checkpoints a block is decoded in lanes, all of
them one table look-up at a time.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.llm.scratch import Scratch, partitions

BLOCK_IDS = 1 << 18
LANE = 256
MAX_BITS = 18
CACHE = 250_000

# --- ids of texts ------------------------------------------------------------------

#: What the fast path below relies on; files of another kind go the plain way.
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTER = "a-zªµºß-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")


class Encoder:
    """Ids of whole texts by a tokenizer file, as numpy bytes of the narrowest type.

    In a vocabulary of separate lower-case words, pieces between white space do not touch
    each other, so each distinct piece of a text in Latin-1 letters is encoded once per
    worker (``CACHE`` pieces, then anew). Any other text or vocabulary goes to the
    tokenizer whole; the ids are the same either way.
    """

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(), (end_id or 0) + 1)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._plain_words(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        #: The byte alphabet's letters for each letter of a word.
        self.alphabet = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}
        self.words: dict[str, bytes] = {}
        self.pieces = _Pieces(self)

    @staticmethod
    def _plain_words(path: str) -> bool:
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = spec.get("normalizer") or {}
        pre = spec.get("pre_tokenizer") or {}
        kinds = [n.get("type") for n in norm.get("normalizers", [])]
        steps = pre.get("pretokenizers", [])
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in steps] == ["Split", "ByteLevel"]
            and steps[0].get("pattern") == {"Regex": _WORDS}
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and spec.get("post_processor") is None
        )

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHE:
                self.words.clear()
            spelt = word if word.isascii() and word.isalpha() else word.translate(self.alphabet)
            found = array(self.dtype.char, [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()
            self.words[word] = found
        return found

    def simple(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(c in text for c in "\x1c\x1d\x1e\x1f") and not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        if self.fast and self.simple(text):
            if len(self.pieces) > CACHE:
                self.pieces.clear()
            return b"".join(map(self.pieces.__getitem__, text.split())) + self.end
        return self.library(text) + self.end


class _Pieces(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        word = self.encoder.word
        if piece.isalpha():
            found = word(piece.lower())
        elif piece[:-1].isalpha() and not piece[-1].isalnum():  # a word and its point or comma
            found = word(piece[:-1].lower()) + word(piece[-1])
        else:
            found = b"".join(map(word, _PIECES.findall(piece.lower())))
        if len(self) <= CACHE and len(piece) <= 32:
            self[piece] = found
        return found


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """The worker's encoder of a file."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


# --- codes -------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 where a count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    # Each level's list is the leaves merged with packages of two from the level below; of a
    # list only how many leaves lie before each place matters for the lengths.
    leaves_before = []
    packages = np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        leaves_before.append(np.concatenate([[0], np.cumsum(by < n)]))
        merged = merged[by]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for level in reversed(leaves_before):
        leaves = int(level[take])
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
        if not take:
            break
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order]
        top = int(size.max())
        steps = np.uint64(1) << (top - size).astype(np.uint64)
        begin = np.cumsum(steps) - steps
        codes[order] = begin >> (top - size).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length for every prefix of the longest code's width."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    top = int(lengths.max()) if len(order) else 1
    runs = 1 << (top - lengths[order])
    ids = np.zeros(1 << top, np.uint32)
    size = np.ones(1 << top, np.uint8)
    end = int(runs.sum())
    ids[:end], size[:end] = np.repeat(order, runs), np.repeat(lengths[order], runs)
    return ids, size, top


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream of ids, and the bit offset of every ``LANE``-th of them."""
    size = lengths[ids]
    end = np.cumsum(size)
    start = end - size
    bits = int(end[-1]) if len(end) else 0
    word, shift = start >> 5, start & 31
    # Each code lies in the 64 bits from its 32-bit word on; codes of a word never overlap.
    value = codes[ids] << (64 - shift - size).astype(np.uint64)
    out = np.zeros((bits >> 5) + 3, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    data = out.astype(np.uint32).byteswap().tobytes()[: (bits + 7) >> 3]
    return data, start[::LANE]


def unpack(data: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``n`` ids of a bit stream, decoded in lanes from the checkpoints."""
    ids, size, top = table
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint64)
    eight = np.uint64(8)
    run = np.zeros(len(raw) - 7, np.uint64)
    for k in range(8):
        run = (run << eight) | raw[k : len(raw) - 7 + k]
    lanes = len(checkpoints)
    at = checkpoints.astype(np.int64).copy()
    out = np.zeros((LANE, lanes), np.uint32)
    drop = np.uint64(64 - top)
    last = n - (lanes - 1) * LANE
    for step in range(min(LANE, n)):
        if step == last:
            at = at[:-1]
        peek = ((run[at >> 3] << (at & 7).astype(np.uint64)) >> drop).astype(np.int64)
        out[step, : len(at)] = ids[peek]
        at = at + size[peek]
    return out.T.reshape(-1)[: n]


# --- files -------------------------------------------------------------------------


def _encode(texts: DataFrame, path: str, end_id: int | None, kind: str) -> DataFrame:
    """Blocks of raw ids in the order of a partition's rows."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, end_id)
        part, block, before, names, sizes, parts, held = None, 0, 0, [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([before], pa.int64()), pa.array([names], pa.list_(id_type)),
                    pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(parts)], pa.binary()),
                ],
                names=["part", "block", "before", "ids", "sizes", "tokens"],
            )

        for batch in batches:
            id_type = batch.column(1).type
            for p, name, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                part = p.as_py()
                coded = coder.encode(text.as_py())
                names.append(name.as_py())
                sizes.append(len(coded) // coder.dtype.itemsize)
                parts.append(coded)
                held += sizes[-1]
                if held >= BLOCK_IDS:
                    yield flush()
                    block, before, names, sizes, parts, held = block + 1, before + held, [], [], [], 0
        if names:
            yield flush()

    return texts.mapInArrow(rows, f"part int, block long, before long, ids array<{kind}>, sizes array<int>, tokens binary")


def _counts(raw: DataFrame, dtype: np.dtype) -> DataFrame:
    def rows(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for tokens in batch.column(0):
                found = np.bincount(np.frombuffer(tokens.as_buffer(), dtype))
                if len(found) > len(total):
                    total = np.append(total, np.zeros(len(found) - len(total), np.int64))
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "count"])

    return raw.select("tokens").mapInArrow(rows, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, max_bits: int = MAX_BITS,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every whole text and write the files, documents in ascending order of id.

    A null text is empty and has only the end id (or none); null ids come first; rows
    of one id are ordered by their text. ``tokenizer`` is the path of a vocabulary file that
    all executors can read. Other columns are ignored. An empty table gives files
    without blocks. ``codes`` goes through the driver: one row for each id of the vocabulary.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    coder = encoder(tokenizer, end_id)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    # Rows equal in both are spread by their place in the input, so a row that repeats often does not fill one task.
    dealt = texts.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *keys, "tie")
    dealt = dealt.sortWithinPartitions(*keys, "text")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "id", "text")
    raw = scratch.table(_encode(dealt, tokenizer, end_id, kind), "raw")

    counted = _counts(raw, coder.dtype).collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(max([r["id"] for r in counted], default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["count"]
    lengths = code_lengths(counts, max_bits)
    rows = [(int(i), int(counts[i]), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(rows, "id long, count long, bits int").coalesce(1).sortWithinPartitions("id").write.parquet(f"{folder}/codes")

    n = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = raw.groupBy("part").agg(F.sum(n).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range partition.
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    shared = spark.sparkContext.broadcast((canonical(lengths), lengths))
    dtype = coder.dtype

    def packed(batches):
        codes, sizes = shared.value
        for batch in batches:
            out = [pack(np.frombuffer(t.as_buffer(), dtype).astype(np.int64), codes, sizes) for t in batch.column(5)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(5)],
                    pa.array([c.astype(np.int64).tolist() for _, c in out], pa.list_(pa.int64())),
                    pa.array([d for d, _ in out], pa.binary()),
                ],
                names=["part", "block", "first", "ids", "sizes", "checkpoints", "bits"],
            )

    ordered = raw.join(F.broadcast(offsets), "part").select(
        "part", "block", (F.col("offset") + F.col("before")).alias("first"), "ids", "sizes", "tokens"
    )
    schema = f"part int, block long, first long, ids array<{kind}>, sizes array<int>, checkpoints array<bigint>, bits binary"
    ordered.mapInArrow(packed, schema).sortWithinPartitions("part", "block").write.partitionBy("part").parquet(f"{folder}/blocks")
    scratch.drop("raw")


def read(spark: SparkSession, folder: str, kind: str = "long", id_col: str = "doc_id") -> DataFrame:
    """Documents of the files: id, ``start``, ``n_tokens``, ``tokens`` (32-bit little-endian), ``ids_crc32``."""
    found = spark.read.parquet(f"{folder}/codes").select("id", "bits").collect()  # the vocabulary
    lengths = np.zeros(max([r["id"] for r in found], default=0) + 1, np.int64)
    for r in found:
        lengths[r["id"]] = r["bits"]
    schema = f"block long, first long, ids array<{kind}>, sizes array<int>, checkpoints array<bigint>, bits binary, part int"
    blocks = spark.read.schema(schema).parquet(f"{folder}/blocks")
    shared = spark.sparkContext.broadcast(lengths)

    def rows(batches):
        table = decode_table(shared.value)
        for batch in batches:
            for first, names, sizes, points, bits in zip(*[batch.column(i) for i in range(5)]):
                sizes = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(sizes)
                ids = unpack(bits.as_py(), np.array(points.as_py()), int(ends[-1]), table).astype("<u4")
                begin = ends - sizes
                tokens = [ids[a:b].tobytes() for a, b in zip(begin, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        names.values, pa.array(begin + first.as_py(), pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array(tokens, pa.binary()), pa.array([zlib.crc32(t) for t in tokens], pa.int64()),
                    ],
                    names=[id_col, "start", "n_tokens", "tokens", "ids_crc32"],
                )

    return blocks.select("first", "ids", "sizes", "checkpoints", "bits").mapInArrow(
        rows, f"`{id_col}` {kind}, start long, n_tokens long, tokens binary, ids_crc32 long"
    )
