"""Near-duplicate documents: MinHash banding, verified links, connected components.

Equal sets collapse to one class first, so copies of any number cost one signature. In
each band bucket every class meets the bucket's least class only; pairs that the
signatures allow are verified on their full shingle sets. Buckets whose classes then
still lie in several components are settled exactly, block against block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.components import components
from notemill.llm.scratch import Scratch
from notemill.llm.words import shingles, stream, text_slices, word_hashes, words

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signatures that agree in fewer places than this share of them are not verified. At a
#: similarity of 0.85 that is eight standard deviations below the mean.
SLACK = 0.25
BLOCK = 256

_A = stream(21, HASHES) | np.uint64(1)
_B = stream(22, HASHES)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    starts, lengths, counts = words(data, offsets)
    hashes, n = shingles(word_hashes(data, starts, lengths), counts, width)
    edges = np.concatenate([[0], np.cumsum(n)])
    return [np.unique(hashes[edges[i] : edges[i + 1]]) for i in range(len(n))]


def signature(values: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minima of ``HASHES`` multiply-shift hashes of a set."""
    x = values >> np.uint64(32)
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 2048):
            np.minimum(least, (x[i : i + 2048, None] * _A + _B).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint16)


def linked(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            ids = batch.column(0)
            for start, end, data, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                names = ids.slice(start, end - start)
                digests = [
                    hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        names, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["id", "n", "digest", "sig"],
                )

    return docs.mapInArrow(rows, f"id {dict(docs.dtypes)['id']}, n long, digest binary, sig binary")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Shingle sets of the documents in ``ids``, repeated rows once."""
    texts = docs.join(ids, "id", "left_semi").groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))

    def rows(batches):
        for batch in batches:
            ids = batch.column(0)
            for start, end, data, offsets in text_slices(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, offsets, width)]
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(rows, f"id {dict(docs.dtypes)['id']}, shingles binary")


def _agree(a: bytes, b: bytes) -> int:
    return int((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).sum())


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs of columns a, b, set_a, set_b whose sets are similar enough."""

    def rows(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for x, y in zip(left, right):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(rows, f"a {kind}, b {kind}")


def _settle(members: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links between classes of different components that share a bucket.

    ``members`` has bucket, count, node, component, sig, shingles. A large bucket is cut
    into blocks and every two blocks meet in a task of their own; a task returns at most
    one link for each two components that it joins.
    """
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int")
    spread = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "component", "sig", "shingles"
    )
    floor = int(HASHES * (percent / 100 - SLACK))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        sigs = np.array([np.frombuffer(s, np.uint16) for s in rows["sig"]]).reshape(len(rows), HASHES)
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        root = {c: c for c in rows["component"]}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        comps, nodes = rows["component"].tolist(), rows["node"].tolist()
        for i in range(1, len(rows)):
            for j in np.flatnonzero((sigs[:i] == sigs[i]).sum(axis=1) >= floor):
                a, b = find(comps[i]), find(comps[j])
                if a == b:
                    continue
                inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if linked(inter, len(sets[i]), len(sets[j]), percent):
                    root[max(a, b)] = min(a, b)
                    found.append((nodes[i], nodes[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return spread.groupBy("bucket", "lo", "hi").applyInPandas(meet, f"a {kind}, b {kind}")


def _members() -> list:
    """Sums of the 32-bit words of each member's 128-bit digest: unlike sets of classes agree in all four with a probability of 2^-128."""
    word = "sum(conv(substring(md5(cast(node AS string)), {at}, 8), 16, 10)::bigint) AS who_{k}"
    return [F.expr(word.format(at=8 * k - 7, k=k)) for k in range(1, 5)]


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Class of every document under ``100 * intersection >= percent * union`` of its shingles.

    Words are lower-cased in A-Z; a set holds the distinct shingles of ``width`` words, or
    the whole sequence of a shorter text. Returns id, ``n_shingles``, ``component_id`` (the
    smallest id reachable over links) and ``kept`` (whether that is its own), one row per
    input row. A null or blank text has no shingles and no links. A row without an id
    names nothing: its component is its class's, or null, and it is kept if that is
    null. Rows that share an id are one node. Two classes at the threshold meet in no band with a probability
    of 1e-10 at 85 percent (5e-8 at 80).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(texts.dtypes)["id"]
    signed = scratch.table(_signatures(texts, width), "signed")
    classes = scratch.table(
        signed.filter("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("node"), F.first("sig").alias("sig")),
        "classes",
    )
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    keyed = classes.select("node", "sig", band).select(
        "node", F.xxhash64("band", F.expr(f"substring(sig, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("bucket")
    )
    hubs = keyed.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("count")).filter("count > 1")
    # Spark rates a table without the factor of its explode, and stored ids and digests by their compressed size; joins whose
    # sides grow with the documents are therefore told not to broadcast.
    met = scratch.table(keyed.hint("merge").join(hubs, "bucket"), "met")
    pairs = scratch.table(met.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    involved = met.select(F.col("node").alias("id")).distinct()
    sets = scratch.table(_sets(texts.filter("id IS NOT NULL"), involved, width), "sets")

    sigs = classes.select("node", "sig")
    near = (
        pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    )
    floor = int(HASHES * (percent / 100 - SLACK))

    def allowed(batches):
        for batch in batches:
            keep = [_agree(x.as_py(), y.as_py()) >= floor for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    likely = near.select("a", "b", "sig_a", "sig_b").mapInArrow(allowed, f"a {kind}, b {kind}")
    with_sets = likely.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b"
    )
    links = scratch.table(_verified(with_sets, percent), "links")
    comps = scratch.table(components(links, scratch, "stars"), "components-1")

    named = met.join(comps.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_buckets = named.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("count"), F.min("component").alias("lo"), F.max("component").alias("hi"), *_members()
    ).filter("lo <> hi AND count > 2")
    # Buckets of other bands often hold the same classes; one of them is enough. The only pair of two classes is already checked.
    once = open_buckets.groupBy("count", "who_1", "who_2", "who_3", "who_4").agg(F.min("bucket").alias("bucket")).select("bucket", F.col("count").alias("size"))
    members = (
        named.join(once, "bucket")
        .select("bucket", F.col("size").alias("count"), "node", "component")
        .join(sigs, "node")
        .join(sets.withColumnRenamed("id", "node"), "node")
    )
    more = scratch.table(_settle(members, percent, kind), "more-links")
    final = comps
    if more.limit(1).count():
        steps = more.unionByName(comps.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        final = scratch.table(components(steps, scratch, "stars-2"), "components-2")
    named_classes = scratch.table(
        classes.select("digest", "node").join(final.hint("merge"), "node", "left").select("digest", F.coalesce("component", "node").alias("component")),
        "named",
    )
    scratch.drop("met", "pairs", "sets", "classes")
    return (
        signed.select("id", "n", "digest")
        .join(named_classes.hint("merge"), "digest", "left")
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )
