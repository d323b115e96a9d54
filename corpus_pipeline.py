"""From raw documents to encoded token files, one dealt operator a stage.

Rows are documents of their own, also those without an id or with a shared one: the
near-duplicate stage drops only rows that are linked with the one it keeps. Null
and blank texts pass every filter that finds nothing in them. Extra columns are carried along
up to the last stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import decontam, mixing, neardup, quality
from notemill.llm.columns import hashable, set_aside
from notemill.llm.queries import encoded, table
from notemill.llm.scratch import Scratch

KEEP_FROM = 0.3
#: Columns that the stages look at; all others keep out of the way of theirs.
USED = ("doc_id", "text", "source")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    aside, back = set_aside(docs, *USED)
    return quality.score(aside, model).filter(F.col("score") >= KEEP_FROM).select(*back)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, of several the one whose text hashes least.

    Every row has a number of its own, so rows that share an id are no link; rows without words all stay.
    """
    scratch = Scratch(spark, "one-of-each")
    aside, back = set_aside(docs, *USED)
    # Written, so that a row has the same number in every job.
    keyed = scratch.table(aside.withColumn("__key", F.monotonically_increasing_id()), "keyed")
    groups = neardup.near_duplicates(keyed, width=5, percent=80, id_col="__key").filter("n_shingles > 0")
    groups = scratch.table(groups.select("__key", "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.xxhash64(*hashable(aside).values()), "__key")
    ranked = keyed.select("__key", order.alias("__order")).join(groups.hint("merge"), "__key")
    first = ranked.groupBy("component_id").agg(F.min("__order").alias("x")).select("x.__key")
    dropped = groups.select("__key").join(first, "__key", "left_anti")
    return keyed.join(dropped, "__key", "left_anti").select(*back)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    aside, back = set_aside(docs, *USED)
    marked = decontam.mark(aside, table(spark, sf_dir, "benchmark"), min_chars=0)
    return marked.filter(F.size("leaks") == 0).select(*back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them, shard by shard in their local order."""
    aside, back = set_aside(docs, *USED)
    return mixing.shuffled(mixing.mix(aside).mixed).select(*back)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the drawn documents, read back: place, length and checksum of each."""
    return encoded(spark, docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_ids", token_ids),
]

#: The classifier and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs
