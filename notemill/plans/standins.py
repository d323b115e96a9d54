"""Annotated corpora, run histories and tensor lists derived from the driver's tables.

The clinical corpora this toolkit is made for cannot be shipped. These derivations
give every operator real rows: notes are ``documents``, spans are found by patterns,
patients are sources, runs are users' events, tensors are order lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import text as tx
from notemill.functions.arrays import entity_chunks, let, running_starts
from notemill.operators import spans as sp
from notemill.operators.ordered import running
from notemill.operators.rows import unroll
from notemill.operators.sampling import assign_split, group_split

# Patterns in the part of the syntax that Java and RE2 read alike.
EMAIL_TOKEN = "[A-Za-z0-9]@[A-Za-z0-9]"
IP_TOKEN = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
NUM_TOKEN = "[0-9]{3,}"
NAME_TOKEN = "^[A-Z][a-z]"
WRAP_HEAD = r"^[a-z]+\.$"
WRAP_TAIL = "^[A-Z][a-z]+$"
CHAR_SPAN = r"[A-Za-z0-9]+@[A-Za-z0-9.]*[A-Za-z0-9]|[0-9]{3,}|[a-z]+\.\n[A-Z][a-z]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as notes, dealt out by id: the given file has one row group, so one task would read it all.

    This belongs to the stand-in; no operator deals out its notes.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "text").repartition(n, "doc_id")


def token_lines(spark: SparkSession, sf: str, keep_blank: bool = True) -> DataFrame:
    return sp.token_lines(notes(spark, sf), keep_blank=keep_blank)


def rough_tags(tokens: str = "tokens") -> Column:
    """Each personal-data token a chunk of its own, runs of capitalised tokens one chunk."""

    def tag(token: Column) -> Column:
        # Most tokens have no sign of interest: one pattern turns them down.
        return (
            F.when(~F.rlike(token, F.lit("[0-9@]|^[A-Z]")), F.lit("O"))
            .when(F.rlike(token, F.lit(EMAIL_TOKEN)), F.lit("B-EMAIL"))
            .when(F.rlike(token, F.lit(IP_TOKEN)), F.lit("B-IP"))
            .when(F.rlike(token, F.lit(NUM_TOKEN)), F.lit("B-NUM"))
            .when(F.rlike(token, F.lit(NAME_TOKEN)), F.lit("I-NAME"))
            .otherwise(F.lit("O"))
        )

    return F.transform(tokens, tag)


def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Pattern chunks per line: doc_id, line_no, leading_space, begin, end, type, text."""
    lines = token_lines(spark, sf)
    chunks = unroll(lines, ["doc_id", "line_no", "leading_space", "tokens"], entity_chunks(rough_tags()), "c")
    return chunks.select(
        "doc_id",
        "line_no",
        "leading_space",
        "c.begin",
        "c.end",
        "c.type",
        F.array_join(F.slice("tokens", F.col("c.begin") + 1, F.col("c.end") - F.col("c.begin") + 1), " ").alias("text"),
    )


def token_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-off spans: pattern chunks, and WRAP spans over a line border (which come later)."""
    chunks = line_chunks(spark, sf)
    shift = F.when(F.col("leading_space"), 1).otherwise(0)
    line = F.col("line_no") + 1
    on_line = chunks.select(
        "doc_id",
        (F.col("line_no").cast("bigint") * 2**21 + F.col("begin")).alias("span_idx"),
        line.alias("start_line"),
        (F.col("begin") + shift).alias("start_pos"),
        line.alias("end_line"),
        (F.col("end") + shift).alias("end_pos"),
        "type",
        F.lower("text").alias("stated"),
    )

    def wraps(lines: Column) -> Column:
        def candidate(x: Column, i: Column) -> Column:
            after = F.get(lines, i + 1)
            return F.struct(
                (i + 1).alias("start_line"),
                (F.size(x["tokens"]) - 1 + x["shift"]).alias("start_pos"),
                (i + 2).alias("end_line"),
                after["shift"].alias("end_pos"),
                F.get(x["tokens"], F.size(x["tokens"]) - 1).alias("head"),
                F.get(after["tokens"], F.lit(0)).alias("tail"),
            )

        return F.filter(
            F.transform(lines, candidate),
            lambda w: F.rlike(w["head"], F.lit(WRAP_HEAD)) & F.rlike(w["tail"], F.lit(WRAP_TAIL)),
        )

    split = F.transform(
        tx.text_lines(F.col("text")),
        lambda x: F.struct(
            F.when(F.startswith(x, F.lit(" ")), 1).otherwise(0).alias("shift"),
            tx.nonblank_tokens(x).alias("tokens"),
        ),
    )
    over = unroll(notes(spark, sf), ["doc_id"], let(split, wraps), "w").select(
        "doc_id",
        (F.col("w.start_line").cast("bigint") + 2**60).alias("span_idx"),
        "w.start_line",
        "w.start_pos",
        "w.end_line",
        "w.end_pos",
        F.lit("WRAP").alias("type"),
        F.lower(F.concat_ws(" ", "w.head", "w.tail")).alias("stated"),
    )
    return on_line.unionByName(over)


def labelled(spark: SparkSession, sf: str, keep_blank: bool = False) -> DataFrame:
    """Token lines with BIO labels; lines without tokens left out unless ``keep_blank``."""
    lines = token_lines(spark, sf, keep_blank=keep_blank)
    return sp.label_token_spans(lines, token_spans(spark, sf))


def split_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return group_split(table(spark, sf, "documents"), "source")


def labelled_splits(spark: SparkSession, sf: str, keep_blank: bool = False) -> DataFrame:
    return assign_split(labelled(spark, sf, keep_blank), split_by_source(spark, sf), "source")


def annotated_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes with a ``spans`` array of pattern matches at character offsets."""

    def found(text: Column) -> Column:
        gaps = F.split(text, CHAR_SPAN, -1)
        hits = F.regexp_extract_all(text, F.lit(CHAR_SPAN), 0)
        parts = F.zip_with(
            gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"))
        )

        def placed(rows: Column) -> Column:
            matched = F.filter(rows, lambda r: r["hit"].isNotNull())
            starts = running_starts(F.transform(matched, lambda r: r["gap"] + F.length(r["hit"])))
            begins = F.zip_with(matched, starts, lambda r, s: F.struct((s + r["gap"]).alias("begin"), r["hit"].alias("hit")))
            return F.transform(
                begins,
                lambda b, i: F.struct(
                    i.alias("span_idx"),
                    b["begin"].alias("begin"),
                    (b["begin"] + F.length(b["hit"])).alias("end"),
                    _char_type(b["hit"]).alias("type"),
                    b["hit"].alias("stated"),
                ),
            )

        return let(parts, placed)

    return notes(spark, sf).withColumn("spans", found(F.col("text")))


def _char_type(hit: Column) -> Column:
    return (
        F.when(F.contains(hit, F.lit("@")), F.lit("EMAIL"))
        .when(F.rlike(hit, F.lit("^[0-9]+$")), F.lit("NUM"))
        .otherwise(F.lit("EDGE"))
    )


def char_spans(spark: SparkSession, sf: str) -> DataFrame:
    return unroll(annotated_notes(spark, sf), ["doc_id"], "spans", "s").select("doc_id", "s.*")


def annotation_files(spark: SparkSession, sf: str) -> DataFrame:
    """The annotated notes as the text of annotated XML files."""

    def attribute(c: Column) -> Column:
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(sign), F.lit(entity))
        return c

    def element(s: Column) -> Column:
        return F.concat(
            F.lit('<EVENT start="'), s["begin"].cast("string"),
            F.lit('" end="'), s["end"].cast("string"),
            F.lit('" text="'), attribute(s["stated"]),
            F.lit('" type="'), s["type"], F.lit('" />\n'),
        )

    rows = annotated_notes(spark, sf)
    content = F.concat(
        F.lit('<?xml version="1.0" ?>\n<root>\n<TEXT><![CDATA['),
        F.col("text"),
        F.lit("]]></TEXT>\n<TAGS>\n"),
        F.array_join(F.transform("spans", element), ""),
        F.lit("</TAGS>\n</root>\n"),
    )
    return rows.select("doc_id", "source", "lang", content.alias("text"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Run history: a user's events in time order, with the value as the metric."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("run"), "ts", "event_id", "event_type", "value")
    hour = F.datediff(F.col("ts").cast("date"), F.lit("2000-01-01").cast("date")) * 24 + F.hour("ts")
    ranked = running(events, ["run"], ["ts", "event_id"], hour, {"step": ("count", F.lit(1))})
    return ranked.select("run", F.col("step").cast("int").alias("step"), "ts", "event_type", F.col("value").alias("metric"))


def task_of(event_type: Column) -> Column:
    """A task name per kind of event; one is not in the catalogue."""
    return (
        F.when(event_type == "view", "mimic-mp").when(event_type == "click", "mednli")
        .when(event_type == "error", "ICD9-Triage").when(event_type == "signup", "i2b2-2010-NER")
        .otherwise("mimic-note-category")
    )


def model_path_of(event_type: Column) -> Column:
    return (
        F.when(event_type == "view", "roberta-base")
        .when(event_type == "click", "hub/tiny-bert")
        .when(event_type == "error", "/a/b/saved_models/declutr/mimic/few_epoch/base/2_anch/run/format/")
        .when(event_type == "signup", "/a/b/c/saved_models/d/simcse/x")
        .otherwise("/a/b/c/saved_models/d/e/custom_pretraining-7/x")
    )


def tensors(spark: SparkSession, sf: str) -> DataFrame:
    """Tensor inventory: suppliers as models, return flags as methods, lines as tensors."""
    lines = table(spark, sf, "lineitem")
    numel = (F.col("l_quantity") * 1000).cast("bigint")
    return lines.select(
        F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("model"),
        F.col("l_returnflag").alias("method"),
        numel.alias("numel"),
        F.when(F.col("l_linestatus") == "O", 4).otherwise(2).alias("element_size"),
        (F.col("l_linestatus") == "O").alias("requires_grad"),
        (F.col("l_linenumber") == 7).alias("is_buffer"),
        (numel * 4 + 64).alias("serialized_bytes"),
    )


def classification_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: doc_id, text, quality, toxic, n_chars."""
    documents = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return documents.join(table(spark, sf, "labels"), "doc_id")


def vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors folded into ten logits: logit ``k`` sums the values at places ``k``, ``k + 10``, …"""

    def folded(k: int) -> Column:
        mine = F.filter(F.col("embedding").cast("array<double>"), lambda x, i: i % 10 == k)
        return F.aggregate(mine, F.lit(0.0), lambda a, x: a + x)

    return table(spark, sf, "embeddings").select("vec_id", "label", F.array(*[folded(k) for k in range(10)]).alias("logits"))


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A user's turn with the assistant's turn right after it."""
    turns = table(spark, sf, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("sentence1"))
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2")
    )
    return asked.join(answered, ["conv_id", "turn"])
