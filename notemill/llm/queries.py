"""The dealt operators over the whole given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import chat, decontam, licenses, mixing, neardup, ordermin, quality, ranking, repair, secrets, sharding, suffixes, tokenids
from notemill.llm.turns import digests
from notemill.runtime import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_licenses(spark, sf):
    """All documents as files ``source/lang/thousand/id.txt``: their own or inherited licence."""
    docs = table(spark, sf, "documents")
    place = F.concat_ws("/", "source", "lang", F.expr("doc_id div 1000"), F.concat(F.col("doc_id"), F.lit(".txt")))
    found = licenses.scan(docs.select("doc_id", "text", place.alias("path")))
    return found.select("doc_id", "path", "license", "via", F.round("cosine", 6).alias("cosine"), "license_dir")


@query
def op2_sharding(spark, sf):
    """All documents in 40 shards under the law ``rows``, written in slot order and read back."""
    placed = sharding.shard(table(spark, sf, "documents"), shards=40)
    text = F.coalesce("text", F.lit(""))
    return sharding.write(placed, fresh_path(spark, "shards")).select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("row").alias("row_number"),
    )


def joined_spans(findings):
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op3_secrets(spark, sf):
    """Secrets in all documents: fixed patterns, and spans that the trained field adds."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    base = F.filter("findings", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in secrets.KINDS], F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("findings")).alias("spans"),
    )


def encoded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents written as token files and read back from them."""
    import public_tokenizers

    folder = fresh_path(spark, "token-files")
    tokenids.write(docs, folder, public_tokenizers.path(VOCABULARY), end_id=1)
    back = tokenids.read(spark, folder, dict(docs.dtypes)["doc_id"])
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op4_token_ids(spark, sf):
    """All documents as token ids in Huffman-coded files, read back."""
    return encoded(spark, table(spark, sf, "documents"))


@query
def op5_near_dup(spark, sf):
    """All documents: three-word shingles, linked at a similarity of 85 percent."""
    return neardup.near_duplicates(table(spark, sf, "documents"), width=3, percent=85)


@query
def op6_mixing(spark, sf):
    """All documents mixed by the weights 3, 1, 2 to 150% of their words; what is taken is counted in the written shards."""
    mixture = mixing.mix(table(spark, sf, "documents"))
    rows = mixing.taken(mixture.rows, mixing.write(mixture.mixed, fresh_path(spark, "mixed")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "draws")


@query
def op7_decontamination(spark, sf):
    """Every benchmark passage in a document, up to 8 percent of edits."""
    docs, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    marked = decontam.mark(docs, items, min_chars=0)
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query
def op8_suffix_dedup(spark, sf):
    """All documents without the bytes of repeated 200-byte strings."""
    return suffixes.remove_repeats(table(spark, sf, "documents"), length=200).drop("kept")


@query
def op9_fingerprints(spark, sf):
    """Order MinHash of all documents and their edited texts."""
    return ordermin.fingerprints(table(spark, sf, "documents"))


@query
def op10_quality(spark, sf):
    """Every document's quality by a machine fitted on labels that are not held out."""
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op11_chat_formatting(spark, sf):
    """All conversations, and one that is full of marks, formatted, written and read back."""
    turns = table(spark, sf, "conversations")
    marks = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    folder = fresh_path(spark, "chats")
    chat.write(chat.format_turns(turns.select("conv_id", "turn", "role", "text").unionByName(planted)), folder)
    back = chat.read(spark, folder).withColumn("said", F.concat("role", F.lit("\n"), "text", F.lit("\n")))
    counts = back.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("learned").cast("long")).alias("loss_chars"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.count_if(~F.col("ok")).alias("out_of_order"), F.max_by("state", F.struct("part", "at")).alias("last_role"),
    )
    hashed = digests(back, ["part", "at"], {"said": "", "learned": ""})
    return counts.join(hashed.withColumnRenamed("conv_id", "key"), F.col("conv_id").eqNullSafe(F.col("key"))).select(
        "conv_id", "n_turns", F.col("said").alias("turns_sha256"), "loss_chars", F.col("learned").alias("loss_sha256"), "formatted_chars",
        "out_of_order", (F.col("out_of_order") == 0).__and__(F.col("last_role").isin(*chat.INSTRUCT.ends)).alias("valid"),
    )


ORACLES["op11_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), judged AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
    length(replace(text, '\', '\\'))
      + len(regexp_extract_all(text, '</?s>|</?sys>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]'))
      + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 ELSE 7 END AS n
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (coalesce(before, 'start') || '>' || role NOT IN
    ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS out_of_order,
  out_of_order = 0 AND max_by(role, turn) = 'assistant' AS valid
FROM judged GROUP BY conv_id
"""


def damaged(turns):
    """Conversation rows, faulty by the checksum of ``conv_id:turn``: dropped, emptied, unpunctuated, repeated or of role user."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat_ws(":", one_space("conv_id"), one_space("turn"))), F.lit(20))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(one_space("text"), "[.!?]", "")).otherwise(one_space("text"))
    row = F.struct("conv_id", "turn", F.when(fault == 4, "user").otherwise(one_space("role")).alias("role"), text.alias("text"))
    copies = F.array_repeat(row, F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1))
    return turns.select(F.explode(copies).alias("row")).select("row.*")


@query
def op12_conversation_repair(spark, sf):
    """All conversations, damaged and then repaired at the least cost."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    fixed = repair.repair(damaged(turns))
    lines = fixed.rows.select("conv_id", "part", "at", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    hashed = digests(lines, ["part", "at", "step"], {"line": "\n"}).withColumnRenamed("conv_id", "hash_key")
    found = fixed.conversations.withColumnRenamed("conv_id", "key")
    every = turns.select("conv_id").distinct()
    every = every.join(found, F.col("conv_id").eqNullSafe(F.col("key")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("hash_key")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("line", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op13_ranked_search(spark, sf):
    """The 10 best documents of each benchmark item."""
    return ranking.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


ORACLES["op13_ranked_search"] = r"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counted AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL
), docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id
), totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN docs USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
