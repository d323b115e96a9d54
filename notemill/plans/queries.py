"""Every operator over the driver's tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import arrays, naming
from notemill.functions import text as tx
from notemill.functions.text import word_pieces
from notemill.operators import accounting as acc
from notemill.operators import conll, encode, metrics, runs, sampling, spans, structured, subwords, train
from notemill.operators.rows import unroll
from notemill.plans import flows
from notemill.plans import standins as st
from notemill.runtime import fresh_path, stage
from notemill.sources import catalog, readers, writers
from notemill.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r(name: str, digits: int = 6):
    return F.round(F.col(name).cast("double"), digits).alias(name)


# --- sampling and splits ---------------------------------------------------------


@query
def class_count(spark, sf):
    rows = st.classification_rows(spark, sf).join(
        sampling.halve_split(st.table(spark, sf, "labels").select("doc_id"), "doc_id", names=("validation", "train")), "doc_id"
    )
    return sampling.class_count(rows, "quality")


@query
def class_sizes(spark, sf):
    return sampling.class_sizes(st.table(spark, sf, "labels"), "quality")


@query
def rows_of_class(spark, sf):
    return sampling.rows_of_class(st.table(spark, sf, "labels"), "toxic", 1).select("doc_id", "quality")


@query
def split_sizes(spark, sf):
    lines = st.token_lines(spark, sf).select("doc_id", "source", "line_no")
    placed = sampling.assign_split(lines, st.split_by_source(spark, sf), "source")
    return sampling.split_sizes(placed, "doc_id", "n_sentences")


@query
def fewshot_labels(spark, sf):
    labels = st.table(spark, sf, "labels").select("doc_id", "quality")
    return sampling.few_shot(labels, "quality", 64, "doc_id")


@query
def fewshot_embeddings(spark, sf):
    rows = st.table(spark, sf, "embeddings")
    return sampling.few_shot(rows, "label", 8, "vec_id").select("vec_id", "label", F.size("embedding").alias("width"))


@query
def fewshot_splits(spark, sf):
    rows = st.table(spark, sf, "labels").select("doc_id", "toxic")
    halves = sampling.halve_split(rows, "doc_id", names=("train", "validation"))
    sampled = sampling.few_shot_splits(halves, "toxic", "doc_id", train_n=16, eval_n=8)
    return sampling.with_test_split(sampled, "doc_id", has_test=False).select("doc_id", "toxic", "split")


@query
def group_split_90_10(spark, sf):
    documents = st.table(spark, sf, "documents").select("doc_id", "source")
    return sampling.assign_split(documents, st.split_by_source(spark, sf), "source")


@query
def split_by_site(spark, sf):
    documents = st.table(spark, sf, "documents").select("doc_id", "lang", (F.col("doc_id") % 97).alias("patient"))
    split = sampling.group_split(documents, "patient", by="lang")
    return sampling.assign_split(documents, split, ["lang", "patient"])


@query
def row_split_50_50(spark, sf):
    return sampling.halve_split(st.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query
def seeded_shuffle_rank(spark, sf):
    from notemill.operators.ordered import hash_rank

    return hash_rank(st.table(spark, sf, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "rank")


@query
def split_null_site(spark, sf):
    """A split by site and patient where both can be missing."""
    documents = st.table(spark, sf, "documents").select(
        "doc_id", F.nullif("lang", F.lit("fr")).alias("lang"), F.nullif(F.col("doc_id") % 97, F.lit(0)).alias("patient")
    )
    split = sampling.group_split(documents, "patient", by="lang")
    placed = sampling.assign_split(documents, split, ["lang", "patient"])
    return placed.select("doc_id", "lang", F.coalesce("patient", F.lit(-1)).alias("patient"), "split")


@query
def halves_repeated_ids(spark, sf):
    """Turns cut in halves by conversation: rows that share an id stay together."""
    return sampling.halve_split(st.table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id")


@query
def preview_row(spark, sf):
    documents = st.table(spark, sf, "documents").select("doc_id", "text")
    return sampling.preview_row(documents, "doc_id")


@query
def merge_corpora(spark, sf):
    documents = st.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    turns = st.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    pages = st.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    merged = sampling.merge_corpora({"documents": documents, "turns": turns, "pages": pages})
    return merged.groupBy("corpus", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")
    )


@query
def id_set_mismatch(spark, sf):
    return sampling.id_set_mismatch(
        st.table(spark, sf, "documents"), st.table(spark, sf, "labels"), "doc_id"
    )


@query
def sentences_by_group(spark, sf):
    rows = st.token_lines(spark, sf, keep_blank=False)
    ordered = sampling.sentences_by_group(rows, st.split_by_source(spark, sf), "source", "doc_id", "line_no")
    return ordered.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.sum(F.size("tokens")).alias("n_tokens")
    )


@query
def sentence_order(spark, sf):
    """Each sentence's place in the order of its group, counted along the sorted rows."""
    from notemill.operators.ordered import running

    rows = st.token_lines(spark, sf, keep_blank=False).select("doc_id", "line_no", "source")
    ordered = sampling.sentences_by_group(rows, st.split_by_source(spark, sf), "source", "doc_id", "line_no")
    placed = stage(ordered.withColumn("seq", F.monotonically_increasing_id()), "ordered-sentences")
    counted = running(placed, ["split", "source"], ["seq"], F.shiftright("seq", 33), {"place": ("count", F.lit(1))})
    return counted.select("split", "source", "doc_id", "line_no", "place")


# --- notes, lines, spans ---------------------------------------------------------


@query
def token_grid(spark, sf):
    lines = st.token_lines(spark, sf)
    return unroll(lines, ["doc_id", "line_no", "leading_space"], "tokens", "token", "pos")


@query
def line_offsets(spark, sf):
    lines = spans.line_offsets(st.notes(spark, sf))
    return lines.select("doc_id", "line_no", "line_start", F.length("line").alias("line_len"))


def _chunks(spark, sf, names: bool):
    is_name = F.col("type") == "NAME"
    return st.line_chunks(spark, sf).filter(is_name if names else ~is_name).select(
        "doc_id", "line_no", F.col("begin").alias("first_pos"), F.col("end").alias("last_pos"), "type", "text"
    )


@query
def pii_spans(spark, sf):
    return _chunks(spark, sf, names=False)


@query
def cap_spans(spark, sf):
    return _chunks(spark, sf, names=True)


@query
def attach_spans(spark, sf):
    """Notes with their spans; notes without any stay."""
    notes = st.notes(spark, sf).select("doc_id", "lang")
    attached = spans.attach_spans(notes, st.char_spans(spark, sf))
    return attached.select("doc_id", "lang", F.coalesce("begin", F.lit(-1)).alias("begin"), "type")


@query
def bio_token_spans(spark, sf):
    labelled = st.labelled(spark, sf)
    return _tokens(labelled)


def _tokens(labelled):
    rows = unroll(labelled, ["doc_id", "line_no"], F.arrays_zip("tokens", "labels"), "t", "pos")
    return rows.select("doc_id", "line_no", "pos", F.col("t.tokens").alias("token"), F.col("t.labels").alias("label"))


@query
def bio_char_spans(spark, sf):
    return _tokens(spans.label_char_spans(st.notes(spark, sf).select("doc_id", "text"), st.char_spans(spark, sf)))


@query
def xml_event_labels(spark, sf):
    """Annotated XML text, parsed and labelled inside the row."""
    parsed = readers.parse_span_xml(st.annotation_files(spark, sf), tags="EVENT")
    return _tokens(spans.label_annotated_notes(parsed))


@query
def xml_spans(spark, sf):
    parsed = readers.parse_span_xml(st.annotation_files(spark, sf), tags="*")
    flat = readers.stand_off(parsed)
    return flat.select("doc_id", "span_idx", "begin", "end", "type", "stated")


def _broken_files(spark, sf):
    """Annotation files whose offsets (de), quotes (es) or body mark (fr) are broken."""
    whole = F.col("text")
    broken = (
        F.when(F.col("lang") == "de", F.replace(whole, F.lit('<EVENT start="'), F.lit('<EVENT start="x')))
        .when(F.col("lang") == "es", F.replace(whole, F.lit(' type="'), F.lit(" type=")))
        .when(F.col("lang") == "fr", F.replace(whole, F.lit(readers.BODY_OPEN), F.lit("<TEXT>")))
        .otherwise(whole)
    )
    return st.annotation_files(spark, sf).withColumn("text", broken)


@query
def xml_rejects(spark, sf):
    """What cannot be read of broken annotation files, by file and reason."""
    parsed = readers.parse_span_xml(_broken_files(spark, sf), tags="EVENT")
    return readers.xml_rejects(parsed).groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def xml_sections(spark, sf):
    """Files whose elements lie in a section with attributes, have a bare ``<`` or ``&``, and name the type ``TYPE``."""
    whole = F.replace("text", F.lit("<TAGS>"), F.lit('<TAGS id="1">'))
    whole = F.replace(F.replace(whole, F.lit(' type="'), F.lit(' note="a & b < c" TYPE="')), F.lit('<root>'), F.lit("<root a=1>"))
    files = st.annotation_files(spark, sf).withColumn("text", whole)
    flat = readers.stand_off(readers.parse_span_xml(files, tags="*", type_attr="TYPE"))
    return flat.select("doc_id", "span_idx", "begin", "end", "type", "stated")


@query
def concept_rejects(spark, sf):
    """Concept lines whose end position lost its colon."""
    rows = st.line_chunks(spark, sf)
    mark = F.when(F.col("type") == "NUM", F.lit(" ")).otherwise(F.lit(":"))
    line = F.concat(
        F.lit('c="'), "text", F.lit('" 1:'), "begin", F.lit(" 1"), mark, "end", F.lit('||t="'), F.col("type"), F.lit('"')
    )
    rejected = readers.concept_rejects(rows.select("doc_id", line.alias("text")))
    return rejected.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query
def span_locations(spark, sf):
    lines = spans.line_offsets(st.notes(spark, sf).select("doc_id", "text"))
    return spans.locate_offsets(lines, st.char_spans(spark, sf))


@query
def span_text_check(spark, sf):
    """Spans whose stated text was lower-cased: the check finds those with capitals."""
    stated = st.char_spans(spark, sf).withColumn("stated", F.lower("stated"))
    return spans.span_text_violations(st.notes(spark, sf).select("doc_id", "text"), stated)


@query
def token_span_check(spark, sf):
    """Single-line spans with one letter of their text replaced."""
    stated = st.token_spans(spark, sf).withColumn("stated", F.replace("stated", F.lit("z"), F.lit("s")))
    return spans.token_span_text_violations(st.token_lines(spark, sf), stated)


@query
def concept_lines(spark, sf):
    """Concept text of each line, parsed back to positions."""
    rows = st.token_spans(spark, sf).filter(F.col("type") != "WRAP")
    line = F.concat(
        F.lit('c="'), "stated", F.lit('" '),
        "start_line", F.lit(":"), "start_pos", F.lit(" "), "end_line", F.lit(":"), "end_pos",
        F.lit('||t="'), F.lower("type"), F.lit('"'),
    )
    files = rows.select("doc_id", F.col("span_idx").alias("file_idx"), line.alias("text"))
    return readers.parse_concepts(files).select(
        "doc_id", "start_line", "start_pos", "end_line", "end_pos", "type", "stated"
    )


def _labelled_files(spark, sf, stated, **checks):
    """All notes and their concepts as ``.txt`` and ``.con`` files in one folder, read by suffix and labelled."""
    folder = fresh_path(spark, "note-files")
    rows = st.token_spans(spark, sf)
    line = F.concat(
        F.lit('c="'), stated, F.lit('" '), "start_line", F.lit(":"), "start_pos", F.lit(" "), "end_line", F.lit(":"), "end_pos",
        F.lit('||t="'), "type", F.lit('"'),
    )
    lines = F.array_sort(F.collect_list(F.struct("span_idx", line.alias("line"))))
    concepts = rows.groupBy("doc_id").agg(F.array_join(lines["line"], "\n").alias("text"))
    notes = st.notes(spark, sf)
    folders = writers.folders_for(st.table(spark, sf, "documents").count())
    writers.write_files(notes, folder, ".txt", folders=folders)
    writers.write_files(concepts, folder, ".con", folders=folders)
    labelled = flows.label_notes(readers.read_token_notes(spark, folder), readers.read_concepts(spark, folder), **checks)
    return _tokens(labelled.filter(F.size("tokens") > 0).withColumn("doc_id", F.col("doc_id").cast("long")))


@query
def note_files(spark, sf):
    """Notes and concepts through files: found by suffix, named by id, checked, labelled."""
    return _labelled_files(spark, sf, F.col("stated"))


@query
def note_files_unchecked(spark, sf):
    """As ``note_files``, with wrong stated texts and the check switched off."""
    return _labelled_files(spark, sf, F.concat(F.lit("not "), "stated"), match_text=False)


@query
def corrections_overlay(spark, sf):
    """Lines changed by corrections of two sources."""
    lines = spans.line_offsets(st.notes(spark, sf).select("doc_id", "source", "text"))
    rules = [("src3", ".", 2, "    "), ("src7", "@", 0, "> ")]
    fixed = spans.apply_line_corrections(lines, rules, key="source")
    changed = fixed.join(lines.select("doc_id", "line_no", F.col("line").alias("old")), ["doc_id", "line_no"])
    return changed.filter(F.col("line") != F.col("old")).select("doc_id", "line_no", "line")


@query
def span_corrections(spark, sf):
    rows = st.char_spans(spark, sf)
    fixed = spans.apply_span_corrections(rows.withColumn("key", F.col("type")), [("NUM", "2024", "year"), ("EMAIL", "x@y", "z")], "key")
    return fixed.groupBy("type", "stated").agg(F.count(F.lit(1)).alias("n"))


@query
def label_format_violations(spark, sf):
    """German notes as tagged with an ``S-`` scheme: their labels break the format."""
    rows = st.labelled(spark, sf)
    foreign = F.transform("labels", lambda t: F.replace(t, F.lit("B-"), F.lit("S-")))
    mixed = rows.withColumn("labels", F.when(F.col("lang") == "de", foreign).otherwise(F.col("labels")))
    return conll.label_format_violations(mixed)


# --- vocabularies, CoNLL -----------------------------------------------------------


@query
def label_vocab(spark, sf):
    return conll.label_vocab(st.token_spans(spark, sf))


@query
def tag_vocab(spark, sf):
    return conll.tag_vocab(st.labelled(spark, sf))


@query
def tag_count(spark, sf):
    return conll.tag_count(conll.tag_vocab(st.labelled(spark, sf)))


@query
def tag_encode(spark, sf):
    rows = stage(st.labelled(spark, sf), "labelled")
    tags = conll.tag_list(conll.tag_vocab(rows))
    coded = conll.decode_tags(conll.encode_tags(rows, tags), tags, "ner_tags", "names")
    out = unroll(coded, ["doc_id", "line_no"], F.arrays_zip("ner_tags", "names"), "t", "pos")
    return out.select("doc_id", "line_no", "pos", F.col("t.ner_tags").alias("tag_id"), F.col("t.names").alias("tag"))


@query
def label_histogram(spark, sf):
    return conll.label_histogram(st.labelled(spark, sf))


@query
def unseen_labels(spark, sf):
    """Types by the first three letters of a name: those that training lacks."""
    lines = st.token_lines(spark, sf, keep_blank=False)
    tag = F.transform(
        "tokens",
        lambda t: F.when(F.rlike(t, F.lit(st.NAME_TOKEN)), F.concat(F.lit("B-"), F.substring(t, 1, 3))).otherwise("O"),
    )
    rows = sampling.assign_split(lines.withColumn("labels", tag), st.split_by_source(spark, sf), "source")
    vocab = conll.tag_vocab(rows.filter(F.col("split") == "train"))
    return conll.unseen_labels(rows.filter(F.col("split") == "validation"), vocab)


@query
def conll_lines(spark, sf):
    return writers.conll_text(st.labelled(spark, sf)).select("doc_id", "line_no", "value")


@query
def conll_roundtrip(spark, sf):
    path = fresh_path(spark, "conll")
    writers.write_conll(st.labelled_splits(spark, sf), path, order=["doc_id", "line_no"])
    back = readers.read_conll(spark, path)
    return back.select("split", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tags_str", " ").alias("tags"))


@query
def conll_compat(spark, sf):
    """Every line as a sentence, also those without words, read as sentences that blank lines close."""
    path = fresh_path(spark, "conll-compat")
    rows = writers.conll_text(st.labelled_splits(spark, sf, keep_blank=True)).select("split", "value")
    rows.write.partitionBy("split").option("lineSep", "\n\n").text(path)
    back = readers.read_conll(spark, path, compat=True)
    return back.select("split", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tags_str", " ").alias("tags"))


@query
def dataset_roundtrip(spark, sf):
    path = fresh_path(spark, "dataset")
    flows.build_ner_dataset(st.labelled_splits(spark, sf), path)
    return _stored_sentences(spark, path)


def _stored_sentences(spark, path):
    """Every stored sentence whole, its tags named by the stored vocabulary."""
    names = conll.tag_list(readers.read_tags(spark, path))
    stored = conll.decode_tags(readers.read_dataset(spark, path), names, "ner_tags", "names")
    return stored.select("split", F.array_join("tokens", " ").alias("tokens"), F.array_join("names", " ").alias("tags"))


@query
def xml_dataset_flow(spark, sf):
    """Annotated files checked, labelled, split by patient, stored and read back."""
    files = st.annotation_files(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string"))
    path = fresh_path(spark, "xml-dataset")
    flows.xml_to_dataset(readers.parse_span_xml(files.select("doc_id", "text"), tags="EVENT"), path, digits=2)
    return _stored_sentences(spark, path)


@query
def label_vocab_file(spark, sf):
    """The tag file, read back in order."""
    path = fresh_path(spark, "tag-file")
    writers.write_label_vocab(conll.tag_vocab(st.labelled(spark, sf)), path)
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("tag_id"), F.col("value").alias("tag"))


@query
def accounting_files(spark, sf):
    """Accounting written as two-level YAML, two-level JSON and flat JSON, read back."""
    counts = acc.param_counts(st.tensors(spark, sf), ["model", "method"])
    pair = lambda name: F.concat(F.lit(f"    {name}: "), F.col(name))
    part = F.concat_ws("\n", F.concat(F.lit("  "), "method", F.lit(":")), pair("n_trainable_params"), pair("total_params"))
    models = counts.groupBy("model").agg(
        F.concat(F.col("model"), F.lit(":\n"), F.array_join(F.array_sort(F.collect_list(part)), "\n")).alias("yaml"),
        F.map_from_entries(F.collect_list(F.struct("method", F.create_map(
            F.lit("total_params"), F.col("total_params").cast("string")
        )))).alias("methods"),
        F.sum("total_params").cast("string").alias("flat"),
    )
    one_file = lambda c: models.agg(c.alias("value")).coalesce(1)
    as_json = lambda c: F.to_json(F.map_from_entries(F.collect_list(F.struct("model", c))))
    paths = {k: fresh_path(spark, "accounting") + f".{k.split('-')[0]}" for k in ("yaml", "json-two", "json-flat")}
    one_file(F.array_join(F.array_sort(F.collect_list("yaml")), "\n")).write.text(paths["yaml"])
    one_file(as_json("methods")).write.text(paths["json-two"])
    one_file(as_json("flat")).write.text(paths["json-flat"])
    read = {k: readers.read_accounting(spark, p) for k, p in paths.items()}
    out = None
    for k, rows in read.items():
        rows = rows.select(
            F.lit(k).alias("kind"), "model", "method",
            F.coalesce(F.col("fields")["total_params"], F.col("fields")["value"]).cast("long").alias("total"),
            F.coalesce(F.col("fields")["n_trainable_params"].cast("long"), F.lit(-1)).alias("trainable"),
        )
        out = rows if out is None else out.unionAll(rows)
    return out


@query
def run_dir_scan(spark, sf):
    """Log files in nested folders, found by their names."""
    root = fresh_path(spark, "log-tree")
    rows = _named_events(spark, sf).select(
        "task", "method", F.concat_ws(",", F.col("event_id").cast("string"), F.col("value").cast("string")).alias("value")
    )
    rows.write.partitionBy("task", "method").text(root)
    found = readers.scan_run_dirs(spark, root, needle="part-")
    names = "task=([^/]*)/method=([^/]*)$"
    return found.select(*[F.regexp_extract("dir", names, k + 1).alias(c) for k, c in enumerate(("task", "method"))])


@query
def blank_types_dropped(spark, sf):
    """Numbers as spans of a blank type, which labels leave out."""
    rows = st.char_spans(spark, sf).withColumn("type", F.when(F.col("type") == "NUM", F.lit(" ")).otherwise(F.col("type")))
    return spans.drop_blank_type(rows).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def unencodable_dropped(spark, sf):
    """Tokens without any letter or digit as those of no pieces; sentences left empty go."""
    rows = st.token_lines(spark, sf).select("doc_id", "line_no", "tokens")
    sized = rows.withColumn("n_pieces", F.transform("tokens", lambda t: F.when(F.rlike(t, F.lit(r"[\p{L}\p{N}]")), 1).otherwise(0)))
    cleaned = conll.drop_unencodable(conll.drop_empty_sentences(sized), "n_pieces", ["tokens"])
    return cleaned.select("doc_id", "line_no", F.array_join("tokens", " ").alias("tokens"))


def _task_rows(spark, sf):
    rows = st.classification_rows(spark, sf).select("text", "doc_id", "n_chars", "quality", "toxic")
    named = catalog.ensure_labels(catalog.drop_columns(rows, ["n_chars", "toxic"]), "quality")
    text = catalog.text_columns_by_position(named)
    return named.select("doc_id", "labels", *[F.md5(c).alias(f"{c}_md5") for c in text])


@query
def task_columns(spark, sf):
    """Rows of a task with its columns dropped, its label renamed, its text taken by position; the first 50."""
    return sampling.take(_task_rows(spark, sf), 50, "doc_id")


@query
def task_columns_whole(spark, sf):
    """All rows of a task with its columns dropped, its label renamed, its text taken by position."""
    return _task_rows(spark, sf)


@query
def entity_unescape(spark, sf):
    """Stated texts with signs where the note has entities: only one-sided ones are escaped."""
    rows = st.token_lines(spark, sf).select("doc_id", "line_no", F.explode("tokens").alias("t"))
    rows = rows.filter(F.contains("t", F.lit(",")))
    noted = F.replace("t", F.lit(","), F.lit("&quot;"))
    stated = F.replace("t", F.lit(","), F.lit('"'))
    same = tx.unescape_for(noted, stated) == noted
    return rows.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query
def csv_roundtrip(spark, sf):
    path = fresh_path(spark, "csv")
    rows = st.classification_rows(spark, sf).select("doc_id", "text", "quality")
    halves = sampling.halve_split(rows, "doc_id", names=("train", "validation"))
    three = sampling.with_test_split(halves, "doc_id", has_test=False)
    paths = {}
    for split in readers.SPLITS:
        paths[split] = f"{path}/{split}"
        flows.write_csv(three.filter(F.col("split") == split).drop("split"), paths[split])
    back = readers.read_csv_splits(spark, paths, three.drop("split").select("doc_id", "text", "quality").schema)
    return back.select("doc_id", "quality", "split", F.md5("text").alias("text_md5"))


@query
def sentence_ids(spark, sf):
    lines = spans.line_offsets(st.notes(spark, sf).select("doc_id", "text"))
    # A line that ends a paragraph stands in for the blank line between sentences.
    marked = lines.withColumn("content", F.when(F.endswith("line", F.lit(".")), F.lit(" ")).otherwise(F.col("line")))
    return conll.sentence_ids(marked, "doc_id", "line_no", "content").select("doc_id", "line_no", "sent_id")


@query
def subword_lengths(spark, sf):
    """Sub-word counts by a vocabulary of single letters: a word has as many pieces as characters."""
    rows = st.token_lines(spark, sf, keep_blank=False).select("doc_id", "line_no", "tokens")
    letters = rows.select(F.explode(F.flatten(F.transform("tokens", lambda t: F.split(t, "")))).alias("c"))
    known = [r["c"] for r in letters.filter("c <> ''").distinct().orderBy("c").collect()]  # bounded by Unicode
    vocab = [*encode.SPECIALS, *known, *[f"##{c}" for c in known]]
    sized = rows.withColumn("n_pieces", encode.piece_counts("tokens", vocab))
    return sized.select("doc_id", "line_no", F.aggregate("n_pieces", F.lit(0), lambda a, x: a + x).alias("n_pieces"))


@query
def length_split(spark, sf):
    rows = st.labelled(spark, sf).withColumn("n_pieces", encode.piece_counts("tokens"))
    cut = conll.split_long_sentences(rows, "n_pieces", ["tokens", "labels"], max_len=16)
    total = F.aggregate("n_pieces", F.lit(0), lambda a, x: a + x)
    return cut.select("doc_id", "line_no", "part", F.size("tokens").alias("n_tokens"), total.alias("n_pieces"))


# --- encoding ----------------------------------------------------------------------


def _vocab(spark, sf) -> list[str]:
    return encode.vocab_list(encode.build_vocab(st.notes(spark, sf), "text"))


@query
def word_vocab(spark, sf):
    return encode.build_vocab(st.notes(spark, sf), "text")


@query
def encode_text(spark, sf):
    coded = encode.encode_text(st.notes(spark, sf).select("doc_id", "text"), "text", _vocab(spark, sf))
    return unroll(coded, ["doc_id", "n_pieces"], "input_ids", "input_id", "pos")


@query
def encode_words(spark, sf):
    lines = st.token_lines(spark, sf, keep_blank=False)
    coded = encode.encode_words(lines, "tokens", _vocab(spark, sf))
    rows = unroll(coded, ["doc_id", "line_no"], F.arrays_zip("input_ids", "word_ids"), "t", "pos")
    return rows.select("doc_id", "line_no", "pos", F.col("t.input_ids").alias("input_id"), F.coalesce("t.word_ids", F.lit(-1)).alias("word_id"))


@query
def encode_subwords(spark, sf):
    """Greedy longest match over a vocabulary of word parts."""
    notes = st.notes(spark, sf).select("doc_id", "text")
    vocab = encode.vocab_list(encode.build_piece_vocab(notes, "text"))
    coded = encode.encode_text(notes, "text", vocab, subwords=True)
    return encode.truncation_report(coded, "n_pieces")


def _digest(ids):
    return F.md5(F.array_join(F.transform(ids, lambda i: i.cast("string")), " "))


@query
def subword_match(spark, sf):
    """Ids of all notes by greedy longest match."""
    notes = st.notes(spark, sf).select("doc_id", "text")
    vocab = encode.vocab_list(encode.build_piece_vocab(notes, "text"))
    coded = encode.encode_text(notes, "text", vocab, max_length=1 << 30, subwords=True)
    return coded.select("doc_id", "n_pieces", _digest("input_ids").alias("ids_md5"))


N_MERGES = 100


@query
def subword_merges(spark, sf):
    """The first merges of the notes' words."""
    merges = subwords.learn_merges(subwords.word_counts(st.notes(spark, sf), "text"), N_MERGES)
    rows = [(k + 1, m.left, m.right, m.joined, m.n) for k, m in enumerate(merges)]
    return spark.createDataFrame(rows, "step int, left string, right string, piece string, n long")


@query
def subword_encode(spark, sf):
    """All notes in the pieces of learned merges."""
    notes = st.notes(spark, sf).select("doc_id", "text")
    words = stage(subwords.word_counts(notes, "text"), "word-counts")
    merges = subwords.learn_merges(words, N_MERGES)
    table = subwords.MergeTable(subwords.merge_vocab(words, merges, encode.SPECIALS), merges, encode.UNK)
    coded = notes.withColumn("ids", F.flatten(subwords.lookup(table)(word_pieces(F.col("text")))))
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), _digest("ids").alias("ids_md5"))


@query
def encode_pair_lengths(spark, sf):
    pairs = st.turn_pairs(spark, sf)
    sized = pairs.withColumn("a", F.size(word_pieces(F.col("sentence1")))).withColumn(
        "b", F.size(word_pieces(F.col("sentence2")))
    )
    keep_a, keep_b = encode.pair_budget(F.col("a"), F.col("b"), 480)
    return sized.select("conv_id", "turn", "a", "b", keep_a.alias("keep_a"), keep_b.alias("keep_b"))


@query
def encode_pair(spark, sf):
    pairs = st.turn_pairs(spark, sf)
    coded = encode.encode_pair(pairs, "sentence1", "sentence2", _vocab(spark, sf))
    return unroll(coded, ["conv_id", "turn"], "input_ids", "input_id", "pos")


@query
def pad_batches(spark, sf):
    coded = encode.encode_text(st.notes(spark, sf).select("doc_id", "text"), "text", _vocab(spark, sf))
    padded = encode.pad_batches(coded.drop("text"), 32, "doc_id")
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    pads = F.size(F.filter("input_ids", lambda x: x == encode.PAD))
    return padded.select(
        "doc_id", "batch_id", "padded_len", F.size("input_ids").alias("length"), ones.alias("n_real"), pads.alias("n_pad")
    )


@query
def truncation_report(spark, sf):
    coded = encode.encode_text(st.notes(spark, sf).select("doc_id", "text"), "text", _vocab(spark, sf))
    report = encode.truncation_report(coded, "n_pieces")
    return report.select("n_rows", "n_cut", _r("share_cut"), "max_pieces", "pieces_lost")


@query
def decode_text(spark, sf):
    vocab = _vocab(spark, sf)
    coded = encode.encode_text(st.notes(spark, sf).select("doc_id", "text"), "text", vocab)
    return encode.decode(coded, "input_ids", vocab).select("doc_id", "decoded")


def _aligned(spark, sf, first_piece_only=False):
    rows = stage(st.labelled(spark, sf), "labelled")
    tags = conll.tag_list(conll.tag_vocab(rows))
    coded = conll.encode_tags(rows, tags)
    return encode.encode_ner(coded, _vocab(spark, sf), first_piece_only=first_piece_only)


@query
def align_labels(spark, sf):
    rows = _aligned(spark, sf)
    return unroll(rows, ["doc_id", "line_no"], "piece_labels", "label_id", "pos")


@query
def align_first_pieces(spark, sf):
    rows = _aligned(spark, sf, first_piece_only=True)
    return unroll(rows, [], "piece_labels", "label_id").groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))


@query
def mask_filter(spark, sf):
    """Pairs of (guess, label) without masked positions; a guess is the piece's parity."""
    rows = _aligned(spark, sf)
    guess = F.transform("input_ids", lambda i: (i % 2).cast("int"))
    pairs = unroll(rows, [], arrays.drop_masked(guess, F.col("piece_labels")), "p")
    return pairs.groupBy(F.col("p.pred").alias("pred"), F.col("p.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


# --- scores ------------------------------------------------------------------------


@query
def softmax_argmax(spark, sf):
    scored = metrics.with_scores(st.vector_rows(spark, sf), "logits")
    return scored.select(
        "vec_id", "prediction",
        F.round(F.array_max("probs"), 6).alias("p_max"),
        F.round(F.get("probs", F.lit(3)), 6).alias("p_3"),
    )


@query
def confusion(spark, sf):
    scored = metrics.with_scores(st.vector_rows(spark, sf), "logits")
    return metrics.confusion(scored, "label", "prediction")


@query
def class_scores(spark, sf):
    scored = metrics.with_scores(st.vector_rows(spark, sf), "logits")
    table = metrics.class_scores(metrics.confusion(scored, "label", "prediction"))
    return table.select("cls", "support", "predicted", "hits", _r("precision"), _r("recall"), _r("f1"))


@query
def accuracy(spark, sf):
    scored = metrics.with_scores(st.vector_rows(spark, sf), "logits")
    return metrics.accuracy(scored, "label", "prediction").select(_r("accuracy"))


@query
def macro_scores(spark, sf):
    """Macro precision and recall, and each average of F1, as one table."""
    conf = metrics.confusion(metrics.with_scores(st.vector_rows(spark, sf), "logits"), "label", "prediction")
    both = metrics.macro_precision_recall(conf)
    out = both.select(F.explode(F.create_map(F.lit("precision"), "precision", F.lit("recall"), "recall")).alias("name", "value"))
    for average in ("macro", "micro", "weighted"):
        row = metrics.f1(conf, average)
        out = out.unionAll(row.select(F.lit(f"f1_{average}"), F.col(f"f1_{average}")))
    return out.select("name", _r("value"))


@query
def seq_cls_metrics(spark, sf):
    row = metrics.seq_cls_metrics(st.vector_rows(spark, sf), "logits", "label")
    return metrics.prefix_metrics(row.select(*[_r(c) for c in row.columns]), "eval")


def _scored_labels(spark, sf):
    return st.classification_rows(spark, sf).select(
        "doc_id", "quality", "toxic", ((F.col("n_chars") % 1000).cast("double") / 1000).alias("score")
    )


@query
def auc_binary(spark, sf):
    return metrics.auc_binary(_scored_labels(spark, sf), "score", "toxic").select(_r("auc"))


@query
def auc_curve(spark, sf):
    """Cumulative positives and negatives by score."""
    rows = _scored_labels(spark, sf)
    return metrics.cumulative_pos_neg(rows, "score", F.col("quality") == 1).select(
        "score", "pos", "neg", "neg_below"
    )


@query
def auc_ovr_macro(spark, sf):
    scored = metrics.with_scores(st.vector_rows(spark, sf), "logits")
    return metrics.auc_ovr_macro(scored, "probs", "label").select(_r("auc"))


@query
def auc_undefined(spark, sf):
    """One class only: the score falls back to 0."""
    rows = _scored_labels(spark, sf).filter(F.col("toxic") == 1)
    return metrics.auc_or_zero(metrics.auc_binary(rows, "score", "toxic"), rows, fresh_path(spark, "rejects"))


@query
def entity_chunks(spark, sf):
    rows = st.labelled(spark, sf)
    chunks = rows.select("doc_id", "line_no", F.explode(arrays.entity_chunks(F.col("labels"))).alias("c"))
    return chunks.select(
        "doc_id", "line_no", F.col("c.begin").alias("first_pos"), F.col("c.end").alias("last_pos"), F.col("c.type").alias("type")
    )


@query
def entity_scores(spark, sf):
    """Labels against the patterns alone, which know no WRAP spans."""
    rows = st.labelled(spark, sf).withColumn("pred", st.rough_tags())
    scores = metrics.entity_scores(rows, "labels", "pred")
    return scores.select(*[_r(c) for c in scores.columns])


@query
def token_cls_metrics(spark, sf):
    """The same scores from logits per position, masked positions left out."""
    rows = stage(st.labelled(spark, sf).withColumn("pred", st.rough_tags()).select("labels", "pred"), "labelled")
    tags = conll.tag_list(conll.tag_vocab(rows))
    coded = conll.encode_tags(conll.encode_tags(rows, tags), tags, "pred", "guess")
    ids = F.lit(list(range(len(tags))))
    logits = F.transform("guess", lambda g: F.transform(ids, lambda k: F.when(k == g, 1.0).otherwise(0.0)))
    # A masked position in front, as an encoder puts one.
    masked = coded.select(
        F.concat(F.array(F.transform(ids, lambda k: k.cast("double"))), logits).alias("logits"),
        F.concat(F.array(F.lit(-100)), F.col("ner_tags")).alias("label_ids"),
    )
    scores = metrics.token_cls_metrics(masked, "logits", "label_ids", tags)
    return scores.select(*[_r(c) for c in scores.columns])


# --- runs --------------------------------------------------------------------------


@query
def best_checkpoint(spark, sf):
    return runs.best_checkpoint(st.history(spark, sf), "metric")


@query
def early_stop(spark, sf):
    return runs.early_stop(st.history(spark, sf), "metric", patience=5, threshold=0.5)


@query
def keep_latest(spark, sf):
    history = st.history(spark, sf).select("run", "step", "metric")
    best = runs.best_checkpoint(history, "metric")
    return runs.keep_latest(history, 2, best=best).select("run", "step")


@query
def time_budget(spark, sf):
    history = st.history(spark, sf).select("run", "step", "ts")
    return runs.time_budget(history, 5 * 86400).select("run", "step", "elapsed", "stopped")


@query
def cadence(spark, sf):
    return runs.cadence(st.history(spark, sf), 20).select("run", "step", "event_type")


def _named_events(spark, sf):
    events = st.table(spark, sf, "events")
    kind = F.col("event_type")
    few = F.when(kind == "view", 64).when(kind == "click", 16)
    method = F.when(F.col("value") > 20, "LORA").otherwise("Full")
    return events.select(
        "event_id", "ts", "value", few.alias("few_shot_n"), method.alias("method"),
        st.task_of(kind).alias("task"), naming.model_short_name(st.model_path_of(kind)).alias("model"),
    )


def _paths(spark, sf):
    path = naming.run_path("logs", F.col("task"), F.col("few_shot_n"), F.col("model"), F.col("method"), F.col("ts"))
    return _named_events(spark, sf).withColumn("path", path)


@query
def run_paths(spark, sf):
    return _paths(spark, sf).select("event_id", "path")


@query
def run_dirs(spark, sf):
    """Folders that hold a log, among files named after the events."""
    name = F.when(F.col("value") > 30, "events.out.tfevents.1").otherwise("config.json")
    files = _paths(spark, sf).select(F.concat("path", name).alias("path"))
    return runs.dirs_with(files)


@query
def run_manifest(spark, sf):
    rows = _named_events(spark, sf).groupBy("task", "model", "method").agg(F.count(F.lit(1)).alias("n_runs"))
    path = fresh_path(spark, "manifest")
    writers.append_run(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    return back.select(F.to_json(F.struct("task", "model", "method", "n_runs")).alias("manifest"))


@query
def warmup_steps(spark, sf):
    sizes = st.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("event_type", F.round(naming.warmup_steps(F.col("n"), 32, 8), 6).alias("steps"))


@query
def scaled_ranks(spark, sf):
    rows = st.table(spark, sf, "part")
    return rows.select("p_partkey", naming.scaled_int(F.col("p_size"), F.lit(0.5)).alias("alpha"))


@query
def task_lookup(spark, sf):
    kinds = st.table(spark, sf, "events").select("user_id", st.task_of(F.col("event_type")).alias("task"))
    found = catalog.resolve_task(kinds, catalog.task_catalog(spark))
    return found.groupBy("task", "known", "task_type", "label_name", "text_column_1", "text_column_2").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def live_budget(spark, sf):
    """Run states from the event stream: start, latest row, whether the budget is spent."""
    return monitor.run_states_of_events(spark, sf, "events.parquet", seconds=20 * 86400)


@query
def live_early_stop(spark, sf):
    """Early stops from a history that comes in three parts; the stream is started anew for each, from its checkpoint."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        history = st.history(spark, sf).select("run", "step", F.col("ts").cast("timestamp").alias("ts"), "metric")
        days = history.agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last")).first()
        width = (days["last"] - days["first"]).days // 3 + 1
        parts = stage(history.withColumn("part", F.floor(F.datediff("ts", F.lit(days["first"])) / width)), "history")
        arrived, out, log = fresh_path(spark, "arrived"), fresh_path(spark, "stops"), fresh_path(spark, "stops-log")
        for k in range(3):
            parts.filter(F.col("part") == k).drop("part").write.mode("append").parquet(arrived)
            stream = spark.readStream.schema(history.schema).parquet(arrived)
            monitor.store_updates(monitor.live_stops(stream, patience=5, threshold=0.5, seconds=432000), out, log)
        return monitor.latest_states(spark, out)
    finally:
        spark.conf.set(store, before)


# --- accounting ----------------------------------------------------------------------


@query
def param_budget(spark, sf):
    counts = acc.param_counts(st.tensors(spark, sf), ["model", "method"])
    shares = acc.param_shares(counts)
    return shares.select("model", "method", "n_trainable_params", "total_params", _r("n_trainable_params_perc"))


@query
def size_report(spark, sf):
    tensors = st.tensors(spark, sf)
    sizes = acc.model_size(acc.param_counts(tensors))
    full = acc.full_size(tensors)
    return sizes.join(full, "model").select(
        "model", _r("model_size_MB"), _r("model_size_GB"), "total_bytes", _r("full_model_size_MB"), _r("full_model_size_GB")
    )


@query
def method_matrix(spark, sf):
    counts = acc.param_counts(st.tensors(spark, sf), ["model", "method"])
    return acc.method_matrix(counts, "n_trainable_params", ["A", "N", "R"])


@query
def accounting_join(spark, sf):
    counts = acc.param_counts(st.tensors(spark, sf), ["model", "method"])
    method = F.when(F.col("event_type") == "view", "A").when(F.col("event_type") == "click", "N").otherwise("R")
    scored = st.table(spark, sf, "events").select(
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"), method.alias("method"), "value"
    )
    best = scored.groupBy("model", "method").agg(F.max("value").alias("best"))
    return acc.join_accounting(best, counts).select(
        "model", "method", "best", F.coalesce("n_trainable_params", F.lit(-1)).alias("n_trainable_params")
    )


# --- training ------------------------------------------------------------------------


@query
def linear_probe(spark, sf):
    rows = st.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    halves = stage(sampling.halve_split(rows, "vec_id", names=("train", "test")), "vectors")
    model = train.fit_linear_probe(halves.filter(F.col("split") == "train"), "embedding", "label")
    test = train.as_features(halves.filter(F.col("split") == "test"), "embedding")
    return train.evaluate_splits(model, {"test": test}, "label")


@query
def text_classifier(spark, sf):
    return flows.classify_text(st.classification_rows(spark, sf), "doc_id", "text", "toxic")


@query
def token_classifier(spark, sf):
    return flows.classify_tokens(st.labelled_splits(spark, sf), ["doc_id", "line_no"])


# What holds of a trained model whatever the fit; each name with whether it does, or a number.


@query
def linear_probe_facts(spark, sf):
    """Half of the vectors are scored; every row has ten shares that sum to one and a known class."""
    rows = st.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    halves = stage(sampling.halve_split(rows, "vec_id", names=("train", "test")), "vectors")
    model = train.fit_linear_probe(halves.filter(F.col("split") == "train"), "embedding", "label")
    scored = train.score(model, train.as_features(halves.filter(F.col("split") == "test"), "embedding"))
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return scored.agg(
        F.count(F.lit(1)).alias("n_scored"), F.max(F.size("probs")).alias("n_classes"),
        F.bool_and(F.abs(total - 1) < 1e-9).alias("shares_sum_to_one"),
        F.bool_and(F.col("prediction") == arrays.argmax(F.col("probs"))).alias("largest_share_wins"),
    )


@query
def text_classifier_facts(spark, sf):
    """Every score lies between 0 and 1, and accuracy is the micro average of F1."""
    row = stage(text_classifier(spark, sf), "text-scores")
    inside = [(F.col(c) >= 0) & (F.col(c) <= 1) for c in row.columns]
    facts = row.select(
        F.lit(len(row.columns)).alias("n_scores"), functools.reduce(lambda a, b: a & b, inside).alias("in_range"),
        (F.abs(F.col("test_accuracy") - F.col("test_f1_micro")) < 1e-9).alias("micro_is_accuracy"),
    )
    return facts


@query
def token_classifier_facts(spark, sf):
    """The classifier does better than calling every token the most frequent label."""
    sentences = stage(st.labelled_splits(spark, sf).select("split", "doc_id", "line_no", "tokens", "labels"), "sentences")
    row = flows.classify_tokens(sentences, ["doc_id", "line_no"])
    held = unroll(sentences.filter(F.col("split") == "validation"), [], "labels", "tag")
    total = held.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_tokens"), F.max("n").alias("n_most"))
    return _beats(row, total)


@query
def token_model_facts(spark, sf):
    """The structured model breaks the tag scheme nowhere, and finds entities at least as well as the plain classifier."""
    sentences = stage(st.labelled_splits(spark, sf).select("split", "doc_id", "line_no", "tokens", "labels"), "sentences")
    names = conll.tag_list(conll.tag_vocab(sentences))
    coded = conll.encode_tags(sentences, names).drop("labels")
    held = coded.filter(F.col("split") == "validation")
    tagger = structured.fit_tagger(coded.filter(F.col("split") == "train"), names)
    named = stage(conll.decode_tags(structured.predict_tags(tagger, held), names, "ner_tags", "true"), "predicted")
    plain = train.fit_token_classifier(coded.filter(F.col("split") == "train"), "tokens", "ner_tags", ["doc_id", "line_no"])
    scored = metrics.entity_scores(named, "true", "pred").select("f1", F.lit(True).alias("own")).unionByName(
        train.token_scores(plain, held, "tokens", "ner_tags", ["doc_id", "line_no"], names).select("f1", F.lit(False).alias("own"))
    )
    f1 = scored.agg(F.max(F.when(F.col("own"), F.col("f1"))).alias("own"), F.max(F.when(~F.col("own"), F.col("f1"))).alias("plain"), F.lit(1).alias("k"))
    counts = named.agg(
        F.count(F.lit(1)).alias("n_sentences"), F.coalesce(F.sum(conll.scheme_breaks(F.col("pred"))), F.lit(0)).alias("n_breaks"),
        F.bool_and(F.size("pred") == F.size("tokens")).alias("a_tag_each"), F.lit(1).alias("k"),
    )
    return counts.join(f1, "k").select("n_sentences", "n_breaks", "a_tag_each", (F.col("own") >= F.col("plain")).alias("at_least_plain"))


def _beats(row, total):
    both = row.select("eval_accuracy", F.lit(1).alias("k")).join(total.withColumn("k", F.lit(1)), "k")
    better = F.col("eval_accuracy") > F.col("n_most") / F.col("n_tokens")
    return both.select("n_tokens", "n_most", better.alias("beats_majority"))


@query
def search_facts(spark, sf):
    """Twenty trials, each stored once, with settings of the space and scores between 0 and 1."""
    rows = search_trials(spark, sf)
    return rows.agg(
        F.count(F.lit(1)).alias("n_trials"), F.countDistinct("trial").alias("n_numbers"),
        F.bool_and((F.col("rate") >= 1e-5) & (F.col("rate") <= 1e-3) & F.col("mix").isin(0.0, 0.5, 1.0)).alias("in_space"),
        F.bool_and((F.col("roc_auc_macro") >= 0) & (F.col("roc_auc_macro") <= 1)).alias("in_range"),
    )


def _probe_search(spark, sf):
    """A search over linear probes: ``search(n_trials, store)``, and the settings that were fitted."""
    rows = st.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    halves = stage(sampling.halve_split(rows, "vec_id", names=("train", "validation")), "vectors")
    parts = {s: train.as_features(halves.filter(F.col("split") == s), "embedding") for s in ("train", "validation")}
    ready = stage(parts["train"].select("features", "label"), "probe-rows")
    fitted = []

    def fit(params: dict):
        fitted.append(params)
        return train.fit_linear_probe(ready, "embedding", "label", regParam=params["rate"], elasticNetParam=params["mix"])

    space = {"rate": ("log_uniform", 1e-5, 1e-3), "mix": ("choice", [0.0, 0.5, 1.0])}
    return lambda n, store: train.search(fit, parts["validation"], "label", 10, space, "probe", n_trials=n, store=store), fitted


@query
def search_resumed(spark, sf):
    """Twelve trials, then twenty from the same store: only eight are run, and the twelve stay as they were."""
    search, fitted = _probe_search(spark, sf)
    store = fresh_path(spark, "trials")
    first = stage(search(12, store), "first-trials")
    before = len(fitted)
    every = search(20, store)
    kept = first.join(every, first.columns, "left_semi").agg(F.count(F.lit(1)).alias("n_kept"), F.lit(1).alias("k"))
    counts = every.agg(F.count(F.lit(1)).alias("n_trials"), F.countDistinct("trial").alias("n_numbers"), F.lit(1).alias("k"))
    return counts.join(kept, "k").select("n_trials", "n_numbers", "n_kept", F.lit(before).alias("n_first"), F.lit(len(fitted) - before).alias("n_resumed"))


@query
def search_trials(spark, sf):
    rows = st.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    halves = stage(sampling.halve_split(rows, "vec_id", names=("train", "validation")), "vectors")
    parts = {s: train.as_features(halves.filter(F.col("split") == s), "embedding") for s in ("train", "validation")}

    ready = parts["train"].select("features", "label").persist()

    def fit(params: dict):
        return train.fit_linear_probe(
            ready, "embedding", "label",
            regParam=params["rate"], elasticNetParam=params["mix"],
        )

    space = {"rate": ("log_uniform", 1e-5, 1e-3), "mix": ("choice", [0.0, 0.5, 1.0])}
    try:
        return train.search(
            fit, parts["validation"], "label", 10, space, "probe", n_trials=20, store=fresh_path(spark, "trials")
        )
    finally:
        ready.unpersist()
