"""Readers: CSV splits, stored datasets, CoNLL, notes, annotations, accounting."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool
from urllib.parse import quote

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from notemill.functions import text as tx
from notemill.functions.arrays import let
from notemill.operators.rows import unroll
from notemill.operators.runs import dirs_with
from notemill.operators.spans import token_lines
from notemill.runtime import fresh_path
from notemill.sources import csvparts

SPLITS = ("train", "validation", "test")


def _union(parts: list[DataFrame]) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def read_csv_splits(
    spark: SparkSession, paths: dict[str, str], schema: StructType | str | dict[str, StructType | str], multi_line: bool = True
) -> DataFrame:
    """One table of all splits, from one CSV path per split.

    ``schema`` is declared, for all splits or per split; a column one split lacks is
    NULL there. Quoted fields may span lines, and large files are still read by many tasks (``csvparts``);
    without ``multi_line`` they may not, which saves a pass over the files.
    """
    parts = []
    for split, path in paths.items():
        declared = schema[split] if isinstance(schema, dict) else schema
        if multi_line:
            rows = csvparts.read(spark, path, StructType.fromDDL(declared) if isinstance(declared, str) else declared)
        else:
            reader = spark.read.schema(declared).option("header", True)
            rows = reader.option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
        parts.append(rows.withColumn("split", F.lit(split)))
    return _union(parts)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset stored by ``write_dataset``; ``split`` comes from its folders."""
    return spark.read.parquet(f"{path}/data")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tags")


def _tagged(lines: Column) -> tuple[Column, Column]:
    """Token and label arrays from ``token label`` lines."""
    fields = F.transform(lines, lambda x: F.split(x, " "))
    tokens = F.transform(fields, lambda f: tx.strip(F.get(f, F.lit(0))))
    labels = F.transform(fields, lambda f: tx.strip(F.get(f, F.lit(1))))
    return tokens, labels


def _conll_blocks(spark: SparkSession, path: str, newline: str) -> DataFrame:
    """Large files read in parallel: records end at an empty line."""
    files = spark.read.text(path, lineSep=newline * 2)
    names = [c for c in files.columns if c != "value"]
    return files.select(
        *names,
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value"),
    )


def read_conll(
    spark: SparkSession, path: str | dict[str, str], compat: bool = False, newline: str = "\n"
) -> DataFrame:
    """CoNLL files to ``(split, file, block, sent_id, tokens, ner_tags_str)``.

    ``path`` is a folder with ``split=…`` parts or a path per split. Records are cut
    at empty lines, so a file of any size is read by many tasks; lines that hold only
    whitespace cut further inside a record. (file, block, sent_id) follow the order
    of the file. The last sentence is kept and empty ones are dropped; ``compat``
    loses the unterminated last sentence and keeps empty ones.
    """
    if isinstance(path, dict):
        parts = [
            read_conll(spark, p, compat, newline).withColumn("split", F.lit(split))
            for split, p in path.items()
        ]
        return _union(parts)
    if compat:
        return _read_conll_compat(spark, path)
    blocks = _conll_blocks(spark, path, newline)
    names = [c for c in blocks.columns if c != "value"]
    lines = F.split(tx.normalise_newlines(F.col("value")), "\n", -1)
    return _cut_sentences(blocks.withColumn("__lines", lines), names, keep_open=True).filter(F.size("tokens") > 0)


_OPEN, _MIDDLE, _CLOSE, _DONE = range(4)


def _fragments(keep: int):
    """For ``mapInArrow``: lines to sentences closed inside a byte range, and to the parts that cross its borders.

    A range without a blank line is a middle; any other has a head up to its first blank line, which closes what
    earlier ranges left open, and a tail behind its last one. Such parts can be joined in any grouping.
    """

    spaces = tx.SPACE_CHARS

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        at, held, n, kept = None, [], 0, None

        def rows(ids, kinds, lines):
            """Rows of the range at hand; the kept columns are those of its first line."""
            size = len(ids)
            same = [pa.repeat(v, size) for v in (*kept, *at)]
            return pa.RecordBatch.from_arrays([*same, pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), lines], names=names)

        def rest():
            lines = pa.concat_arrays([a.cast(pa.string()) for a in held]) if held else pa.array([], pa.string())
            return rows([n], [_OPEN if n else _MIDDLE], pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines))

        for batch in batches:
            names = [*batch.schema.names[:keep], "file", "block", "sent_id", "kind", "lines"]
            lines = batch.column(keep + 2)
            blank = pc.equal(pc.utf8_trim(lines, characters=spaces), "").to_numpy(zero_copy_only=False)
            file, block = batch.column(keep).dictionary_encode().indices.to_numpy(), batch.column(keep + 1).to_numpy()
            edges = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if first == last:
                    continue
                here = (batch.column(keep)[first], batch.column(keep + 1)[first])
                if here != at:
                    if at is not None:
                        yield rest()
                    at, held, n, kept = here, [], 0, [batch.column(k)[first] for k in range(keep)]
                closes = np.flatnonzero(blank[first:last])
                if not len(closes):
                    held.append(lines.slice(first, last - first))
                    continue
                stop = int(closes[-1])
                inner = lines.slice(first, stop + 1).filter(pa.array(~blank[first : first + stop + 1]))
                before = sum(map(len, held))
                # Of the lines up to a closing one, those that are not blank belong to sentences.
                ends = before + closes - np.arange(len(closes))
                flat = pa.concat_arrays([a.cast(pa.string()) for a in [*held, inner]])
                kinds = np.full(len(closes), _DONE)
                kinds[0] = _DONE if n else _CLOSE
                yield rows(n + np.arange(len(closes)), kinds, pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), flat))
                n += len(closes)
                held = [lines.slice(first + stop + 1, last - first - stop - 1)]
        if at is not None:
            yield rest()

    return run


def _read_conll_compat(spark: SparkSession, path: str) -> DataFrame:
    """Every blank line closes a sentence, empty or not; what no blank line closes is lost. The largest row is a sentence."""
    lines = spark.read.text(path)
    names = [c for c in lines.columns if c != "value"]
    placed = lines.select(*names, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    schema = StructType([*[placed.schema[c] for c in names], *StructType.fromDDL("file string, block long, sent_id long, kind int, lines array<string>")])
    found = placed.mapInArrow(_fragments(len(names)), schema)
    parts = found.filter(F.col("kind") != _DONE)
    # A range has two parts at most; an open tail begins a sentence, and so does the file.
    along = Window.partitionBy("file").orderBy("block", F.desc("kind"))
    numbered = parts.withColumn("__group", F.sum((F.col("kind") == _OPEN).cast("int")).over(along))
    ordered = F.array_sort(F.collect_list(F.struct("block", (-F.col("kind")).alias("kind"), "sent_id", "lines")))
    first = F.min(F.struct("block", (-F.col("kind")).alias("kind"), "sent_id"))
    stitched = numbered.groupBy("file", "__group").agg(
        *[F.first(c).alias(c) for c in names], first.alias("__first"), F.bool_or(F.col("kind") == _CLOSE).alias("__closed"),
        F.flatten(ordered["lines"]).alias("lines"),
    ).filter("__closed")
    columns = [*names, "file", "block", "sent_id", "lines"]
    every = found.filter(F.col("kind") == _DONE).select(*columns).unionByName(
        stitched.select(*names, "file", F.col("__first.block").alias("block"), F.col("__first.sent_id").alias("sent_id"), "lines")
    )
    tokens, labels = _tagged(F.col("lines"))
    return every.select(*names, "file", "block", "sent_id", tokens.alias("tokens"), labels.alias("ner_tags_str"))


def _cut_sentences(df: DataFrame, names: Sequence[str], keep_open: bool) -> DataFrame:
    """Explode ``__lines`` into sentences, each closed by a blank line.

    ``keep_open`` also takes what follows the last blank line.
    """

    def bounds(lines: Column) -> Column:
        n = F.size(lines)
        places = F.transform(lines, lambda x, i: F.when(tx.is_blank(x), i))
        blanks = F.filter(places, lambda i: i.isNotNull())
        closes = F.concat(blanks, F.array(n)) if keep_open else blanks
        return let(
            closes,
            lambda c: F.transform(
                c, lambda stop, k: F.struct(F.coalesce(F.get(c, k - 1) + 1, F.lit(0)).alias("start"), stop.alias("stop"))
            ),
        )

    def sentences(lines: Column) -> Column:
        return F.transform(bounds(lines), lambda b: F.slice(lines, b["start"] + 1, b["stop"] - b["start"]))

    cut = unroll(df, names, let(F.col("__lines"), sentences), "__sentence")
    tokens, labels = _tagged(F.col("__sentence"))
    return cut.select(
        *names,
        F.monotonically_increasing_id().alias("sent_id"),
        tokens.alias("tokens"),
        labels.alias("ner_tags_str"),
    )


def _subfolders(spark: SparkSession, path: str) -> list[str]:
    """Folders right under ``path``; a path with a pattern names its files itself."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    entries, found = store.listStatusIterator(place), []
    while entries.hasNext():
        entry = entries.next()
        if entry.getPath().getName().startswith(("_", ".")):
            continue  # as Spark's readers do
        if not entry.isDirectory():
            return []  # files lie in the folder itself
        found.append(entry.getPath().toString())
    return sorted(found)


def _whole_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``(doc_id, text)`` per file; the id is the file's name without its suffix. Empty files have no row.

    Spark keeps the list of a read's files on the driver. Where files are dealt over subfolders (``write_files``), tasks list
    these and read the files, so the driver holds the names of the folders only. In a store that Arrow does not open, a few
    folders are read and staged at a time.
    """
    places = _subfolders(spark, path)
    if places and _opens(places[0]):
        return _texts(_in_tasks(spark, places, suffix), suffix)
    return _staged(spark, places, suffix) if places else _texts(_by_spark(spark, path, suffix), suffix)


def _texts(files: DataFrame, suffix: str) -> DataFrame:
    return files.select(
        doc_id_from_name(F.col("name"), suffix).alias("doc_id"), tx.normalise_newlines(F.col("value")).alias("text")
    )


def _by_spark(spark: SparkSession, place: str, suffix: str) -> DataFrame:
    files = spark.read.text(place, wholetext=True, pathGlobFilter=f"*{suffix}")
    return files.select(F.col("_metadata.file_name").alias("name"), "value")


def _staged(spark: SparkSession, places: list[str], suffix: str) -> DataFrame:
    """The files of ``_AT_ONCE`` folders at a time, listed by the driver and written as one table."""
    staged, width = fresh_path(spark, "files"), spark.sparkContext.defaultParallelism

    def write(job: tuple[int, str]) -> None:
        rows = _texts(_by_spark(spark, job[1], suffix), suffix)
        rows.coalesce(width).write.parquet(f"{staged}/folder={job[0]}")

    pool = ThreadPool(_AT_ONCE)
    try:
        pool.map(write, enumerate(places), chunksize=1)
    finally:
        pool.close()
    return spark.read.schema("doc_id string, text string").parquet(staged).select("doc_id", "text")


#: Folders of files that are read side by side.
_AT_ONCE = 3


def _store(place: str):
    """Arrow's file system for a folder as Hadoop names it, and the folder's path there."""
    from pyarrow import fs

    if place.startswith("file:"):
        return fs.LocalFileSystem(), "/" + place[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(place)


def _opens(place: str) -> bool:
    """Whether Arrow reads from the store of this folder."""
    try:
        _store(place)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def _hidden(name: str) -> bool:
    """Names that Spark's readers skip."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _spark_name(name: str) -> str:
    """The file's name as in Spark's metadata: in the form of a URI's path."""

    def kept(c: str) -> bool:
        if c < "\x80":
            return c.isalnum() or c in "_-!.~'()*:@&=+$,;/"
        return c >= "\xa0" and unicodedata.category(c)[0] != "Z"

    return "".join(c if kept(c) else quote(c, safe="") for c in name)


#: Bytes of texts that a task hands on at once.
_HANDED_ON = 4_000_000


def _in_tasks(spark: SparkSession, places: list[str], suffix: str) -> DataFrame:
    """``(name, value)`` of the files in these folders that are not empty: a task lists a folder, and the files are dealt out."""

    def listed(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for place in batch.column(0).to_pylist():
                store, root = _store(place)
                found = store.get_file_info(fs.FileSelector(root))
                names = [i.base_name for i in found if i.type == fs.FileType.File and i.size and i.base_name.endswith(suffix)]
                names = [n for n in names if not _hidden(n)]
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(names), pa.string()), pa.array(names, pa.string())], names=["place", "name"])

    def read(batches):
        import pyarrow as pa

        stores = {}
        for batch in batches:
            names, texts, held = [], [], 0
            for place, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if place not in stores:
                    stores[place] = _store(place)
                store, root = stores[place]
                with store.open_input_file(f"{root}/{name}") as file:
                    texts.append(file.read())
                names.append(_spark_name(name))
                held += len(texts[-1])
                if held >= _HANDED_ON:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["name", "value"])
                    names, texts, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["name", "value"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = spark.createDataFrame([(p,) for p in places], "place string").mapInArrow(listed, "place string, name string")
    files = names.repartition(parts, "place", "name").mapInArrow(read, "name string, value binary")
    return files.select("name", F.col("value").cast("string").alias("value"))


def doc_id_from_name(name: Column, suffix: str) -> Column:
    return F.when(F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix)))


def patient_of(doc_id: Column, digits: int | None = None) -> Column:
    """Patient number of a document: its id, or the first ``digits`` characters of it.

    Files with one note per patient are named after the patient; files with several
    carry the patient in front (``180-03`` is patient 180).
    """
    number = doc_id if digits is None else F.substring(doc_id, 1, digits)
    return number.cast("int")


def read_token_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes as token lines: ``(doc_id, line_no, leading_space, tokens)``."""
    return token_lines(_whole_files(spark, path, ".txt"))


def parse_concepts(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Concept lines to spans; a line of another form keeps NULL fields (see ``concept_rejects``)."""
    rest = [c for c in files.columns if c != text_col]
    lines = files.select(*rest, F.posexplode(tx.text_lines(F.col(text_col))).alias("span_idx", "__line"))
    fields = tx.parse_position(tx.strip(F.col("__line")))
    return lines.select(*rest, "span_idx", *[c.alias(name) for name, c in fields.items()])


def concept_rejects(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Lines of concept files that have another form, blank ones aside: the file's columns, ``span_idx``, ``line``."""
    rest = [c for c in files.columns if c != text_col]
    lines = files.select(*rest, F.posexplode(tx.text_lines(F.col(text_col))).alias("span_idx", "line"))
    bad = tx.parse_position(tx.strip(F.col("line")))["type"].isNull()
    return lines.filter(bad & ~tx.is_blank(F.col("line")))


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Concept files: ``(doc_id, span_idx, start_line, start_pos, end_line, end_pos, type, stated)``."""
    return parse_concepts(_whole_files(spark, path, ".con"))


# What encloses the body of an annotated file.
BODY_OPEN = "<TEXT><![CDATA["
BODY_CLOSE = "]]></TEXT>"


def parse_span_xml(
    files: DataFrame, tags: str | Sequence[str] = "*", type_attr: str = "type", text_col: str = "text"
) -> DataFrame:
    """Annotated files to ``(…, text, spans, rejects)``, all inside the row.

    ``spans`` is an array of (span_idx, begin, end, type, stated) with 0-based begin
    and exclusive end. ``tags`` names the annotation elements, ``"*"`` takes all. Only
    the elements of the tag sections are parsed, with bare ampersands and angle brackets
    escaped first, so a body that is no XML does no harm. ``rejects`` has a reason for
    each element that cannot be read and for a missing body, whose ``text`` is NULL; see ``xml_rejects``.
    """
    rest = [c for c in files.columns if c != text_col]
    whole = F.col(text_col)
    has_body = F.contains(whole, F.lit(BODY_OPEN)) & F.contains(whole, F.lit(BODY_CLOSE))
    body = F.substring_index(F.substring(whole, F.instr(whole, BODY_OPEN) + len(BODY_OPEN), F.length(whole)), BODY_CLOSE, 1)
    section = F.regexp_extract(whole, r"(?s)<TAGS(?:\s[^>]*)?>.*</TAGS>|<TAGS(?:\s[^>]*)?/>", 0)
    # The wanted elements take one common name, which keeps their order over all names.
    names = r"(?!TAGS\b)[\w.-]+" if tags == "*" else "|".join([tags] if isinstance(tags, str) else tags)
    section = F.regexp_replace(section, rf"<(/?)(?:{names})(?=[\s/>])", "<$1TAG")
    split = files.select(
        *rest, F.when(has_body, body).alias("text"), section.alias("__tags"),
        F.regexp_extract_all(section, F.lit(_ELEMENT), 0).alias("__elements"),
    )
    # Each element is read on its own, so one that is malformed does not take others along.
    element = f"STRUCT<_start: STRING, _end: STRING, _{type_attr}: STRING, _text: STRING>"
    clean = F.transform("__elements", lambda e: F.regexp_replace(F.regexp_replace(e, r"(?<!^)<", "&lt;"), r"\s*/?>$", " />"))
    joined = F.regexp_replace(F.array_join(clean, ""), r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)", "&amp;")
    rows = split.withColumn("__xml", F.concat(F.lit("<TAGS>"), joined, F.lit("</TAGS>"))).withColumn(
        "__parsed", F.from_xml("__xml", f"STRUCT<TAG: ARRAY<{element}>>")
    ).withColumn("__found", F.coalesce(F.col("__parsed.TAG"), F.array().cast(f"ARRAY<{element}>")))
    spans = F.transform(
        "__found",
        lambda a: F.struct(
            F.lit(0).alias("span_idx"),
            a["_start"].try_cast("int").alias("begin"),
            a["_end"].try_cast("int").alias("end"),
            a[f"_{type_attr}"].alias("type"),
            tx.collapse_ws(a["_text"]).alias("stated"),
        ),
    )
    whole_spans = lambda c: F.filter(c, lambda s: s["begin"].isNotNull() & s["end"].isNotNull())
    lost = F.regexp_count("__tags", F.lit(r"<TAG(?=[\s/>])")) - F.size("__found")
    reasons = F.concat(
        F.when(F.col("text").isNull(), F.array(F.lit("no text body"))).otherwise(F.array().cast("array<string>")),
        F.array_repeat(F.lit("element cannot be read"), F.greatest(lost, F.lit(0)).cast("int")),
        F.array_repeat(F.lit("begin or end is no number"), (F.size("__found") - F.size(whole_spans(spans))).cast("int")),
    )
    numbered = F.transform(whole_spans(spans), lambda s, i: s.withField("span_idx", i))
    return rows.select(*rest, "text", numbered.alias("spans"), reasons.alias("rejects"))


#: One annotation element with its attributes, up to the end of its opening tag.
_ELEMENT = r"""<TAG(?:\s+[\w.:-]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*/?>"""


def xml_rejects(parsed: DataFrame) -> DataFrame:
    """One row for each thing that ``parse_span_xml`` could not read: the file's columns and ``reason``."""
    rest = [c for c in parsed.columns if c not in ("text", "spans", "rejects")]
    return unroll(parsed, rest, "rejects", "reason")


def read_span_xml(
    spark: SparkSession, path: str, tags: str | Sequence[str] = "*", type_attr: str = "type"
) -> DataFrame:
    """Annotated XML files: ``(doc_id, text, spans, rejects)``."""
    return parse_span_xml(_whole_files(spark, path, ".xml"), tags, type_attr)


def stand_off(notes: DataFrame) -> DataFrame:
    """The spans of annotated notes as a flat table."""
    return unroll(notes, ["doc_id"], "spans", "s").select("doc_id", "s.*")


def read_accounting(spark: SparkSession, path: str) -> DataFrame:
    """``model -> method -> fields`` files to ``(model, method, fields MAP)``.

    Reads JSON, and YAML of the plain two-level layout (two spaces a level, one
    ``name: value`` per line). Quotes go, ``null`` becomes NULL. A flat JSON of
    ``model -> value`` has no methods: its rows have a NULL method and one field, ``value``.
    """
    files = spark.read.text(path, wholetext=True)
    if path.endswith(".json"):
        models = files.select(F.explode(F.from_json("value", "map<string,string>")).alias("model", "__inner"))
        methods = F.from_json("__inner", "map<string,map<string,string>>")
        nested = models.filter(F.startswith("__inner", F.lit("{"))).select("model", F.explode(methods).alias("method", "fields"))
        flat = models.filter(~F.startswith("__inner", F.lit("{"))).select(
            "model", F.lit(None).cast("string").alias("method"), F.create_map(F.lit("value"), F.col("__inner")).alias("fields")
        )
        return nested.unionByName(flat)
    blocks = files.select(F.explode(F.split("value", r"\n(?=\S)")).alias("block"))
    models = blocks.select(
        F.regexp_extract("block", r"^([^\n]+):", 1).alias("model"),
        F.explode(F.split(F.regexp_replace("block", r"^[^\n]+\n", ""), r"\n(?= {2}\S)")).alias("part"),
    )
    lines = F.split(F.rtrim("part"), "\n")
    lines = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    pairs = F.transform(lines, lambda x: F.split(F.trim(x), ": *", 2))
    value = F.map_from_entries(
        F.transform(
            pairs,
            lambda p: F.struct(
                F.get(p, F.lit(0)),
                F.nullif(F.regexp_replace(F.get(p, F.lit(1)), "^['\"]|['\"]$", ""), F.lit("null")),
            ),
        )
    )
    return models.select(
        "model", F.regexp_extract("part", r"^ *([^\n]+):", 1).alias("method"), value.alias("fields")
    )


def accounting_columns(accounting: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Typed columns of an accounting table: ``{field: type}``."""
    return accounting.select(
        "model", "method", *[F.col("fields")[name].cast(kind).alias(name) for name, kind in fields.items()]
    )


def scan_run_dirs(spark: SparkSession, root: str, needle: str = "tfevents") -> DataFrame:
    """Folders under ``root`` that hold a log file; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return dirs_with(files.select("path"), needle)
