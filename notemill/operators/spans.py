"""Stand-off spans to token labels.

Two flavours: spans over (line, token) positions, and spans over character offsets.
Both end in one row per line with parallel ``tokens`` and ``labels`` arrays. A line
meets its spans through an equi join on (doc_id, line_no); the spans of a line are
first reduced to one per distinct range and type, so repeated annotations do not
pile up.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import text as tx
from notemill.functions.arrays import let, running_starts
from notemill.operators.painting import labelled_lines, labelled_words
from notemill.operators.rows import unroll

_LINE = ["doc_id", "line_no"]


def attach_spans(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """Every note row with each of its spans; notes without spans stay.

    Each span carries the note's columns, so give the narrow ones. An outer join could
    not split a note with very many spans; an inner join and the notes left over can.
    """
    found = notes.join(spans, "doc_id")
    bare = notes.join(spans.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(bare, allowMissingColumns=True)


def drop_blank_type(spans: DataFrame) -> DataFrame:
    return spans.filter(~tx.is_blank(F.col("type")))


# --- token positions -----------------------------------------------------------


def token_lines(notes: DataFrame, text_col: str = "text", keep_blank: bool = True) -> DataFrame:
    """``(…, line_no, leading_space, tokens)``: one row per line."""
    rest = [c for c in notes.columns if c != text_col]
    lines = unroll(notes, rest, tx.text_lines(F.col(text_col)), "line", "line_no")
    if not keep_blank:
        lines = lines.filter(~tx.is_blank(F.col("line")))
    return lines.select(
        *rest,
        "line_no",
        F.startswith("line", F.lit(" ")).alias("leading_space"),
        tx.nonblank_tokens(F.col("line")).alias("tokens"),
    )


def _pieces_by_line(spans: DataFrame) -> DataFrame:
    """Each span cut at line borders: (line, from, to), ``to`` NULL for line end."""
    cut = spans.filter(F.col("end_line") >= F.col("start_line")).withColumn(
        "__line", F.explode(F.sequence("start_line", "end_line"))
    )
    opens = F.col("__line") == F.col("start_line")
    closes = F.col("__line") == F.col("end_line")
    return cut.select(
        "doc_id",
        (F.col("__line") - 1).alias("line_no"),
        F.when(opens, F.col("start_pos")).otherwise(F.lit(0)).alias("lo"),
        F.when(closes, F.col("end_pos")).alias("hi"),
        opens.alias("opens"),
        closes.alias("closes"),
        "type",
        "span_idx",
    )


#: Stands between the tokens of a line on its way to its spans.
_MARK = "\x01"


def _joined_tokens(lines: DataFrame) -> DataFrame:
    """``tokens`` as one string where the mark tells them apart again: arrays of short strings take several times the space.

    A null token is a mark more, as is a mark in a token; such lines keep their array.
    """
    whole = lines.withColumn("__joined", F.array_join("tokens", _MARK, _MARK))
    marks = F.length("__joined") - F.length(F.replace("__joined", F.lit(_MARK), F.lit("")))
    # The number, which is never below 0, keeps later filters on the tokens from being computed here, from the line, once more.
    told = whole.withColumn("__told", (marks == F.size("tokens") - 1) & (F.monotonically_increasing_id() >= 0))
    return told.withColumns({
        "__joined": F.when(F.col("__told"), F.col("__joined")),
        "tokens": F.when(F.col("__told"), F.lit(None)).otherwise(F.col("tokens")),
    }).drop("__told")


def label_token_spans(tokens: DataFrame, spans: DataFrame, compat: bool = False) -> DataFrame:
    """Token lines with BIO ``labels``; a later span wins where spans overlap.

    ``tokens``: doc_id, line_no (from 0), leading_space, tokens. ``spans``: doc_id,
    span_idx, start_line, start_pos, end_line, end_pos, type, with lines from 1,
    positions from 0 and inclusive ends. ``compat`` leaves the gaps at inner line
    borders of multi-line spans.
    """
    ranges = ["lo", "hi", "opens", "closes"]
    last = _pieces_by_line(spans).groupBy(*_LINE, *ranges, "type").agg(F.max("span_idx").alias("span_idx"))
    per_line = last.groupBy(*_LINE).agg(
        F.collect_list(F.struct(*ranges, "span_idx", "type")).alias("__pieces")
    )
    joined = _joined_tokens(tokens).join(per_line, _LINE, "left")
    joined = joined.withColumn("tokens", F.coalesce(F.split("__joined", _MARK, -1), "tokens"))
    n = F.size("tokens")
    shift = F.when(F.col("leading_space"), F.lit(1)).otherwise(F.lit(0))

    def cells(piece: Column) -> Column:
        lo = F.greatest(F.when(piece["opens"], piece["lo"] - shift).otherwise(F.lit(0)), F.lit(0))
        end = F.when(piece["closes"], piece["hi"] - shift).otherwise(n - 1)
        hi = F.least(end, n - 1)
        head, tail = piece["opens"], piece["closes"]
        if compat:
            first = F.when(head, lo).otherwise(lo + 1)
            stop = F.when(tail, hi).otherwise(hi - 1)
            # A piece that closes here always labels its last token.
            first = F.when(tail, F.least(first, hi)).otherwise(first)
            stop = F.when(head, F.greatest(stop, lo)).otherwise(stop)
        else:
            first, stop = lo, hi
        none = F.array().cast("array<int>")
        positions = F.when(first <= stop, F.sequence(first.cast("int"), stop.cast("int"))).otherwise(none)
        return F.transform(
            positions,
            lambda p: F.struct(
                p.alias("pos"),
                (-piece["span_idx"]).alias("rank"),
                F.concat(F.when(head & (p == lo), F.lit("B-")).otherwise(F.lit("I-")), piece["type"]).alias("label"),
            ),
        )

    def winners(covered: Column) -> Column:
        # Ascending (position, -span_idx): the first cell of a position is the winner.
        return F.filter(
            covered, lambda c, i: (i == 0) | (F.get(covered, i - 1)["pos"] != c["pos"])
        )

    def filled(won: Column) -> Column:
        def with_gap(c: Column, i: Column) -> Column:
            gap = c["pos"] - F.coalesce(F.get(won, i - 1)["pos"], F.lit(-1)) - 1
            return F.concat(F.array_repeat(F.lit("O"), gap.cast("int")), F.array(c["label"]))

        rest = n - 1 - F.coalesce(F.get(won, F.size(won) - 1)["pos"], F.lit(-1))
        return F.concat(
            F.flatten(F.transform(won, with_gap)), F.array_repeat(F.lit("O"), rest.cast("int"))
        )

    covered = F.array_sort(F.flatten(F.transform("__pieces", cells)))
    labels = F.when(F.col("__pieces").isNull(), F.array_repeat(F.lit("O"), n)).otherwise(
        let(let(covered, winners), filled)
    )
    return joined.select(*tokens.columns, labels.alias("labels"))


def token_span_text_violations(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Single-line spans whose lower-cased tokens differ from the stated text."""
    single = spans.filter(F.col("start_line") == F.col("end_line")).withColumn(
        "line_no", F.col("start_line") - 1
    )
    joined = single.join(tokens.select(*_LINE, "leading_space", "tokens"), _LINE, "left")
    shift = F.when(F.col("leading_space"), F.lit(1)).otherwise(F.lit(0))
    lo, hi = F.col("start_pos") - shift, F.col("end_pos") - shift
    sliced = F.when((lo >= 0) & (hi >= lo), F.slice("tokens", lo + 1, hi - lo + 1))
    observed = F.lower(F.array_join(sliced, " "))
    return joined.withColumn("observed", observed).filter(
        ~F.col("observed").eqNullSafe(F.col("stated"))
    ).select("doc_id", "span_idx", "observed", "stated")


# --- character offsets ---------------------------------------------------------


def line_offsets(notes: DataFrame, text_col: str = "text") -> DataFrame:
    """``(…, line_no, line_start, line)`` with 0-based starts; newlines count one."""
    rest = [c for c in notes.columns if c != text_col]
    lines = F.split(F.col(text_col), "\n", -1)
    with_lines = notes.select(*rest, lines.alias("__lines"))
    starts = running_starts(F.transform("__lines", lambda x: F.length(x) + 1))
    rows = F.arrays_zip(F.col("__lines").alias("line"), starts.alias("line_start"))
    exploded = unroll(with_lines, rest, rows, "__row", "line_no")
    return exploded.select(*rest, "line_no", F.col("__row.line_start"), F.col("__row.line"))


def clip_spans(lines: DataFrame, spans: DataFrame, stretch_bits: int = 10) -> DataFrame:
    """Spans cut at line borders: ``(doc_id, line_no, lo, hi, opens, type, span_idx)``.

    ``spans`` hold 0-based ``begin`` and exclusive ``end`` offsets. Lines and spans
    meet on (doc_id, stretch of characters), so a long document is spread over tasks
    and a span sees only nearby lines; each pair is kept in one stretch only.
    """
    narrow = lines.select(
        *_LINE, "line_start", (F.col("line_start") + F.length("line") + 1).alias("__end")
    )

    def stretch(offset: Column) -> Column:
        return F.shiftright(offset, stretch_bits)

    def stretches(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(stretch(first), stretch(last)))

    left = narrow.withColumn("__at", stretches(F.col("line_start"), F.col("__end") - 1))
    right = spans.filter(F.col("end") > F.col("begin")).select(
        "doc_id", "span_idx", "begin", "end", "type",
        stretches(F.col("begin"), F.col("end") - 1).alias("__at"),
    )
    first_shared = F.greatest(stretch(F.col("line_start")), stretch(F.col("begin")))
    meet = left.join(right, ["doc_id", "__at"]).filter(
        (F.col("begin") < F.col("__end"))
        & (F.col("end") > F.col("line_start"))
        & (F.col("__at") == first_shared)
    )
    return meet.select(
        *_LINE,
        (F.greatest("begin", "line_start") - F.col("line_start")).cast("int").alias("lo"),
        (F.least("end", "__end") - F.col("line_start")).cast("int").alias("hi"),
        (F.col("begin") >= F.col("line_start")).alias("opens"),
        "type",
        "span_idx",
    )


def locate_offsets(lines: DataFrame, spans: DataFrame, stretch_bits: int = 10) -> DataFrame:
    """First and last (line, character) of each span, characters from 0 and inclusive."""
    clipped = clip_spans(lines, spans, stretch_bits)
    return clipped.groupBy("doc_id", "span_idx").agg(
        F.min(F.struct("line_no", "lo")).alias("__first"),
        F.max(F.struct("line_no", "hi")).alias("__last"),
    ).select(
        "doc_id",
        "span_idx",
        F.col("__first.line_no").alias("start_line"),
        F.col("__first.lo").alias("start_char"),
        F.col("__last.line_no").alias("end_line"),
        (F.col("__last.hi") - 1).alias("end_char"),
    )


def words_from_spans(lines: DataFrame, clipped: DataFrame) -> DataFrame:
    """Lines with words and BIO labels, from spans clipped to lines; lines without words drop out.

    Borders of words are whitespace and every change of type.
    """
    last = clipped.groupBy(*_LINE, "lo", "hi", "opens", "type").agg(F.max("span_idx").alias("span_idx"))
    per_line = last.groupBy(*_LINE).agg(
        F.collect_list(F.struct("span_idx", "lo", "hi", "opens", "type")).alias("__clips")
    )
    keep = [c for c in lines.columns if c != "line"]
    shown = lines.filter(~tx.is_blank(F.col("line"))).join(per_line, _LINE, "left")
    found = shown.withColumn("__words", labelled_words()("line", "__clips"))
    return found.select(*keep, "__words.tokens", "__words.labels")


def last_spans(spans: DataFrame) -> DataFrame:
    """One row per distinct character range and type: the latest, which is the one that counts."""
    return spans.groupBy("doc_id", "begin", "end", "type").agg(F.max("span_idx").alias("span_idx"))


def label_char_spans(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """Notes and stand-off character spans to lines with words and BIO labels."""
    lines = line_offsets(notes)
    return words_from_spans(lines, clip_spans(lines, last_spans(spans)))


def label_annotated_notes(notes: DataFrame, skip_blank_types: bool = True) -> DataFrame:
    """Same result for notes that carry their own ``spans`` array, without any shuffle.

    An annotated file holds its text and its tags together, so every line finds its
    spans inside the row.
    """
    keep = [c for c in notes.columns if c not in ("text", "spans", "rejects")]

    def usable(s: Column) -> Column:
        long_enough = s["end"] > s["begin"]
        return long_enough & ~tx.is_blank(s["type"]) if skip_blank_types else long_enough

    needed = F.transform(F.filter("spans", usable), lambda s: F.struct(s["span_idx"], s["begin"], s["end"], s["type"]))
    packed = notes.select(*keep, "text", needed.alias("__spans"))
    lines = unroll(packed, keep, labelled_lines()("text", "__spans"), "__line")
    return lines.select(*keep, "__line.*")


def span_text_violations(
    notes: DataFrame, spans: DataFrame, lower: bool = False
) -> DataFrame:
    """Spans whose text in the note, whitespace collapsed, differs from the stated text.

    The observed text is put together from the span's lines; the pieces of one span
    are as many as its lines.
    """
    lines = line_offsets(notes.select("doc_id", "text"))
    clipped = clip_spans(lines, spans)
    cut = clipped.join(lines, _LINE).select(
        "doc_id",
        "span_idx",
        "line_no",
        tx.collapse_ws(F.substring("line", F.col("lo") + 1, F.col("hi") - F.col("lo"))).alias("__cut"),
    )
    observed = cut.groupBy("doc_id", "span_idx").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "__cut"))).alias("__cuts")
    )
    joined = spans.join(observed, ["doc_id", "span_idx"], "left")
    seen = F.array_join(F.filter(F.transform("__cuts", lambda x: x["__cut"]), lambda x: x != ""), " ")
    joined = joined.withColumn("observed", F.lower(seen) if lower else seen)
    expected = tx.unescape_for(F.col("observed"), tx.collapse_ws(F.col("stated")))
    return joined.withColumn("expected", expected).filter(
        ~F.col("observed").eqNullSafe(F.col("expected"))
    ).select("doc_id", "span_idx", "observed", "expected")


def stated_text_check():
    """Arrow function (text, spans) -> number of spans whose text is another than stated, and the first of them.

    As ``span_text_violations``, inside the row: no line and no span is shuffled.
    """

    @F.arrow_udf("struct<n:bigint,span_idx:int,observed:string,expected:string>")
    def check(texts: pa.Array, spans: pa.Array) -> pa.Array:
        import pyarrow as pa

        def differs(text: str, s: dict) -> tuple | None:
            lo, hi = max(s["begin"], 0), min(s["end"], len(text) + 1)
            seen = " ".join(text[lo:hi].split()) if lo < hi else None
            want = None if s["stated"] is None else " ".join(s["stated"].split())
            for entity, sign in (("&apos;", "'"), ("&quot;", '"')):
                if seen is not None and want is not None and entity in seen and entity not in want:
                    want = want.replace(sign, entity)
            return None if seen == want else (s["span_idx"], seen, want)

        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            n, first = 0, (None, None, None)
            for s in (found or []) if text is not None else []:
                wrong = differs(text, s)
                if wrong:
                    first = first if n else wrong
                    n += 1
            out.append({"n": n, "span_idx": first[0], "observed": first[1], "expected": first[2]})
        kind = pa.struct([("n", pa.int64()), ("span_idx", pa.int32()), ("observed", pa.string()), ("expected", pa.string())])
        return pa.array(out, kind)

    return check


def check_spans(violations: DataFrame, match_text: bool = True) -> None:
    """Raise with an example where annotations do not match their text."""
    if not match_text:
        return
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"annotation does not match its text: {first[0].asDict()}")


# --- corrections ---------------------------------------------------------------

_MAX_CORRECTIONS = 10_000


def _correction_table(df: DataFrame, rows: list[tuple], key: str, schema: str) -> DataFrame:
    if len(rows) > _MAX_CORRECTIONS:
        raise ValueError("corrections are a hand-kept list; keep larger tables out of the driver")
    if len({row[0] for row in rows}) != len(rows):
        raise ValueError(f"more than one correction for one {key}")
    table = df.sparkSession.createDataFrame(rows, f"{key} {df.schema[key].dataType.simpleString()}, {schema}")
    return F.broadcast(table)


def apply_line_corrections(
    lines: DataFrame, corrections: list[tuple], key: str = "doc_id"
) -> DataFrame:
    """Insert text into known bad lines.

    Corrections are ``(key, needle, at, insert)``: in lines of that key which contain
    the needle, ``insert`` goes in at character ``at``.
    """
    table = _correction_table(lines, corrections, key, "__needle string, __at int, __insert string")
    hit = F.contains("line", F.col("__needle"))
    fixed = F.concat(
        F.substring(F.col("line"), F.lit(1), F.col("__at")),
        F.col("__insert"),
        F.substring(F.col("line"), F.col("__at") + 1, F.length("line")),
    )
    return lines.join(table, key, "left").withColumn(
        "line", F.when(hit, fixed).otherwise(F.col("line"))
    ).select(*lines.columns)


def apply_span_corrections(
    spans: DataFrame, corrections: list[tuple], key: str = "doc_id"
) -> DataFrame:
    """Replace known wrong span texts: ``(key, stated, replacement)``."""
    table = _correction_table(spans, corrections, key, "__old string, __new string")
    return spans.join(table, key, "left").withColumn(
        "stated", F.when(F.col("stated") == F.col("__old"), F.col("__new")).otherwise(F.col("stated"))
    ).select(*spans.columns)
