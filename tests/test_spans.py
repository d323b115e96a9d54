"""Golden rows for span labelling."""

import pytest
from pyspark.sql import functions as F

from notemill.operators import spans as sp
from notemill.sources import readers as rd

SPANS = "doc_id string, span_idx int, start_line int, start_pos int, end_line int, end_pos int, type string, stated string"


def tokens(spark, text):
    return sp.token_lines(spark.createDataFrame([("d", text)], "doc_id string, text string"))


def labels(df):
    return [row["labels"] for row in df.orderBy("doc_id", "line_no").collect()]


NOTE = "Patient has chest pain .\n No acute distress\nFever today\nsevere chest\npain today\n"


def test_token_lines(spark):
    rows = tokens(spark, "a  b\n\n c\n").orderBy("line_no").collect()
    assert [(r["line_no"], r["leading_space"], r["tokens"]) for r in rows] == [
        (0, False, ["a", "b"]), (1, False, []), (2, True, ["c"]),
    ]


@pytest.mark.parametrize("compat,second", [(False, ["I-problem", "O"]), (True, ["I-problem", "O"])])
def test_token_spans(spark, compat, second):
    spans = spark.createDataFrame(
        [
            ("d", 0, 1, 2, 1, 3, "problem", "chest pain"),
            ("d", 1, 2, 2, 2, 3, "problem", "acute distress"),
            ("d", 2, 3, 0, 3, 0, "problem", "fever"),
            ("d", 3, 4, 0, 5, 0, "problem", ""),
        ],
        SPANS,
    )
    got = labels(sp.label_token_spans(tokens(spark, NOTE), spans, compat))
    assert got[0] == ["O", "O", "B-problem", "I-problem", "O"]
    assert got[1] == ["O", "B-problem", "I-problem"]
    assert got[2] == ["B-problem", "O"]
    assert got[3] == (["B-problem", "O"] if compat else ["B-problem", "I-problem"])
    assert got[4] == second
    assert sp.token_span_text_violations(tokens(spark, NOTE), spans).count() == 0


def test_token_spans_three_lines(spark):
    spans = spark.createDataFrame([("d", 0, 1, 1, 3, 1, "t", "")], SPANS)
    text = "a b c\nd e f\ng h i\n"
    assert labels(sp.label_token_spans(tokens(spark, text), spans)) == [
        ["O", "B-t", "I-t"], ["I-t"] * 3, ["I-t", "I-t", "O"],
    ]
    assert labels(sp.label_token_spans(tokens(spark, text), spans, compat=True)) == [
        ["O", "B-t", "O"], ["O", "I-t", "O"], ["O", "I-t", "O"],
    ]


def test_token_spans_later_wins_and_bounds(spark):
    spans = spark.createDataFrame(
        [
            ("d", 0, 1, 0, 1, 2, "a", ""),
            ("d", 1, 1, 1, 1, 1, "b", ""),
            ("d", 2, 1, 3, 1, 99, "c", ""),
            ("d", 3, 7, 0, 7, 0, "x", ""),
        ],
        SPANS,
    )
    got = labels(sp.label_token_spans(tokens(spark, "p q r s t\nu\n"), spans))
    assert got == [["B-a", "B-b", "I-a", "B-c", "I-c"], ["O"]]


def test_token_text_violation(spark):
    spans = spark.createDataFrame([("d", 0, 1, 2, 1, 3, "problem", "chest pains")], SPANS)
    bad = sp.token_span_text_violations(tokens(spark, NOTE), spans)
    assert bad.collect()[0]["observed"] == "chest pain"
    with pytest.raises(ValueError, match="chest pains"):
        sp.check_spans(bad)
    sp.check_spans(bad, match_text=False)


def char_spans(spark, rows):
    return spark.createDataFrame(
        [("d", i, b, e, t, s) for i, (b, e, t, s) in enumerate(rows)],
        "doc_id string, span_idx int, begin int, end int, type string, stated string",
    )


def words(df):
    return [list(zip(r["tokens"], r["labels"])) for r in df.orderBy("line_no").collect()]


def both_ways(spark, text, rows):
    notes = spark.createDataFrame([("d", text)], "doc_id string, text string")
    spans = char_spans(spark, rows)
    lines = sp.line_offsets(notes)
    joined = words(sp.words_from_spans(lines, sp.clip_spans(lines, spans, stretch_bits=3)))
    packed = spans.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("span_idx", "begin", "end", "type", "stated"))).alias("spans")
    )
    inline = words(sp.label_annotated_notes(notes.join(packed, "doc_id", "left")))
    assert joined == inline
    return joined


LINE = "seen by John Smith, MD\n"


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([(8, 18, "DOCTOR", "")], "seen/O by/O John/B-DOCTOR Smith/I-DOCTOR ,/O MD/O"),
        ([], "seen/O by/O John/O Smith,/O MD/O"),
        ([(8, 12, "A", ""), (13, 18, "B", "")], "seen/O by/O John/B-A Smith/B-B ,/O MD/O"),
        ([(8, 18, "A", ""), (13, 18, "B", "")], "seen/O by/O John/B-A Smith/B-B ,/O MD/O"),
        ([(20, 22, "T", "")], "seen/O by/O John/O Smith,/O MD/B-T"),
        ([(0, 4, "X", ""), (4, 7, "X", "")], "seen/B-X by/I-X John/O Smith,/O MD/O"),
    ],
)
def test_char_spans(spark, rows, expected):
    got = both_ways(spark, LINE, rows)
    assert " ".join(f"{w}/{t}" for w, t in got[0]) == expected


def test_char_span_over_lines(spark):
    got = both_ways(spark, "one two\nthree four\n\nfive", [(4, 13, "T", ""), (20, 24, "U", "")])
    assert got == [
        [("one", "O"), ("two", "B-T")],
        [("three", "I-T"), ("four", "O")],
        [("five", "B-U")],
    ]


def test_single_char_at_line_end(spark):
    assert both_ways(spark, "ab c", [(3, 4, "T", "")]) == [[("ab", "O"), ("c", "B-T")]]


def char_reference(text, rows):
    """Straight restatement by characters, for random checks."""
    out, start = [], 0
    marks = [None] * (len(text) + 1)
    for b, e, t in rows:
        for p in range(b, e):
            marks[p] = (t, "B" if p == b else "I")
    for line in text.split("\n"):
        length = len(line) + 1
        chunk_rows, p = [], start
        while p < start + length:
            q = p
            kind = marks[p][0] if p < len(marks) and marks[p] else None
            while q < start + length and (marks[q][0] if q < len(marks) and marks[q] else None) == kind:
                q += 1
            found = (text[p:q]).split()
            for k, w in enumerate(found):
                at = p if k == 0 else (q - 1 if k == len(found) - 1 else p + 1)
                chunk_rows.append((w, "O" if kind is None else f"{marks[at][1]}-{kind}"))
            p = q
        if chunk_rows:
            out.append(chunk_rows)
        start += length
    return out


def test_char_spans_against_characters(spark):
    import random

    rng = random.Random(7)
    texts, spans = [], []
    for doc in range(60):
        text = "".join(rng.choice("ab  \n") for _ in range(rng.randint(1, 60)))
        texts.append((doc, text))
        for i in range(rng.randint(0, 5)):
            b = rng.randrange(len(text))
            spans.append((doc, i, b, min(len(text), b + rng.randint(1, 20)), rng.choice("XY"), ""))
    notes = spark.createDataFrame(texts, "doc_id int, text string")
    table = spark.createDataFrame(
        spans, "doc_id int, span_idx int, begin int, end int, type string, stated string"
    )
    lines = sp.line_offsets(notes)
    by_join = sp.words_from_spans(lines, sp.clip_spans(lines, table, stretch_bits=3))
    packed = table.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("span_idx", "begin", "end", "type", "stated"))).alias("spans")
    )
    in_row = sp.label_annotated_notes(notes.join(packed, "doc_id", "left"))
    for result in (by_join, in_row):
        got = {}
        for r in result.orderBy("doc_id", "line_no").collect():
            got.setdefault(r["doc_id"], []).append(list(zip(r["tokens"], r["labels"])))
        for doc, text in texts:
            rows = [(s[2], s[3], s[4]) for s in spans if s[0] == doc]
            assert got.get(doc, []) == char_reference(text, rows), (text, rows)


def test_locate_and_text_check(spark):
    text = "one two\nthree  four\n"
    notes = spark.createDataFrame([("d", text)], "doc_id string, text string")
    good = char_spans(spark, [(4, 13, "T", "two three"), (8, 19, "T", "three four")])
    assert sp.span_text_violations(notes, good).count() == 0
    bad = char_spans(spark, [(4, 13, "T", "two tree")])
    assert sp.span_text_violations(notes, bad).collect()[0]["observed"] == "two three"
    place = sp.locate_offsets(sp.line_offsets(notes), good).orderBy("span_idx").collect()
    assert tuple(place[0])[2:] == (0, 4, 1, 4)


def test_line_offsets_long_note(spark):
    lines = ["x" * (i % 7) for i in range(1500)]
    notes = spark.createDataFrame([("d", "\n".join(lines))], "doc_id string, text string")
    rows = sp.line_offsets(notes).orderBy("line_no").collect()
    at = 0
    for row, line in zip(rows, lines):
        assert (row["line_start"], row["line"]) == (at, line)
        at += len(line) + 1
    assert len(rows) == 1500


def test_corrections(spark):
    lines = spark.createDataFrame(
        [("a", 0, "0808 Main Effingham"), ("a", 1, "other"), ("b", 0, "0808 Effingham")],
        "doc_id string, line_no int, line string",
    )
    fixed = sp.apply_line_corrections(lines, [("a", "Effingham", 9, "    ")])
    assert {(r[0], r[1]): r[2] for r in fixed.collect()} == {
        ("a", 0): "0808 Main     Effingham", ("a", 1): "other", ("b", 0): "0808 Effingham",
    }
    spans = spark.createDataFrame([("a", "x and y"), ("b", "x and y")], "doc_id string, stated string")
    done = sp.apply_span_corrections(spans, [("a", "x and y", "x & y")]).collect()
    assert {(r[0], r[1]) for r in done} == {("a", "x & y"), ("b", "x and y")}


XML = """<?xml version="1.0" encoding="UTF-8" ?>
<ClinicalNarrativeTemporalAnnotation>
<TEXT><![CDATA[
Admission : pain & fever
He's well .
]]></TEXT>
<TAGS>
<EVENT id="E0" start="13" end="17" text="pain" type="PROBLEM" />
<EVENT id="E1" start="13" end="25" text="pain & fever" type="  " />
<EVENT id="E2" start="26" end="30" text="He&apos;s" type="OCC" />
<TIMEX3 id="T0" start="1" end="10" text="Admission" type="DATE" />
</TAGS>
</ClinicalNarrativeTemporalAnnotation>
"""


def test_span_xml(spark, tmp_path):
    (tmp_path / "12.xml").write_text(XML)
    notes = rd.read_span_xml(spark, str(tmp_path), tags="EVENT")
    row = notes.collect()[0]
    assert row["doc_id"] == "12"
    assert row["text"].startswith("\nAdmission")
    assert [s["type"].strip() for s in row["spans"]] == ["PROBLEM", "", "OCC"]
    assert row["spans"][1]["stated"] == "pain & fever"
    flat = rd.stand_off(notes)
    assert sp.span_text_violations(notes, flat).count() == 0
    typed = sp.drop_blank_type(flat)
    lines = sp.line_offsets(notes.select("doc_id", "text"))
    got = words(sp.words_from_spans(lines, sp.clip_spans(lines, typed)))
    assert got[0] == [("Admission", "O"), (":", "O"), ("pain", "B-PROBLEM"), ("&", "O"), ("fever", "O")]
    assert got[1][0] == ("He's", "B-OCC")
    every = rd.read_span_xml(spark, str(tmp_path), tags="*").collect()[0]
    assert len(every["spans"]) == 4


def test_many_copies_of_one_span(spark):
    text = "one two three\nfour"
    notes = spark.createDataFrame([("d", text), ("e", text)], "doc_id string, text string")
    copies = spark.range(20000).select(
        F.lit("d").alias("doc_id"), F.col("id").alias("span_idx"), F.lit(4).alias("begin"), F.lit(13).alias("end"),
        F.when(F.col("id") == 19999, "LAST").otherwise("X").alias("type"), F.lit("").alias("stated"),
    )
    assert sp.last_spans(copies).count() == 2
    got = {(r["doc_id"], r["line_no"]): r["labels"] for r in sp.label_char_spans(notes, copies).collect()}
    assert got == {
        ("d", 0): ["O", "B-LAST", "I-LAST"], ("d", 1): ["O"], ("e", 0): ["O", "O", "O"], ("e", 1): ["O"],
    }
    attached = sp.attach_spans(notes.select("doc_id"), copies)
    assert attached.filter("doc_id = 'd'").count() == 20000
    assert attached.filter("doc_id = 'e' and span_idx is null").count() == 1
    on_tokens = copies.select(
        "doc_id", "span_idx", F.lit(1).alias("start_line"), F.lit(1).alias("start_pos"),
        F.lit(1).alias("end_line"), F.lit(2).alias("end_pos"), "type", "stated",
    )
    got = labels(sp.label_token_spans(sp.token_lines(notes), on_tokens))
    assert got == [["O", "B-LAST", "I-LAST"], ["O"], ["O", "O", "O"], ["O"]]


def _brute_labels(text, spans):
    """Character by character: the latest span over a character is its type; words end where the type changes."""
    out, start = [], 0
    for line_no, line in enumerate(text.split("\n")):
        stop = start + len(line) + 1
        clips = [(i, max(b, start) - start, min(e, stop) - start, b >= start, t) for i, b, e, t in spans if b < stop and e > start]
        kinds, opens = [], []
        for at in range(len(line) + 1):
            over = [c for c in clips if c[1] <= at < c[2]]
            won = max(over) if over else None
            kinds.append(won[4] if won else None)
            opens.append(bool(won) and won[3] and won[1] == at)
        words, at = [], 0
        while at <= len(line):
            until = at
            while until <= len(line) and kinds[until] == kinds[at]:
                until += 1
            found = line[at:until].split()
            for k, word in enumerate(found):
                place = at if k == 0 else until - 1 if k == len(found) - 1 else at + 1
                words.append((word, "O" if kinds[at] is None else ("B-" if opens[place] else "I-") + kinds[at]))
            at = until
        if line.strip():
            out.append((line_no, [w for w, _ in words], [x for _, x in words]))
        start = stop
    return out


def test_overlapping_spans_against_brute_force(spark):
    import random

    rng = random.Random(11)
    notes, flat = [], []
    for d in range(40):
        text = "".join(rng.choices("ab cd\n", k=rng.randrange(0, 60)))
        spans = []
        for i in range(rng.randrange(0, 9)):
            b = rng.randrange(0, len(text) + 1)
            spans.append((i, b, min(len(text), b + rng.randrange(0, 25)), rng.choice("XYZ")))
        notes.append((f"d{d}", text, [(i, b, e, t, "") for i, b, e, t in spans]))
        flat += [(f"d{d}", *s) for s in spans if s[2] > s[1]]
    schema = "doc_id string, text string, spans array<struct<span_idx:int,begin:int,end:int,type:string,stated:string>>"
    frame = spark.createDataFrame(notes, schema)
    want = sorted(
        (d, *row) for d, text, spans in notes for row in _brute_labels(text, [s[:4] for s in spans if s[2] > s[1]])
    )
    rows = sp.label_annotated_notes(frame).collect()
    assert sorted((r["doc_id"], r["line_no"], r["tokens"], r["labels"]) for r in rows) == want
    apart = spark.createDataFrame(flat, "doc_id string, span_idx int, begin int, end int, type string")
    rows = sp.label_char_spans(frame.select("doc_id", "text"), apart).collect()
    assert sorted((r["doc_id"], r["line_no"], r["tokens"], r["labels"]) for r in rows) == want


def test_tokens_travel_as_text_and_come_back_as_they_were(spark):
    """Also null tokens, empty ones, ones with the mark, lines without tokens and without a list of them."""
    m = sp._MARK
    lists = [["a", "b c", "", "é"], [], None, [None], [None, f"x{m}y"], [f"{m}"], ["", ""], [""], ["a", None, "b"], [f"{m}a", "b"]]
    rows = [("d", i, False, t) for i, t in enumerate(lists)]
    lines = spark.createDataFrame(rows, "doc_id string, line_no int, leading_space boolean, tokens array<string>")
    none = spark.createDataFrame([], "doc_id string, span_idx int, start_line int, start_pos int, end_line int, end_pos int, type string")
    got = sp.label_token_spans(lines, none)
    assert got.columns == [*lines.columns, "labels"]
    by = {r["line_no"]: (r["tokens"], r["labels"]) for r in got.collect()}
    assert {i: t for i, (t, _) in by.items()} == dict(enumerate(lists))
    assert all(labels == ["O"] * len(t) for t, labels in by.values() if t is not None)
    held = {r["line_no"] for r in sp._joined_tokens(lines).filter("tokens IS NULL AND __joined IS NOT NULL").collect()}
    assert held == {0, 6, 7}
