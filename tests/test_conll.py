"""CoNLL text, notes and concepts on disk; vocabularies; length splits."""

import pytest
from pyspark.sql import functions as F

from notemill.operators import conll, sampling, spans
from notemill.plans import flows
from notemill.sources import readers as rd
from notemill.sources import writers as wr


def sentences(df):
    return [r["tokens"] for r in df.orderBy("file", "block", "sent_id").collect()]


@pytest.mark.parametrize(
    "text,ours,compat",
    [
        ("a O\n\nb B-x\nc I-x", [["a"], ["b", "c"]], [["a"]]),
        ("a O\n\n\nb O\n\n", [["a"], ["b"]], [["a"], [], ["b"]]),
        ("a O\n \t\nb O\n\nc O\n", [["a"], ["b"], ["c"]], [["a"], ["b"]]),
        ("\n\na O\n\n", [["a"]], [[], [], ["a"]]),
    ],
)
def test_read_conll(spark, tmp_path, text, ours, compat):
    (tmp_path / "train.txt").write_text(text)
    paths = {"train": str(tmp_path / "train.txt")}
    assert sentences(rd.read_conll(spark, paths)) == ours
    assert sentences(rd.read_conll(spark, paths, compat=True)) == compat


def test_read_conll_fields(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a O extra\nb\tc B-x\r\n\r\n")
    row = rd.read_conll(spark, {"train": str(tmp_path / "t.txt")}, newline="\r\n").collect()[0]
    assert (row["tokens"], row["ner_tags_str"], row["split"]) == (["a", "b\tc"], ["O", "B-x"], "train")


def test_large_file_in_parts(spark, tmp_path):
    rows = [f"w{i} O\nx{i} B-t" for i in range(5000)]
    (tmp_path / "big.txt").write_text("\n\n".join(rows) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = rd.read_conll(spark, {"train": str(tmp_path / "big.txt")})
        assert back.select(F.spark_partition_id()).distinct().count() > 3
        assert sentences(back) == [[f"w{i}", f"x{i}"] for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_compat_sentences_across_ranges(spark, tmp_path, seed):
    import random

    rng = random.Random(seed)
    for name in ("a", "b"):
        lines = [rng.choice(["", " ", f"w{k} O", f"w{k} O", "long" * 50 + f"{k} B-x"]) for k in range(600)] + [f"x{k} O" for k in range(200)] + rng.choice([[""], []])
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name in ("a", "b"):
            want, held = [], []
            for line in (tmp_path / f"{name}.txt").read_text().split("\n")[:-1]:
                if line.strip():
                    held.append(line.split(" ")[0])
                else:
                    want.append(held)
                    held = []
            back = rd.read_conll(spark, str(tmp_path / f"{name}.txt"), compat=True)
            assert back.select(F.spark_partition_id()).distinct().count() > 3
            assert sentences(back) == want
        both = rd.read_conll(spark, str(tmp_path), compat=True)
        assert both.count() == sum(rd.read_conll(spark, str(tmp_path / f"{n}.txt"), compat=True).count() for n in "ab")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("n", [3, 100_000])
def test_tags_to_ids_and_back(spark, n):
    tags = ["O", *[f"B-{k:06d}" for k in range(n - 1)]]
    rows = [(1, ["O", tags[-1], "B-none"]), (2, []), (3, None), (4, [tags[1], None])]
    df = spark.createDataFrame(rows, "k int, labels array<string>")
    coded = conll.decode_tags(conll.encode_tags(df, tags), tags, "ner_tags", "back")
    got = {r["k"]: (r["ner_tags"], r["back"]) for r in coded.collect()}
    assert got == {1: ([0, n - 1, None], ["O", tags[-1], None]), 2: ([], []), 3: (None, None), 4: ([1, None], [tags[1], None])}


def test_conll_round_trip(spark, tmp_path):
    rows = [(i, "train" if i % 3 else "test", [f"t{i}", "Ä,"], ["B-x", "I-x"]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, split string, tokens array<string>, labels array<string>")
    wr.write_conll(df, str(tmp_path / "out"), order=["id"])
    back = rd.read_conll(spark, str(tmp_path / "out"))
    got = sorted((r["split"], r["tokens"][0], tuple(r["ner_tags_str"])) for r in back.collect())
    assert got == sorted((r[1], r[2][0], ("B-x", "I-x")) for r in rows)
    assert rd.read_conll(spark, str(tmp_path / "out"), compat=True).count() == 40


CON = 'c="chest pain" 1:2 1:3||t="problem"\nc="Fever" 2:0 2:0||t="problem"\nbroken line\n'


def test_notes_and_concepts(spark, tmp_path):
    (tmp_path / "txt").mkdir()
    (tmp_path / "con").mkdir()
    (tmp_path / "txt" / "r-1.txt").write_text("Patient has chest pain .\r\nFever today\r\n")
    (tmp_path / "txt" / "ignored.md").write_text("x")
    (tmp_path / "con" / "r-1.con").write_text(CON)
    notes = rd.read_token_notes(spark, str(tmp_path / "txt"))
    concepts = rd.read_concepts(spark, str(tmp_path / "con"))
    rows = concepts.orderBy("span_idx").collect()
    assert [tuple(r) for r in rows] == [
        ("r-1", 0, 1, 2, 1, 3, "problem", "chest pain"),
        ("r-1", 1, 2, 0, 2, 0, "problem", "Fever"),
        ("r-1", 2, None, None, None, None, None, None),
    ]
    good = concepts.filter(F.col("type").isNotNull()).withColumn("stated", F.lower("stated"))
    done = flows.label_notes(notes, good).orderBy("line_no").collect()
    assert done[0]["labels"] == ["O", "O", "B-problem", "I-problem", "O"]
    assert done[1]["labels"] == ["B-problem", "O"]
    with pytest.raises(ValueError, match="does not match"):
        flows.label_notes(notes, good.withColumn("stated", F.lit("nope")))
    with pytest.raises(ValueError, match="without a note"):
        flows.label_notes(notes, good.withColumn("doc_id", F.lit("other")))


def test_golden_concept(spark):
    files = spark.createDataFrame([("d", 'c="asymptomatic" 16:2 16:2||t="problem"\n')], "doc_id string, text string")
    row = rd.parse_concepts(files).collect()[0]
    assert (row["type"], row["start_line"], row["start_pos"], row["end_line"], row["end_pos"], row["stated"]) == (
        "problem", 16, 2, 16, 2, "asymptomatic",
    )


def lab(spark, *rows):
    return spark.createDataFrame([(list(r),) for r in rows], "labels array<string>")


def test_vocabularies(spark):
    df = lab(spark, ["O", "I-b", "B-a"], ["B-b"])
    tags = conll.tag_vocab(df)
    assert conll.tag_list(tags) == ["O", "B-a", "B-b", "I-b"]
    assert conll.tag_count(tags).first()["n_tags"] == 4
    coded = conll.encode_tags(lab(spark, ["I-b", "O", "B-zzz"]), conll.tag_list(tags))
    assert coded.first()["ner_tags"] == [3, 0, None]
    assert conll.decode_tags(coded, conll.tag_list(tags), "ner_tags", "n").first()["n"] == ["I-b", "O", None]
    assert [tuple(r) for r in conll.unseen_labels(lab(spark, ["B-q", "B-q", "O"]), tags).collect()] == [("B-q", 2)]
    spans_df = spark.createDataFrame([("x",), ("y",), ("x",)], "type string")
    assert sorted(r[0] for r in conll.label_vocab(spans_df).collect()) == ["B-x", "B-y", "I-x", "I-y", "O"]
    bad = conll.label_format_violations(lab(spark, ["O", "S-x", "B-y", "o", "I-"]))
    assert sorted(tuple(r) for r in bad.collect()) == [("S-x", 1), ("o", 1)]


def test_length_split(spark):
    df = spark.createDataFrame(
        [(list("abcde"), [3, 3, 2, 4, 1]), (list("xyz"), [9, 0, 2]), (["q"], [0])],
        "tokens array<string>, n array<int>",
    )
    rows = conll.split_long_sentences(df, "n", ["tokens"], max_len=6).orderBy("n").collect()
    assert sorted("".join(r["tokens"]) for r in rows) == ["ab", "cde", "xz"]


def test_sentence_ids(spark):
    lines = spark.createDataFrame(
        [("f", 0, "a"), ("f", 1, " "), ("f", 2, "b"), ("f", 3, ""), ("f", 4, ""), ("f", 70000, "c"), ("g", 0, "z")],
        "file string, line int, text string",
    )
    got = {(r["file"], r["line"]): r["sent_id"] for r in conll.sentence_ids(lines, "file", "line", "text").collect()}
    assert got == {("f", 0): 0, ("f", 1): 0, ("f", 2): 1, ("f", 3): 1, ("f", 4): 2, ("f", 70000): 3, ("g", 0): 0}


def test_dataset(spark, tmp_path):
    df = spark.createDataFrame(
        [("train", ["a", "b"], ["B-x", "O"]), ("test", ["c"], ["I-y"])],
        "split string, tokens array<string>, labels array<string>",
    )
    path = str(tmp_path / "ds")
    flows.build_ner_dataset(df, path)
    rows = {r["split"]: r for r in rd.read_dataset(spark, path).collect()}
    assert rows["train"]["ner_tags"] == [1, 0] and rows["test"]["ner_tags"] == [2]
    assert rows["test"]["ner_tags_str"] == ["I-y"]
    assert conll.tag_list(rd.read_tags(spark, path)) == ["O", "B-x", "I-y"]
    more = rd.read_dataset(spark, path)
    assert wr.verify_dataset(spark, path, more.unionAll(more.filter(F.col("split") == "test"))).collect()[0]["stored"] == 1
    with pytest.raises(ValueError, match="schema"):
        wr.verify_dataset(spark, path, more.drop("tokens"))
    wr.write_label_vocab(rd.read_tags(spark, path), str(tmp_path / "v"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "v")).collect()] == ["O", "B-x", "I-y"]


def test_csv_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"line one\nline ""two""",1\nplain,0\n')
    (tmp_path / "b.csv").write_text("text,label,extra\nx,1,e\n")
    df = rd.read_csv_splits(
        spark,
        {"train": str(tmp_path / "a.csv"), "validation": str(tmp_path / "b.csv")},
        {"train": "text string, label int", "validation": "text string, label int, extra string"},
    )
    rows = {(r["split"], r["text"], r["label"], r["extra"]) for r in df.collect()}
    assert rows == {
        ("train", 'line one\nline "two"', 1, None), ("train", "plain", 0, None), ("validation", "x", 1, "e"),
    }


def test_attach_keeps_notes_without_spans(spark):
    notes = spark.createDataFrame([("a", "t"), ("b", "t")], "doc_id string, text string")
    sp = spark.createDataFrame([("a", 0)], "doc_id string, span_idx int")
    assert spans.attach_spans(notes, sp).count() == 2
    odd = sampling.id_set_mismatch(notes, sp, "doc_id").collect()
    assert [tuple(r) for r in odd] == [("b", "left")]


def test_patient_of(spark):
    row = spark.range(1).select(rd.patient_of(F.lit("0012")), rd.patient_of(F.lit("180-03"), 3)).first()
    assert tuple(row) == (12, 180)
    name = spark.range(1).select(rd.doc_id_from_name(F.lit("r-1.con"), ".con"), rd.doc_id_from_name(F.lit("x.md"), ".con"))
    assert tuple(name.first()) == ("r-1", None)


def test_files_dealt_over_folders(spark, tmp_path):
    from notemill.sources import writers

    notes = spark.createDataFrame([(f"n{i}", f"a b{i}\n" if i else None) for i in range(40)], "doc_id string, text string")
    assert writers.folders_for(20_000) == 0 and writers.folders_for(20_001) == 3
    path = str(tmp_path / "many")
    assert writers.write_files(notes, path, ".txt", folders=4) == 40
    assert writers.write_files(notes.limit(3), path, ".con", folders=4) == 3
    assert sorted(p.name for p in (tmp_path / "many").iterdir()) == ["000000", "000001", "000002", "000003"]
    (tmp_path / "many" / "_old").mkdir()
    (tmp_path / "many" / "_old" / "gone.txt").write_text("x")
    read = {r["doc_id"]: r["tokens"] for r in rd.read_token_notes(spark, path).collect()}
    assert read == {f"n{i}": ["a", f"b{i}"] for i in range(1, 40)}


def test_compat_lines_in_small_batches(spark, tmp_path):
    """Sentences over the borders of batches, kept as one; empty ones stay and the open last one goes."""
    (tmp_path / "f.txt").write_text("a O\nb O\n\n \u2003\nc O\n\n\nd O")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        rows = rd.read_conll(spark, {"train": str(tmp_path / "f.txt")}, compat=True).orderBy("sent_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r["tokens"] for r in rows] == [["a", "b"], [], ["c"], []]


def test_tasks_list_and_read_the_files_of_subfolders(spark, tmp_path, monkeypatch):
    """The driver's reader of files is not asked, and the rows are those that it would give."""
    odd = {"a b": "x\r\ny", "p%20q": "\ufeffz", "_k=v": "l", "_gone": "x", ".gone": "x", "é\u00a0#[]~": "Ä\n", "empty": "", "_metadata": "m"}
    for k, (name, text) in enumerate(odd.items()):
        (tmp_path / f"{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"{k % 3}" / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "0" / "folder.txt").mkdir()
    (tmp_path / "1" / "other.con").write_text("c")
    (tmp_path / "2" / "broken.txt").write_bytes(b"a\xffb")
    raw = lambda df: sorted((r["doc_id"], bytes(r["t"])) for r in df.select("doc_id", F.col("text").cast("binary").alias("t")).collect())
    staged = raw(rd._staged(spark, rd._subfolders(spark, str(tmp_path)), ".txt"))

    def refused(*_):
        raise AssertionError("files listed by the driver")

    monkeypatch.setattr(rd, "_by_spark", refused)
    monkeypatch.setattr(rd, "_HANDED_ON", 2)
    assert raw(rd._whole_files(spark, str(tmp_path), ".txt")) == staged
    assert len(staged) == 5


def test_sentences_are_ordered_as_text(spark, tmp_path, monkeypatch):
    """Neither tokens nor labels are moved to be ordered; an order by columns named as the writer's own holds."""
    rows = [(s, f"v{i:03d}", [f"t{i}"], ["O"]) for i in range(30, 0, -1) for s in ("test", "train")]
    df = spark.createDataFrame(rows, "split string, value string, tokens array<string>, labels array<string>")
    moved, deal = [], type(df).repartitionByRange

    def seen(self, *cols):
        moved.append(self.dtypes)
        return deal(self, *cols)

    monkeypatch.setattr(type(df), "repartitionByRange", seen)
    wr.write_conll(df, str(tmp_path / "out"), order=["value", "split"])
    assert [kind for _, kind in moved[0]].count("array<string>") == 0
    back = [r["tokens"][0] for r in rd.read_conll(spark, str(tmp_path / "out")).filter("split = 'test'").orderBy("file", "block", "sent_id").collect()]
    assert back == [f"t{i}" for i in range(1, 31)]


def test_compat_query_has_the_lines_without_words(spark, tmp_path):
    import compare
    import duckdb
    from notemill.plans.oracles import ORACLES
    from notemill.plans.queries import QUERIES

    texts = ["Ann Lee wrote.\n\nCall 12345 now\n", "\n\nx@y.com\n \nBob ends.\nPat", None, "", "plain"]
    rows = [(i, f"s{i}", "en", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["conll_compat"]).fetchdf()
    assert (want["tokens"] == "").sum() == 8
    assert not compare.difference(QUERIES["conll_compat"](spark, str(tmp_path)).toPandas(), want)
