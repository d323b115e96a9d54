"""Flows check their rows in the jobs that write them."""

import pytest
from pyspark.sql import functions as F

from notemill.operators import spans as sp
from notemill.plans import flows
from notemill.sources import readers as rd
from notemill.sources import writers as wr


def _counted(spark, df):
    """The rows, and an accumulator of how many of them were ever computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


def test_dataset_reads_its_input_once(spark, tmp_path):
    rows = [(s, [f"w{i}", "x"], ["B-p", "O" if i % 3 else "I-p"]) for i in range(90) for s in ("train", "test", "extra")]
    df, seen = _counted(spark, spark.createDataFrame(rows, "split string, tokens array<string>, labels array<string>"))
    path = str(tmp_path / "ds")
    flows.build_ner_dataset(df, path)
    assert seen.value == len(rows)
    assert rd.read_dataset(spark, path).count() == len(rows)


def test_dataset_checks(spark, tmp_path):
    schema = "split string, tokens array<string>, labels array<string>"
    uneven = spark.createDataFrame([("train", ["a", "b"], ["O"])], schema)
    with pytest.raises(ValueError, match="other numbers"):
        flows.build_ner_dataset(uneven, str(tmp_path / "uneven"))
    flows.build_ner_dataset(spark.createDataFrame([], schema), str(tmp_path / "empty"), verify=False)
    good = spark.createDataFrame([("train", ["a"], ["O"]), ("other", ["b"], ["O"])], schema)
    path = str(tmp_path / "good")
    seen = wr.write_dataset(good, path, facts={"tokens": F.sum(F.size("tokens"))})
    assert seen == {"rows": 2, "train": 1, "validation": 0, "test": 0, "tokens": 2}
    assert wr.verify_written(spark, path, seen, good) == {}
    good.filter("split = 'other'").write.mode("append").partitionBy("split").parquet(f"{path}/data")
    assert wr.verify_written(spark, path, seen, good) == {"all": (3, 2)}


def _xml(body, tags):
    return f"<r><TEXT><![CDATA[{body}]]></TEXT><TAGS>{tags}</TAGS></r>"


def test_xml_notes_are_parsed_once(spark):
    tag = '<EVENT id="E0" start="0" end="4" text="pain" type="PROBLEM"/>'
    files = spark.createDataFrame([(f"d{i}", _xml("pain here", tag)) for i in range(20)], "doc_id string, text string")
    counted, seen = _counted(spark, files)
    rows = flows.label_xml_notes(rd.parse_span_xml(counted, tags="EVENT"))
    assert {tuple(r["labels"]) for r in rows.collect()} == {("B-PROBLEM", "O")} and seen.value == 20
    wrong = files.withColumn("text", F.replace("text", F.lit('text="pain"'), F.lit('text="ache"')))
    with pytest.raises(ValueError, match="does not match.*ache"):
        flows.label_xml_notes(rd.parse_span_xml(wrong, tags="EVENT"))
    assert flows.label_xml_notes(rd.parse_span_xml(wrong, tags="EVENT"), match_text=False).count() == 20
    broken = files.withColumn("text", F.replace("text", F.lit('start="0"'), F.lit('start="x"')))
    with pytest.raises(ValueError, match="cannot be read"):
        flows.label_xml_notes(rd.parse_span_xml(broken, tags="EVENT"))


def test_stated_texts_inside_the_row_as_by_joins(spark):
    text = 'a  b\nc &apos;d&apos; e'
    found = [(0, 0, 4, "a b"), (1, 3, 6, "b c"), (2, 7, 20, "'d'"), (3, 0, 1, "x"), (4, 2, 2, ""), (5, 90, 95, "q"), (6, 0, 1, None)]
    spans = [(i, b, e, "T", s) for i, b, e, s in found]
    notes = spark.createDataFrame(
        [(1, text, spans), (2, None, spans), (3, "a", None)],
        "doc_id int, text string, spans array<struct<span_idx:int,begin:int,end:int,type:string,stated:string>>",
    )
    whole = notes.filter("text IS NOT NULL")
    by_join = sp.span_text_violations(whole.select("doc_id", "text"), rd.stand_off(whole)).orderBy("span_idx").collect()
    in_row = {r["doc_id"]: r["x"] for r in notes.select("doc_id", sp.stated_text_check()("text", "spans").alias("x")).collect()}
    assert in_row[1]["n"] == len(by_join) and in_row[2]["n"] == in_row[3]["n"] == 0
    assert (in_row[1]["span_idx"], in_row[1]["observed"], in_row[1]["expected"]) == tuple(by_join[0])[1:]
