import csv
import random

import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from notemill.sources import csvparts, readers

SCHEMA = StructType([StructField("id", IntegerType()), StructField("text", StringType()), StructField("note", StringType())])


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, rows, newline="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=newline)
        out.writerow(["id", "text", "note"])
        out.writerows(rows)


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["word", '"', '""', "\n", ",", "é", "𝔘", "\n\n", "long " * 60, " ", "'", "\\"]
    return [(k, "".join(rng.choices(parts, k=rng.randint(1, 9))), "x" if k % 3 else 'end"\n') for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_one_file_in_many_ranges(spark, tmp_path, small_ranges, seed):
    rows = texts(seed, 120) + [(999, "\n".join(f'line "{k}"' for k in range(400)), "spans several ranges")]
    write(tmp_path / "a.csv", rows)
    read = csvparts.read(spark, str(tmp_path), SCHEMA)
    assert csvparts._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 5
    assert sorted(tuple(r) for r in read.collect()) == sorted(rows)


def test_several_files_and_carriage_returns(spark, tmp_path, small_ranges):
    a, b = texts(7, 40), [(1000 + k, t, n) for k, t, n in texts(8, 40)]
    write(tmp_path / "a.csv", a, "\r\n")
    write(tmp_path / "b.csv", b)
    read = readers.read_csv_splits(spark, {"train": str(tmp_path)}, SCHEMA)
    assert sorted((r["id"], r["text"], r["note"]) for r in read.collect()) == sorted(a + b)


def test_as_the_plain_reader_on_empty_and_blank_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,note\n1,,""\n\n2,"", \n3,"a\n\nb",x\n4,"never closed\nto the end')
    plain = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    got = csvparts.read(spark, str(tmp_path), SCHEMA)
    key = lambda r: r["id"]
    assert sorted(got.collect(), key=key)[:3] == sorted(plain.collect(), key=key)[:3]


def test_other_columns_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note,text\n1,a,b\n")
    with pytest.raises(Exception, match="has the columns"):
        csvparts.read(spark, str(tmp_path), SCHEMA).collect()


def test_header_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text,note\n")
    assert csvparts.read(spark, str(tmp_path), SCHEMA).collect() == []
