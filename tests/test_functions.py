"""Text, array and naming expressions."""

import math

import pytest
from pyspark.sql import functions as F

from notemill.functions import arrays, naming
from notemill.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value", ["", " ", "a", " a  b ", "\t a\x0bb  c\x1c", "a \t b", "x 　 y  z", "  lead", "a b c"]
)
def test_whitespace_like_python(spark, value):
    assert one(spark, tx.strip(F.col("v")), v=value) == value.strip()
    assert one(spark, tx.rstrip(F.col("v")), v=value) == value.rstrip()
    assert one(spark, tx.ws_split(F.col("v")), v=value) == value.split()
    assert one(spark, tx.collapse_ws(F.col("v")), v=value) == " ".join(value.split())
    expected = [t for t in value.strip().split(" ") if t.strip() != ""]
    assert one(spark, tx.nonblank_tokens(F.col("v")), v=value) == expected


def test_nonblank_tokens_random(spark):
    import random

    rng = random.Random(3)
    values = ["".join(rng.choice("ab  \t ") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for row in df.select("v", tx.nonblank_tokens(F.col("v")).alias("t")).collect():
        assert row["t"] == [t for t in row["v"].strip().split(" ") if t.strip() != ""], repr(row["v"])


def test_text_lines(spark):
    assert one(spark, tx.text_lines(F.col("v")), v="a\n\nb\n") == ["a", "", "b"]
    assert one(spark, tx.text_lines(F.col("v")), v="a\nb") == ["a", "b"]
    assert one(spark, tx.text_lines(F.col("v")), v="") == []


def test_word_pieces(spark):
    assert one(spark, tx.word_pieces(F.col("v")), v="Él's 3.5 mg") == ["Él", "'", "s", "3", ".", "5", "mg"]


def test_unescape_one_sided(spark):
    assert one(spark, tx.unescape_for(F.col("o"), F.col("s")), o="He&apos;s", s="He's") == "He&apos;s"
    assert one(spark, tx.unescape_for(F.col("o"), F.col("s")), o="He's", s="He's") == "He's"
    assert one(spark, tx.unescape_for(F.col("o"), F.col("s")), o="a &quot;b&quot;", s='a "b"') == "a &quot;b&quot;"


def test_softmax_argmax(spark):
    p = one(spark, arrays.softmax(F.col("v")), v=[0.1, 2.0, 1.0])
    assert [round(x, 5) for x in p] == [0.09857, 0.659, 0.24243]
    assert one(spark, arrays.argmax(F.col("v")), v=[0.1, 2.0, 1.0]) == 1
    assert one(spark, arrays.argmax(F.col("v")), v=[1.0, 1.0]) == 0
    assert math.isclose(sum(one(spark, arrays.softmax(F.col("v")), v=[800.0, 801.0])), 1.0)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_starts(spark, n):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda i: i % 7).cast("array<int>").alias("v"))
    df = df.select((F.col("v") if n else F.array().cast("array<int>")).alias("v"))
    row = df.select("v", arrays.running_starts(F.col("v")).alias("s")).first()
    total, expected = 0, []
    for x in row["v"]:
        expected.append(total)
        total += x
    assert row["s"] == expected


@pytest.mark.parametrize(
    "tags,expected",
    [
        ("O B-p I-p O", [(1, 2, "p")]),
        ("I-p O", [(0, 0, "p")]),
        ("B-p B-p", [(0, 0, "p"), (1, 1, "p")]),
        ("B-p I-q I-q O I-q", [(0, 0, "p"), (1, 2, "q"), (4, 4, "q")]),
        ("O O", []),
        ("B-a-b I-a-b", [(0, 1, "a-b")]),
    ],
)
def test_entity_chunks(spark, tags, expected):
    got = one(spark, arrays.entity_chunks(F.split(F.lit(tags), " ")))
    assert [tuple(c) for c in got] == expected


def test_entity_chunks_empty(spark):
    assert one(spark, arrays.entity_chunks(F.array().cast("array<string>"))) == []


def test_drop_masked_and_pad(spark):
    got = one(spark, arrays.drop_masked(F.col("p"), F.col("g")), p=[1, 2, 3], g=[-100, 0, 5])
    assert [tuple(x) for x in got] == [(2, 0), (3, 5)]
    assert one(spark, arrays.pad_to(F.col("v"), F.lit(4), 0), v=[7, 8]) == [7, 8, 0, 0]


@pytest.mark.parametrize(
    "path,name",
    [
        ("org/model-base", "model-base"),
        ("roberta-base", "roberta-base"),
        ("/1/2/saved_models/4/5/6/name/8/declutr/", "name/declutr/8"),
        ("/1/2/saved_models/declutr/5/6/7/few_epoch-8/9/10/", "few_epoch-8_declutr_9"),
        ("/1/2/saved_models/declutr/5/few_epoch/span_comparison/8/nine/10/11/", "nine/declutr/10"),
        ("/1/2/3/saved_models/simcse/6/7/8", "simcse-mimic"),
        ("/1/2/3/saved_models/5/6/contrastive7/8", "contrastive7"),
        ("/1/2/3/saved_models/5/6/seven/8", "seven"),
    ],
)
def test_model_short_name(spark, path, name):
    assert one(spark, naming.model_short_name(F.col("v")), v=path) == name


def test_run_path(spark):
    df = spark.createDataFrame([("t", None, "m", "LORA"), ("t", 64, "m", "LORA")], "t string, n int, m string, p string")
    ts = F.to_timestamp(F.lit("2024-03-05 07:08:09"))
    got = [r[0] for r in df.select(naming.run_path("logs", F.col("t"), F.col("n"), F.col("m"), F.col("p"), ts)).collect()]
    assert got == ["logs/t/full/m/LORA/05-03-2024--07-08/", "logs/t/fewshot_64/m/LORA/05-03-2024--07-08/"]


def test_arithmetic(spark):
    assert one(spark, naming.warmup_steps(F.lit(1000), 32, 8)) == 9.375
    assert one(spark, naming.scaled_int(F.lit(8), F.lit(0.3))) == 2
    assert one(spark, naming.scaled_int(F.lit(5), F.lit(0.5))) == 2
    start, end = F.to_timestamp(F.lit("2024-01-01")), F.to_timestamp(F.lit("2024-01-02 00:00:05"))
    assert one(spark, naming.elapsed_seconds(end, start)) == 86405
