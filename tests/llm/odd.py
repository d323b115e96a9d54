"""Rows that every operator must take: nulls, blanks, a very long text, repeats, clashing columns."""

LONG = "long winded text of many words " * 4000
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, size string, shard string, "
    "score string, leaks string, findings string, license string, kept string, key string, part string, place string, "
    "node long, block string, start string, rank string, component string"
)


def rows(texts):
    """(id, text, source) with a value in every clashing column."""
    return [(i, t, "en", s, None, 7, "a", "b", "c", "d", "e", "f", "g", "h", "i", "j", 9, "k", "l", "m", "n") for i, t, s in texts]


TEXTS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "a"), (5, "one two three four five six", "b"),
    (6, "one two three four five six", "b"), (6, "one two three four five six", "b"), (7, "Ünïcode 𝔘 text, straße", None),
    (None, "no id here", "b"), (None, None, None), (8, "x", "a"),
]


def odd(spark):
    return spark.createDataFrame(rows(TEXTS), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
