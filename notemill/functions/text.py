"""Text expressions. Whitespace means what Python's ``str.split`` means by it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's ``str.isspace`` holds, once as
# a character list (for trims) and once as a class that Java and RE2 both read.
SPACE_CHARS = "".join(
    chr(code)
    for code in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)
SPACE_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# A piece in word mode: a run of letters and digits, or one other sign but whitespace.
PIECE_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}" + SPACE_CLASS[1:]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def ws_split(c: Column) -> Column:
    """Words between whitespace runs; no empty words."""
    return F.filter(F.split(c, SPACE_CLASS + "+"), lambda w: w != "")


def collapse_ws(c: Column) -> Column:
    return F.array_join(ws_split(c), " ")


def nonblank_tokens(c: Column) -> Column:
    """Split on single spaces, drop what is only whitespace.

    Between two tokens, blank tokens are whitespace that ends in a space, so one
    separator pattern takes them in and no token needs a look of its own.
    """
    inner = strip(c)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, f" (?:{SPACE_CLASS}* )?", -1)
    )


def normalise_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def text_lines(c: Column) -> Column:
    """Lines without their newline; a final newline opens no further line."""
    lines = F.split(c, "\n", -1)
    return F.when(
        F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)
    ).otherwise(lines)


def word_pieces(c: Column) -> Column:
    """Word-mode pieces of a word or of a whole text."""
    return F.regexp_extract_all(c, F.lit(PIECE_PATTERN), 0)


def unescape_for(observed: Column, stated: Column) -> Column:
    """The stated text, with quotes escaped where only the observed text has them so."""

    def escaped(value: Column, entity: str, sign: str) -> Column:
        one_sided = F.contains(observed, F.lit(entity)) & ~F.contains(value, F.lit(entity))
        return F.when(one_sided, F.replace(value, F.lit(sign), F.lit(entity))).otherwise(value)

    return escaped(escaped(stated, "&apos;", "'"), "&quot;", '"')


def parse_position(c: Column) -> dict[str, Column]:
    """Fields of ``c="…" 16:2 16:2||t="…"``; all NULL where the line has another form."""
    pattern = r'^c="(.*?)"\s(\d+):(\d+)\s(\d+):(\d+)\|\|t="(.*)"$'
    ok = F.rlike(c, F.lit(pattern))

    def group(i: int) -> Column:
        return F.when(ok, F.regexp_extract(c, pattern, i))

    return {
        "start_line": group(2).cast("int"),
        "start_pos": group(3).cast("int"),
        "end_line": group(4).cast("int"),
        "end_pos": group(5).cast("int"),
        "type": group(6),
        "stated": F.array_join(nonblank_tokens(group(1)), " "),
    }


def pairs_to_lines(tokens: Column, tags: Column) -> Column:
    """``token tag`` per line, for one sentence."""
    return F.array_join(F.zip_with(tokens, tags, lambda t, g: F.concat(t, F.lit(" "), g)), "\n")
