r"""Chat formatting by a declarative template, with a loss flag for every segment.

A finite-state machine over roles checks the order of turns. A turn's effect on the machine
is a map from states to states, and such maps compose; so ranges of turns are run
on their own, from every state they may be entered with, and only one map a range meets the
others. A conversation of any length is spread over tasks.

Text between marks is escaped: a backslash becomes two, and a control string gets one after its first
character. Marks open with a character that they hold nowhere else, and none begins with another, so
no mark can arise inside a text or over its border, and a turn can be read back from its characters alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.scratch import Scratch
from notemill.llm.turns import in_order

START = "start"


@dataclass(frozen=True)
class Marks:
    """What stands before and after a role's text, and whether the text is learned."""

    before: str
    after: str
    learn: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of each role, marks of any other role (before its name, before its text, after it), and the order of turns.

    ``follows`` tells which roles may come after a role, or after ``start``; ``ends`` after which a
    conversation may end.
    """

    roles: dict[str, Marks]
    other: tuple[str, str, str]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...] = field(default=())

    def __post_init__(self):
        marks = self.marks()
        openers = {m[:1] for m in marks}
        for m in marks:
            if not m or "\\" in m or any(c in openers for c in m[1:]):
                raise ValueError(f"the mark {m!r} is empty, or holds a backslash or an opening character")
        if len(set(marks)) < len(marks) or any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("a mark begins with another one")
        if START in self.roles:
            raise ValueError(f"{START!r} is the state before the first turn, not a role")

    def marks(self) -> list[str]:
        return [m for r in self.roles.values() for m in (r.before, r.after)] + list(self.other)

    def machine(self) -> tuple[list[str], list[list[int]], list[list[bool]]]:
        """States, and for each state and symbol (the roles, then any other) the next state and whether that is in order.

        After a turn out of order the machine goes on from that turn's role; another role leaves the state as it is.
        """
        states = [START, *self.roles]
        moves = [[states.index(r) for r in self.roles] + [s] for s in range(len(states))]
        good = [[r in self.follows.get(state, ()) for r in self.roles] + [False] for state in states]
        return states, moves, good


INSTRUCT = Template(
    roles={"system": Marks("<sys>", "</sys>"), "user": Marks("[INST]", "[/INST]"), "assistant": Marks("<s>", "</s>", learn=True)},
    other=("[ROLE]", "[TEXT]", "[/ROLE]"),
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


def escape(text: Column, template: Template) -> Column:
    tails: dict[str, list[str]] = {}
    for m in template.marks():
        tails.setdefault(m[0], []).append(re.escape(m[1:]))
    pattern = "|".join(f"(?<={re.escape(c)})(?={'|'.join(rest)})" for c, rest in tails.items())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), pattern, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(role: Column, text: Column, template: Template) -> Column:
    def piece(value, learn):
        return F.struct((F.lit(value) if isinstance(value, str) else value).alias("text"), F.lit(learn).alias("loss"))

    body = escape(text, template)
    out = F.array(
        piece(F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.other[1])), False),
        piece(body, False), piece(template.other[2], False),
    )
    for name, m in template.roles.items():
        out = F.when(role == name, F.array(piece(m.before, False), piece(body, m.learn), piece(m.after, False))).otherwise(out)
    return out


def format_turns(
    turns: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row a turn: ``conv_id``, ``turn``, ``part``, ``at``, ``ok``, ``state``, ``segments``.

    ``part`` and ``at`` order the turns (by ``turn``, nulls first, then role and text hash). ``segments`` are
    (text, loss) pairs whose texts in a row are the formatted turn; ``ok`` tells whether the role may stand
    there, ``state`` is the machine's after the turn. Every turn is formatted, whatever its role or order. A null text is
    empty, a null role has no name; rows without a conversation's id are a conversation of their own; repeated rows
    are turns of their own. Other columns are left out. No turns give no rows.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    states, moves, good = template.machine()
    symbols = {r: k for k, r in enumerate(template.roles)}
    plain = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    watched = T.StructType([*plain.schema, T.StructField("symbol", T.IntegerType()), T.StructField("before", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import pyspark.sql.pandas.types as convert

        arrow = convert.to_arrow_schema(watched)
        seen, now, entered = False, None, []
        for batch in batches:
            codes, before = [], []
            for conv, role in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not seen:
                    # The first conversation of a range may have begun in an earlier one.
                    seen, now, entered = True, conv, list(range(len(states)))
                elif conv != now:
                    now, entered = conv, [0]
                code = symbols.get(role, len(symbols))
                codes.append(code)
                before.append(entered)
                entered = [moves[s][code] for s in entered]
            columns = [*batch.columns, pa.array(codes), pa.array(before, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    ordered = in_order(plain, scratch, run, watched)
    edge = ordered.groupBy("part").agg(
        F.min_by("conv_id", "at").alias("first"), F.max_by(F.struct("conv_id", "symbol", "before"), "at").alias("last")
    )
    # A row for each range, however many turns there are.
    entries, last, state = [], None, 0
    for e in sorted(edge.collect(), key=lambda e: e["part"]):
        state = state if last is not None and last["conv_id"] == e["first"] else 0
        entries.append((e["part"], state))
        last, ends = e["last"], e["last"]["before"]
        state = moves[ends[state] if len(ends) > 1 else ends[0]][last["symbol"]]
    entries = spark.createDataFrame(entries, "part int, entry int")

    flat = lambda rows: F.array(*[F.lit(x) for row in rows for x in row])
    before = F.element_at("before", F.when(F.size("before") == 1, 1).otherwise(F.col("entry") + 1))
    cell = (before * (len(symbols) + 1) + F.col("symbol") + 1).cast("int")
    judged = ordered.join(F.broadcast(entries), "part").withColumn("cell", cell)
    return judged.select(
        "conv_id", "turn", "part", "at", F.element_at(flat(good), F.col("cell")).alias("ok"),
        F.element_at(F.array(*[F.lit(s) for s in states]), F.element_at(flat(moves), F.col("cell")) + 1).alias("state"),
        _segments(F.col("role"), F.col("text"), template).alias("segments"),
    )


def write(formatted: DataFrame, folder: str) -> None:
    """Write formatted turns in their order; a file holds whole ranges or parts of one."""
    formatted.write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str, template: Template = INSTRUCT) -> DataFrame:
    """Written turns, with ``role``, ``text`` and ``learned`` (the text under the loss mask) read from their characters."""
    out = spark.read.parquet(folder)
    whole = F.concat_ws("", F.col("segments.text"))
    # By its first mark a turn names its role; what lies between its marks is its text.
    opened, middle, closed = template.other
    out = out.withColumn("formatted", whole)
    named = F.substring_index(F.substr("formatted", F.lit(len(opened) + 1)), middle, 1)
    role, begin, tail = unescape(named), F.length(named) + len(opened) + len(middle), F.lit(len(closed))
    for name, m in template.roles.items():
        here = F.startswith("formatted", F.lit(m.before))
        role = F.when(here, F.lit(name)).otherwise(role)
        begin, tail = F.when(here, F.lit(len(m.before))).otherwise(begin), F.when(here, F.lit(len(m.after))).otherwise(tail)
    text = unescape(F.substr("formatted", begin + 1, F.length("formatted") - begin - tail))
    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return out.withColumn("role", role).withColumn("text", text).withColumn("learned", F.concat_ws("", masked))
