"""Conversation structure repair: the cheapest edits, found by depth-first branch-and-bound.

Edits keep, rerole or delete a row, or insert an empty turn, so that the roles' initials read ``(s?(ua)+)?``.
A node is (rows done, state); an explicit stack holds prefixes of edits. A prefix is given up where its cost
and a lower bound of the rest exceed the incumbent, or where the table of its node has a better prefix.
When the stack is empty, the incumbent is proved best.

A long conversation is cut into blocks. Each is solved from every state it can be entered in to every
state it can be left in, and the same search then runs over the blocks, first inside a range of rows, then over
ranges; so rows of one conversation are spread over tasks and no block is large.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.scratch import Scratch, partitions
from notemill.llm.turns import in_order

#: States: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
BLOCK = 64
SPACE = " \t\n\x0b\x0c\r"

#: Costs of the edits, and of a cut-off text that is not deleted.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5

Move = tuple[int, str, int, int]  # cost, audit, rows done, state


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    """State after a kept row, or None where its role may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    wanted = "a" if state == USER else "u"
    return _next(state) if initial == wanted else None


def _reaches(state: int, goals) -> bool:
    return any(g >= USER or (state <= g and state <= SYSTEM) for g in goals)


def branch_and_bound(
    n: int, entry: int, goals: tuple[int, ...], moves: Callable[[int, int], list[Move]], bound: Callable[[int, int], int]
) -> tuple[int, str, list[tuple[str, int]]] | None:
    """The least (cost, audit) from (0, ``entry``) to (``n``, a goal), with the (audit, state) of each of its moves.

    ``bound`` never exceeds the cost of the rest. Of two prefixes of one node with equal cost neither begins with the
    other (the rest would be insertions, which cost), so the less one stays less whatever follows.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    incumbent = None
    stack = [(0, "", 0, entry, None)]
    while stack:
        cost, audit, i, state, trail = stack.pop()
        if best[i, state] < (cost, audit):
            continue
        if incumbent is not None:
            least = cost + bound(i, state)
            if least > incumbent[0] or (least == incumbent[0] and audit > incumbent[1][: len(audit)]):
                continue
        if i == n and state in goals and (incumbent is None or (cost, audit) < incumbent[:2]):
            incumbent = (cost, audit, trail)
        children = []
        for price, piece, j, after in moves(i, state):
            label = (cost + price, audit + piece)
            if (j, after) in best and best[j, after] <= label:
                continue
            if not _reaches(after, goals):
                continue
            best[j, after] = label
            children.append((label[0] + bound(j, after), piece, (*label, j, after, (trail, piece, after))))
        # The most promising child comes off the stack first.
        children.sort(key=lambda c: c[:2], reverse=True)
        stack += [c[2] for c in children]
    if incumbent is None:
        return None
    path, trail = [], incumbent[2]
    while trail is not None:
        trail, piece, state = trail
        path.append((piece, state))
    return incumbent[0], incumbent[1], path[::-1]


def row_moves(kinds: str, initials: str) -> Callable[[int, int], list[Move]]:
    """Edits of rows; a kind is ``o`` (sound), ``t`` (cut off), ``b`` (blank) or ``d`` (duplicate)."""

    def moves(i: int, state: int) -> list[Move]:
        out = [(INSERT, "I", i, _next(state))]
        if i < len(kinds):
            out.append((DELETE, "D", i + 1, state))
            if kinds[i] in "ot":
                extra = CUT if kinds[i] == "t" else 0
                kept = _kept(state, initials[i])
                if kept is not None:
                    out.append((extra, "K", i + 1, kept))
                out.append((REROLE + extra, "R", i + 1, _next(state)))
        return out

    return moves


def row_bound(kinds: str, initials: str) -> Callable[[int, int], int]:
    """Lower bounds of the cost from a row on.

    Every row that cannot be kept costs its cheapest edit; of sound user and assistant rows that follow each other, two
    of one role cost at least 1 more, counted for pairs that share no row, the state before included.
    """
    n = len(kinds)
    own, has_system = [0] * (n + 1), [False] * (n + 1)
    pairs, head, rest = [0] * (n + 1), [""] * (n + 1), [0] * (n + 1)  # rest: pairs without the head
    for i in range(n - 1, -1, -1):
        has_system[i] = has_system[i + 1]
        if kinds[i] != "o":
            own[i], head[i], pairs[i], rest[i] = own[i + 1] + DELETE, head[i + 1], pairs[i + 1], rest[i + 1]
        elif initials[i] not in "ua":
            own[i], head[i], pairs[i], rest[i] = own[i + 1] + REROLE, "", pairs[i + 1], pairs[i + 1]
            has_system[i] |= initials[i] == "s"
        else:
            own[i], head[i], rest[i] = own[i + 1], initials[i], pairs[i + 1]
            pairs[i] = max(pairs[i + 1], rest[i + 1] + 1) if head[i + 1] == initials[i] else pairs[i + 1]

    def bound(i: int, state: int) -> int:
        clash = head[i] == ("u" if state == USER else "a")
        least = own[i] + (max(pairs[i], rest[i] + 1) if clash else pairs[i])
        # From the start one system row may be kept.
        return max(0, least - 1) if state == START and has_system[i] else least

    return bound


Edge = tuple[int, int, int, str]  # entry, exit, cost, audit


def joined(blocks: list[list[Edge]], entry: int, goals: tuple[int, ...]):
    """Branch-and-bound over solved blocks."""
    by_entry = [{s: [(c, a, x) for e, x, c, a in edges if e == s] for s in range(4)} for edges in blocks]
    least = [0] * (len(blocks) + 1)
    for i in range(len(blocks) - 1, -1, -1):
        least[i] = least[i + 1] + min((c for _, _, c, _ in blocks[i]), default=0)

    def moves(i: int, state: int) -> list[Move]:
        return [(c, a, i + 1, x) for c, a, x in by_entry[i][state]] if i < len(blocks) else []

    return branch_and_bound(len(blocks), entry, goals, moves, lambda i, state: least[i])


def solve(kinds: str, initials: str, whole: bool = True) -> list[Edge]:
    """Cheapest edits of some rows: of a whole conversation, or from each state to each state of a part of one."""
    blocks = [(kinds[a : a + BLOCK], initials[a : a + BLOCK]) for a in range(0, len(kinds), BLOCK)]
    if whole and len(blocks) <= 1:
        cost, audit, path = branch_and_bound(len(kinds), START, GOALS, row_moves(kinds, initials), row_bound(kinds, initials))
        return [(START, path[-1][1] if path else START, cost, audit)]
    solved = []
    for k, i in blocks:
        moves, bound = row_moves(k, i), row_bound(k, i)
        edges = []
        for entry in range(4):
            for leave in range(4):
                found = branch_and_bound(len(k), entry, (leave,), moves, bound) if _reaches(entry, (leave,)) else None
                if found:
                    edges.append((entry, leave, found[0], found[1]))
        solved.append(edges)
    if whole:
        cost, audit, path = joined(solved, START, GOALS)
        return [(START, path[-1][1], cost, audit)]
    if len(solved) == 1:
        return solved[0]
    out = []
    for entry in range(4):
        for leave in range(4):
            found = joined(solved, entry, (leave,))
            if found:
                out.append((entry, leave, found[0], found[1]))
    return out


def edits_of(audit: str, initials: str, entry: int) -> list[tuple[list[str], str, str | None, list[str]]]:
    """For each row: roles inserted before it, its edit, its new role if any, and roles inserted after the last one."""
    out, state, pending, k = [], entry, [], 0
    for edit in audit:
        if edit == "I":
            state = _next(state)
            pending.append(ROLES[state])
            continue
        role = None
        if edit == "K":
            state = _kept(state, initials[k])
        elif edit == "R":
            state = _next(state)
            role = ROLES[state]
        out.append((pending, edit, role, []))
        pending, k = [], k + 1
    if pending:
        out[-1][3].extend(pending)
    return out


_EDGES = T.ArrayType(T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("leave", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_LEGAL = ("su", "ua", "au")


def _mapped(schema: T.StructType, row_of):
    """For ``mapInArrow``: lists of Python values, row by row; a row here stands for many turns."""

    def run(batches):
        import pyspark.sql.pandas.types as convert

        arrow = convert.to_arrow_schema(schema)
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in row_of(row)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return run


class Repaired(NamedTuple):
    conversations: DataFrame
    rows: DataFrame


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Repaired:
    """Cheapest repair of every conversation; its rows stand by turn, nulls first, then role and text hash.

    ``conversations``: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` (initials of the edits in order, least in ASCII of the cheapest). ``rows``: the repaired turns as ``conv_id``,
    ``part``, ``at``, ``step`` (these three order them), ``edit``, ``role``, ``text``.

    A null role or text is one space. Of a row's faults the first counts: blank, then role and text seen
    earlier, then a last character other than ``. ! ?``. Blank and repeated rows are deleted; a role is read by its first character, and
    one that is not s, u or a is reroled or deleted. Rows without a conversation's id are a conversation of their own; null
    turns count for no gap. Other columns are left out. No turns give no rows.
    """
    scratch = Scratch(turns.sparkSession, "repair")
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), one_space(role_col).alias("role"), one_space(text_col).alias("text"))
    ordered = in_order(plain, scratch)

    said = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    facts = ordered.select(
        "conv_id", "turn", "part", "at", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        F.when(said == "", "b").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "t").otherwise("o").alias("kind"),
        F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256).alias("content"),
    )
    # One row for each distinct text of a conversation; rows then meet it by their own place, so no text is a hot key.
    first = facts.groupBy("conv_id", "content").agg(F.min(F.struct("part", "at")).alias("x")).select("x.part", "x.at", F.lit(True).alias("new"))
    coded = scratch.table(
        facts.drop("content").join(first, ["part", "at"], "left")
        .withColumn("kind", F.when((F.col("kind") != "b") & F.col("new").isNull(), "d").otherwise(F.col("kind"))).drop("new"), "coded",
    )
    counts = scratch.table(
        coded.groupBy("conv_id").agg(
            (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
            *[F.count_if(F.col("kind") == k).alias(name) for k, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
            (F.min("part") == F.max("part")).alias("whole"),
        ).withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))), "counts",
    )

    # A group is at most one conversation's rows of one range.
    # Dealt by number, as rows are few bytes and much work.
    dealt = coded.repartition(partitions(turns.sparkSession), "conv_id", "part")
    groups = dealt.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "initial"))).alias("rows"))
    groups = groups.join(counts.select(F.col("conv_id").alias("key"), "whole"), F.col("conv_id").eqNullSafe(F.col("key"))).select(
        "conv_id", "part", "whole", F.col("rows")[0]["at"].alias("first"), F.array_join("rows.kind", "").alias("kinds"), F.array_join("rows.initial", "").alias("initials")
    )
    conv = ordered.schema["conv_id"]
    solved = T.StructType([conv, T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("initials", T.StringType()), T.StructField("edges", _EDGES)])

    def solve_group(row):
        edges = [dict(zip(("entry", "leave", "cost", "audit"), e)) for e in solve(row["kinds"], row["initials"], row["whole"])]
        yield {**{c: row[c] for c in ("conv_id", "part", "first", "initials")}, "edges": edges}

    ranges = groups.mapInArrow(_mapped(solved, solve_group), solved)
    whole = ranges.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "first", "initials", "edges"))).alias("parts"))
    pieces = T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("initials", T.StringType()), T.StructField("entry", T.IntegerType()), T.StructField("audit", T.StringType())]))
    closed = T.StructType([conv, T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("pieces", pieces)])

    def close(row):
        blocks = [[(e["entry"], e["leave"], e["cost"], e["audit"]) for e in p["edges"]] for p in row["parts"]]
        cost, audit, path = joined(blocks, START, GOALS)
        initials = "".join(p["initials"] for p in row["parts"])
        illegal = sum(initials[i : i + 2] not in _LEGAL for i in range(len(initials) - 1))
        entries = [START, *[state for _, state in path]]
        cut = [{"part": p["part"], "first": p["first"], "initials": p["initials"], "entry": e, "audit": a} for p, e, (a, _) in zip(row["parts"], entries, path)]
        yield {"conv_id": row["conv_id"], "illegal": illegal, "cost": cost, "audit": audit, "pieces": cut}

    done = scratch.table(whole.mapInArrow(_mapped(closed, close), closed), "done")
    conversations = counts.join(done.withColumnRenamed("conv_id", "key"), F.col("conv_id").eqNullSafe(F.col("key"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )

    edit = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("inserted", T.ArrayType(T.StringType())),
        T.StructField("edit", T.StringType()), T.StructField("new_role", T.StringType()), T.StructField("closing", T.ArrayType(T.StringType())),
    ])

    def spell(row):
        piece = row["piece"]
        for k, (before, what, role, after) in enumerate(edits_of(piece["audit"], piece["initials"], piece["entry"])):
            yield {"part": piece["part"], "at": piece["first"] + k, "inserted": before, "edit": what, "new_role": role, "closing": after}

    edits = done.select(F.explode("pieces").alias("piece")).mapInArrow(_mapped(edit, spell), edit)
    empty = lambda roles: F.transform(roles, lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text")))
    own = F.struct("edit", F.coalesce("new_role", "role").alias("role"), "text")
    steps = F.concat(empty(F.col("inserted")), F.filter(F.array(own), lambda r: r["edit"] != "D"), empty(F.col("closing")))
    rows = ordered.join(edits, ["part", "at"]).select("conv_id", "part", "at", F.posexplode(steps).alias("step", "row"))
    return Repaired(conversations, rows.select("conv_id", "part", "at", "step", "row.*"))
