import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from notemill.llm import repair
from notemill.llm.queries import QUERIES

GRAMMAR = re.compile(r"(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(kinds, initials):
    """Uniform-cost search over (rows done, state): the least (cost, audit, repaired initials with their rows)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(kinds) and last in ("", "a"):
            return cost, audit, out
        after = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, after, (*out, (after, None))))
        if i < len(kinds):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if kinds[i] in "ot":
                extra = 5 * (kinds[i] == "t")
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, after, (*out, (after, i))))
                if initials[i] == after or (initials[i] == "s" and last == ""):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initials[i], (*out, (initials[i], i))))


def by_trial(kinds, initials, most):
    """Every edit sequence with at most ``most`` insertions, by its definition."""
    n, best = len(kinds), None
    for gaps in itertools.product(range(most + 1), repeat=n + 1):
        if sum(gaps) > most:
            continue
        for edits in itertools.product("DKR", repeat=n):
            if any(e != "D" and k in "bd" for e, k in zip(edits, kinds)):
                continue
            audit = "".join("I" * g + e for g, e in zip(gaps, [*edits, ""]))
            cost = 5 * sum(gaps) + sum({"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and k == "t") for e, k in zip(edits, kinds))
            if best is not None and (cost, audit) >= best:
                continue
            slots, k = [], 0
            for g, e in zip(gaps, [*edits, ""]):
                slots += ["*"] * g
                if e:
                    if e != "D":
                        slots.append(initials[k] if e == "K" else "*")
                    k += 1
            size = len(slots)
            options = [""] if size == 0 else [("ua" * size)[:size], "s" + ("ua" * size)[: size - 1]]
            if any(GRAMMAR.fullmatch(o) and all(x == "*" and y in "ua" or x == y for x, y in zip(slots, o)) for o in options):
                best = (cost, audit)
    return best


def test_search_against_every_sequence():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(0, 4)
        kinds, initials = "".join(rng.choices("ootbd", k=n)), "".join(rng.choices("suax", k=n))
        (edge,) = repair.solve(kinds, initials)
        assert edge[2:] == by_trial(kinds, initials, 2) == cheapest(kinds, initials)[:2]


@pytest.mark.parametrize("n", [5, 20, 64, 65, 200])
def test_search_against_uniform_cost(n, monkeypatch):
    rng = random.Random(n)
    for k in range(40 if n < 65 else 3):
        kinds = "".join(rng.choices("ooooooootbd", k=n))
        initials = "".join(rng.choices("uuaasx"[: rng.choice([4, 6])], k=n)) if k % 2 else ("ua" * n)[:n]
        want = cheapest(kinds, initials)[:2]
        assert repair.solve(kinds, initials)[0][2:] == want
        monkeypatch.setattr(repair, "BLOCK", rng.choice([1, 3, 7]))
        assert repair.solve(kinds, initials)[0][2:] == want
        at = rng.randint(1, n - 1)
        halves = [repair.solve(kinds[:at], initials[:at], False), repair.solve(kinds[at:], initials[at:], False)]
        assert repair.joined(halves, repair.START, repair.GOALS)[:2] == want
        monkeypatch.undo()


@pytest.mark.parametrize("unit", ["u", "a", "s", "x", "uua", "uau", "uuauua", "uuaa", "aau", "sua"])
@pytest.mark.parametrize("kind", ["o", "t", "ot", "ob"])
def test_regular_long_conversations_stay_cheap_to_search(unit, kind):
    n = 400
    initials, kinds = (unit * n)[:n], (kind * n)[:n]
    assert repair.solve(kinds, initials)[0][2:] == cheapest(kinds, initials)[:2]


def test_bounds_never_exceed_the_cost():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(1, 9)
        kinds, initials = "".join(rng.choices("oootbd", k=n)), "".join(rng.choices("uasx", k=n))
        bound, moves = repair.row_bound(kinds, initials), repair.row_moves(kinds, initials)
        for i in range(n + 1):
            for state in range(4):
                shifted = lambda j, s: [(c, a, x - i, y) for c, a, x, y in moves(j + i, s)]
                found = repair.branch_and_bound(n - i, state, repair.GOALS, shifted, lambda j, s: 0)
                assert found is None or bound(i, state) <= found[0]


def restated(turns):
    """The contract, row by row in plain Python."""
    out, rows = {}, defaultdict(list)
    for conv, turn, role, text in turns:
        out[conv] = None
        space = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        rows[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    for conv in out:
        mine = sorted(rows[conv], key=lambda r: (r[0] is not None, r[0] or 0))
        seen, kinds = set(), ""
        for _, role, text in mine:
            last = BLANK.findall(text)[-1:]
            kinds += "b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else "o"
            seen.add((role, text))
        initials = "".join(r[1][:1] if r[1][:1] in ("s", "u", "a") else "x" for r in mine)
        cost, audit, path = cheapest(kinds, initials)
        numbers = [r[0] for r in mine if r[0] is not None]
        lines = []
        for role, at in path:
            was = mine[at] if at is not None else (None, "", "")
            name = was[1] if at is not None and was[1][:1] == role else {"u": "user", "a": "assistant"}[role]
            lines.append(f"{name}:{was[2]}")
        pairs = [a + b for a, b in zip(initials, initials[1:])]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def result(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_against_the_contract(spark, size):
    folder = f"/root/testdata/{size}"
    turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op12_conversation_repair"](spark, folder)) == restated(turns)


def written(spark, rows, tmp_path, schema=TURNS):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_long_conversations_cross_ranges(spark, tmp_path):
    rng = random.Random(4)
    said = ["Yes.", "no", "why?", " ", "So! \n", "Yes. ", "x" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "ute"]
    rows = [(9, k, rng.choice(roles), f"{rng.choice(said)}" if k % 3 else f"{k}.") for k in range(1500)] + [(10, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(300)]
    folder = written(spark, rows, tmp_path)
    fixed = repair.repair(spark.read.parquet(f"{folder}/conversations.parquet"))
    assert fixed.rows.filter("conv_id = 9").select("part").distinct().count() > 1
    assert result(QUERIES["op12_conversation_repair"](spark, folder)) == restated(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(None, k, "user", "Hi.") for k in range(3)] + [(1, None, None, None), (1, None, "user", "Null turn."), (1, 5, "assistant", "Five."), (1, 9, "assistant", "long word " * 90000)]
    rows += [(2, k, "user", "same.") for k in range(700)] + [(3 + k, 0, "user", "") for k in range(60)] + [(100, 2**40, "assistant", "Far.")]
    assert result(QUERIES["op12_conversation_repair"](spark, written(spark, rows, tmp_path))) == restated(rows)


def test_no_rows(spark, tmp_path):
    assert result(QUERIES["op12_conversation_repair"](spark, written(spark, [], tmp_path))) == {}


def test_repaired_rows_are_real_turns(spark):
    rows = [("c", 0, "assistant", "First.", 1), ("c", 1, "user", "Second.", 2), ("c", 2, "user", "", 3)]
    df = spark.createDataFrame(rows, "dialog string, k int, who string, said string, Part int")
    fixed = repair.repair(df, "dialog", "k", "who", "said")
    (conv,) = fixed.conversations.collect()
    assert (conv["conv_id"], conv["cost"], conv["audit"], conv["blank"], conv["illegal"]) == ("c", 4, "RRD", 1, 1)
    got = fixed.rows.orderBy("part", "at", "step").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in got] == [("R", "user", "First."), ("R", "assistant", "Second.")]
