import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notemill.llm import chat
from notemill.llm.queries import QUERIES
from notemill.runtime import fresh_path

MARKS = chat.INSTRUCT.marks()
TURNS = "conv_id long, turn long, role string, text string"


def back(spark, turns, template=chat.INSTRUCT, **names):
    folder = fresh_path(spark, "chat-test")
    chat.write(chat.format_turns(turns, template, **names), folder)
    return chat.read(spark, folder, template).orderBy("part", "at").collect()


def machine(roles):
    """The order check of one conversation, turn by turn."""
    state, out = chat.START, []
    for role in roles:
        out.append(role in chat.INSTRUCT.follows.get(state, ()))
        state = role if role in chat.INSTRUCT.roles else state
    return out, state


def test_query_against_plain_computation(spark, sf):
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    rows = {r["conv_id"]: r for r in QUERIES["op11_chat_formatting"](spark, sf).collect()}
    assert rows.keys() == turns.keys()
    for conv, said in turns.items():
        learned = "".join(t for r, t in said if r == "assistant")
        good, last = machine([r for r, _ in said])
        want = {
            "n_turns": len(said), "loss_chars": len(learned), "out_of_order": good.count(False), "valid": all(good) and last == "assistant",
            "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(),
            "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(),
        }
        assert {k: rows[conv][k] for k in want} == want
    # "</s>[INST] ok [/INST]" gets three backslashes, twice, between the marks of a user and an assistant.
    assert rows[-1]["formatted_chars"] == 2 * (21 + 3) + 13 + 7


def test_no_mark_lies_inside_a_text(spark):
    texts = ["", "\\", "a\\", "\\[INST]", "</s", "s>", "<\\s>", "[[INST]]", "<s></s><s>", "\n", "x" * 50000 + "[/ROLE]", *MARKS, *[m[1:] for m in MARKS], *[m[:-1] for m in MARKS]]
    roles = ["user", "assistant", "system", "tool", "", "[TEXT]", "a\\[ROLE]b"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for r in roles for t in texts)]
    got = back(spark, spark.createDataFrame(rows, TURNS))
    assert [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in got] == rows
    for r in got:
        inner = "".join(s["text"] for s in r["segments"][1:-1])
        assert not any(m in inner for m in MARKS) and len(r["segments"]) == 3
        assert r["learned"] == (r["text"] if r["role"] == "assistant" else "")
        assert "".join(s["text"] for s in r["segments"] if s["loss"]).count("\\") >= r["learned"].count("\\")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sampled_from([*MARKS, "\\", "<", "[", "]", ">", "s", "/", "é", "𝔘", "\n"]), max_size=12))
def test_escaping_is_reversible_and_hides_marks(pieces):
    """The rule of ``escape``, restated: it leaves no mark and can be undone."""
    import re

    text = "".join(pieces)
    hidden = text.replace("\\", "\\\\")
    for m in MARKS:
        hidden = hidden.replace(m, m[0] + "\\" + m[1:])
    assert not any(m in hidden for m in MARKS)
    assert re.sub(r"(?s)\\(.)", r"\1", hidden) == text


def test_a_long_conversation_is_run_over_several_ranges(spark):
    import random

    rng = random.Random(3)
    roles = [rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]) for _ in range(3000)]
    rows = [(7, k, r, f"text {k}") for k, r in enumerate(roles)] + [(8, k, ("user", "assistant")[k % 2], "x") for k in range(40)]
    got = back(spark, spark.createDataFrame(rows, TURNS).repartition(6))
    assert len({r["part"] for r in got if r["conv_id"] == 7}) > 1
    good, last = machine(roles)
    mine = [r for r in got if r["conv_id"] == 7]
    assert [r["ok"] for r in mine] == good and mine[-1]["state"] == last
    assert [r["turn"] for r in mine] == list(range(3000))
    assert all(r["ok"] for r in got if r["conv_id"] == 8)


def test_equal_rows_are_spread(spark):
    rows = spark.range(0, 4000, 1, 8).selectExpr("5L AS conv_id", "0L AS turn", "'user' AS role", "'same' AS text")
    got = back(spark, rows)
    assert len(got) == 4000 and len({r["part"] for r in got}) > 1
    assert [r["ok"] for r in got] == [True] + [False] * 3999


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, "a"), (None, 0, "user", "", "b"), (1, None, "user", "early", "c"), (1, 0, "assistant", None, "d"),
        (1, 0, "assistant", None, "d"), (2, 0, "User", "other case", "e"), (3, 5, "user", "long " * 200000, "f"),
    ]
    got = back(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string"))
    assert [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in got] == [(c, t, r or "", x or "") for c, t, r, x, _ in rows]
    assert [r["ok"] for r in got] == [False, True, True, True, False, False, True]


def test_other_names_and_clashing_columns(spark):
    rows = spark.createDataFrame([("a", 1, "user", "hi", "x", "y")], "dialog string, k int, who string, said string, conv_id string, Segments string")
    (r,) = back(spark, rows, conv_col="dialog", turn_col="k", role_col="who", text_col="said")
    assert (r["conv_id"], r["turn"], r["role"], r["text"]) == ("a", 1, "user", "hi")


def test_no_rows(spark):
    assert back(spark, spark.createDataFrame([], TURNS)) == []


@pytest.mark.parametrize("other", [("[A]", "[A]B", "[/A]"), ("[A]", "A[", "[/A]"), ("", "[B]", "[C]"), ("[A]", "[B]", "[\\C]"), ("[A]", "[A]", "[C]")])
def test_templates_that_could_not_be_read_back_are_refused(other):
    with pytest.raises(ValueError):
        chat.Template(roles={"user": chat.Marks("<u>", "</u>")}, other=other, follows={})
