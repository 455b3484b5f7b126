import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kinmatch.llm.chat import END, START, TURN, format_chats, read_back

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"


def plain(turns):
    """The format written out by hand."""
    esc = lambda s: __import__("re").sub(r"<(\\*)\|", r"<\\\1|", s)
    out, spans, last = "", [], None
    for role, text in turns:
        if last is None or role != last:
            out += (END if last is not None else "") + START + esc(role).replace("\n", "<|nl|>") + "\n"
        else:
            out += TURN
        if role == "assistant":
            spans.append((len(out), len(esc(text))))
        out += esc(text)
        last = role
    return out + END, spans


def run(spark, chats):
    rows = [(c, i, r, t, "x", 1) for c, turns in chats.items() for i, (r, t) in enumerate(turns)]
    made = format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return {r["conv_id"]: r for r in made.collect()}, {r["conv_id"]: r for r in read_back(made).collect()}


def check(spark, chats):
    made, back = run(spark, chats)
    assert made.keys() == back.keys() == chats.keys()
    for c, turns in chats.items():
        turns = [(r or "", t or "") for r, t in turns]
        text, spans = plain(turns)
        assert made[c]["formatted"] == text
        assert [tuple(s) for s in made[c]["mask"]] == spans
        assert [tuple(t) for t in back[c]["turns"]] == turns
        assert back[c]["loss_text"] == "".join(t for r, t in turns if r == "assistant")
        assert back[c]["formatted_chars"] == len(text)


def test_cases(spark):
    check(
        spark,
        {
            1: [("user", "hi"), ("assistant", "yo")],
            2: [("user", "a"), ("user", "b"), ("assistant", ""), ("assistant", "<|turn|>"), ("assistant", "d")],
            3: [("assistant", "<|im_end|>\n<|im_start|>user\nx"), ("user", "<\\|nl|>")],
            4: [(None, None), ("", "x"), ("we\nird<|nl|>", "é😀\n"), ("system", "$1 \\ $0")],
            None: [("user", "no id")],
        },
    )


piece = st.sampled_from(["<|im_start|>", "<|im_end|>\n", "<|turn|>", "<|nl|>", "<", "\\", "|", "\n", "a", "é", "<\\|", "$1", " "])
text = st.lists(piece, max_size=6).map("".join)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]) | text, text), min_size=1, max_size=6), min_size=1, max_size=25))
def test_round_trip(spark, chats):
    check(spark, dict(enumerate(chats)))


def test_ties_and_repeats_do_not_depend_on_order(spark):
    rows = [(1, 0, "user", "b", "", 0), (1, 0, "user", "a", "", 0), (1, None, "system", "s", "", 0), (1, 0, "user", "a", "", 0)]
    made = [format_chats(spark.createDataFrame(x, SCHEMA)).collect()[0]["formatted"] for x in (rows, rows[::-1])]
    assert made[0] == made[1] == plain([("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")])[0]


def test_a_long_conversation(spark):
    check(spark, {1: [(("user", "assistant")[i // 3 % 2], f"t{i}" * 20) for i in range(2000)]})


def test_no_rows(spark):
    assert read_back(format_chats(spark.createDataFrame([], SCHEMA))).collect() == []
