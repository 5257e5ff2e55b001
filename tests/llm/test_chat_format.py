import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import chat_format as C

PARTS = st.lists(st.sampled_from(["### ", "</turn>", "</turn>\n", "\\", "<\\/turn>", "#\\## ", ": ", "~", "a", "\n", "#", "<", "User", "é🙂", "\r"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "a b"]), PARTS), PARTS), max_size=6))
def test_any_conversation_reads_back(turns):
    parser, got = C.Parser(), []
    for role, text in turns:
        out, start, end, level = C.format_turn(role, text)
        assert C.unescape(out[start:end], level) == text
        got += parser.feed(out)
    parser.done()
    assert [(t.role, t.text) for t in got] == turns


def test_only_what_conflicts_is_escaped():
    assert C.format_turn("user", "back\\slash")[3] == 0
    assert C.format_turn("user", "a </turn> b")[3] == 1
    assert C.format_turn("assistant", "\\### Assistant: </turn> ok")[0] == "### Assistant~: \\\\#\\## Assistant: <\\/turn> ok</turn>\n"


def test_broken_text_is_refused():
    import pytest

    for bad in ("hello", "### User: x</turn>y", "### User: a ### b</turn>\n", "### User~~: a</turn>\n"):
        with pytest.raises(ValueError):
            p = C.Parser()
            list(p.feed(bad))
            p.done()


def expected(turns):
    n = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), n, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query(spark, folder):
    rows = [(1, 1, "assistant", "ok </turn>"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, "assistant", "tie"), (2, None, "user", "first"), (None, 0, "user", "n"), (3, 0, "assistant", "é" * 30_000), (3, 0, "assistant", "é" * 30_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit(1))
    got = {r["conv_id"]: r for r in C.op10_chat_format(spark, folder(conversations=table)).collect()}
    want = {
        1: [("user", ""), ("assistant", "ok </turn>")],
        2: [("user", "first"), ("", "x"), ("assistant", "tie")],
        None: [("user", "n")],
        3: [("assistant", "é" * 30_000)] * 2,
        -7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")],
    }
    assert set(got) == set(want)
    for k, turns in want.items():
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(turns)
    whole = {r["conv_id"]: r for r in C.format_conversations(table).collect()}
    for k, r in whole.items():
        assert len(r["text"]) == got[k]["formatted_chars"]
        body = "".join(r["text"][s["start"] : s["end"]] for s in r["loss_spans"])
        assert (len(body) == got[k]["loss_chars"]) or k == 1
    assert C.read_back(C.formatted_turns(table.limit(0))).count() == 0
