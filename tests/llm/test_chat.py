import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from octavo.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window int"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        lost = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(lost), sha(lost))
    return out


def check(spark, rows, **options):
    w = chat.windows(spark.createDataFrame(rows, SCHEMA), **options)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(w).collect()}
    assert got == expected(rows)
    return w


def test_real_conversations(spark, sf):
    rows = [(*r, 0) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)
    w = check(spark, rows, budget=200, history=40)
    assert w.where("n_repeated > 0").count() > 0


def test_control_strings(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\b\\l\\h", "</turn>\n### user: x", "\\", "<", "#", ": ", "\\\\l", "a\n\n</turn>"]
    rows = [(1, i, "user" if i % 2 else "assistant", x, 0) for i, x in enumerate(nasty)] + [(2, 0, "ro: le#<\\c", "x", 0), (2, 1, "assistant", "", 0)]
    check(spark, rows, budget=20, history=6)


def test_windows(spark):
    rows = [(1, 0, "system", "rules " * 5, 0)] + [(1, i, "assistant" if i % 2 else "user", f"t{i} " * 10, 0) for i in range(1, 30)] + [(1, 30, "assistant", "long " * 500, 0), (1, 31, "user", "end", 0)]
    w = check(spark, rows, budget=100, history=30).orderBy("window").collect()
    assert len(w) > 4
    for r in w:
        assert r.n_tokens <= 100 or "long" in r.formatted
        assert r.formatted.startswith("### system: rules")
        if r.window:
            assert r.n_repeated >= 1


def test_edges(spark):
    check(spark, [(None, None, None, None, None), (None, 1, "system", "s", 1), (5, 1, "assistant", "q", 2), (5, 1, "assistant", "q", 2), (6, 1, "assistant", "w " * 5000, 0), (7, 1, "system", "s " * 3000, 0), (7, 2, "assistant", "x", 0)])
    assert chat.digests(chat.windows(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="\\<#lhbct/urn>: \né", max_size=30), min_size=1, max_size=12))
def test_any_text(spark, texts):
    check(spark, [(1, i, ["user", "assistant", "system"][i % 3], x, 0) for i, x in enumerate(texts)], budget=16, history=6)


def test_no_python_in_the_plan(spark, sf):
    plan = chat.digests(chat.windows(spark.read.parquet(f"{sf}/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", ["\\", "\\l", "<b>", "##", "\\\\h\\"])
def test_escape(spark, text):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "t string").select(chat.unescape(chat.escape(F.col("t"))).alias("t"), chat.escape(F.col("t")).alias("e")).first()
    assert row.t == text and "<" not in row.e and "#" not in row.e
