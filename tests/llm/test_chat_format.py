import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm.chat_format import format_conversations, read_back

TEXTS = ["", "plain", "a<b", "\\", "\\l", "\\b", "<part>", "</turn>\n", "<turn assistant>", "é日本\U0001f600", "x\n", "\\<", "\\\\l", r"\### Assistant: </turn> ok"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}


def esc(text):
    return text.replace("\\", "\\b").replace("<", "\\l")


def formatted(turns):
    out = ""
    for k, (role, text) in enumerate(turns):
        out += "<part>" if k and turns[k - 1][0] == role else "<turn " + esc(role).replace(">", "\\g") + ">"
        out += esc(text)
        if k == len(turns) - 1 or turns[k + 1][0] != role:
            out += "</turn>\n"
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = format_conversations(df)
    want = plain(rows)
    texts = {r.conv_id: r for r in out.collect()}
    assert {c: r.formatted for c, r in texts.items()} == {c: formatted(t) for c, t in want.items()}
    for c, r in texts.items():
        raw = r.formatted.encode()
        assert [raw[s.start : s.start + s.length].decode() for s in r.loss_spans] == [esc(t) for role, t in want[c] if role == "assistant"]
    for r in read_back(out).collect():
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.losses == [t for role, t in want[r.conv_id] if role == "assistant"]


def test_awkward_texts(spark):
    rows = [(k, i, ("user", "assistant")[(i + j) % 2], TEXTS[(k + i) % len(TEXTS)]) for k in range(len(TEXTS)) for i in range(4) for j in (k % 2,)]
    check(spark, rows)


def test_nulls_ties_and_repeats(spark):
    check(spark, [(1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (1, None, "user", "first"), (None, 1, "assistant", "no id"), (2, 1, "we>ird<", "x"), (2, 2, "we>ird<", "y")])


def test_long_conversation(spark):
    check(spark, [(1, i, "assistant" if i % 3 else "user", f"text {i} <é") for i in range(2000)])


def test_empty_and_clashing_columns(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("*", "'x' AS turns", "'y' AS formatted", "1 AS t", "2 AS loss_spans")
    assert format_conversations(turns).count() == turns.select("conv_id").distinct().count()
    assert read_back(format_conversations(turns.limit(0))).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = read_back(format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=200, deadline=None)
@given(st.text("\\<>lbg/turn \n", max_size=20))
def test_escapes_are_reversible(text):
    assert esc(text).replace("\\l", "<").replace("\\b", "\\") == text and "<" not in esc(text)


def test_query_has_the_added_conversation(spark, sf_dir):
    from weftline.llm.queries import op7_chat_format

    text = r"\### Assistant: </turn> ok"
    row = op7_chat_format(spark, sf_dir).where(F.col("conv_id") == -7).first()
    assert row.n_turns == 2 and row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
