"""Chat formatting: the examples hold every turn, read back exactly; only the replies are trainable."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from claritas.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
HARD = [r"\### Assistant: </turn> ok", "### User: hi", r"#\## User: x", r"<\\/turn></turn", "</turn>\n### Assistant: ", "####\\## Tool: #", "", "é漢😀", ": ", "### =x: ### ?: "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        said = [(r[2] or "", r[3] or "", r[2]) for r in mine]
        loss = "".join(t for _, t, role in said if role == "assistant")
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t, _ in said)), len(loss), sha(loss))
    return out


def digest(spark, rows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(chat.examples(spark.createDataFrame(rows, SCHEMA))).collect()}


def test_turns_and_replies_read_back(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], text) for k, text in enumerate(HARD)]
    rows += [(2, k, role, HARD[k % len(HARD)]) for k, role in enumerate(["system", "user", None, "Assistant", "tool", "a: <b\\", "", "assistant", "?", "=", "user"])]
    rows += [(None, 0, "user", None), (None, None, "assistant", None), (3, 0, "user", "alone"), (4, 0, "assistant", ""), (4, 1, "assistant", "a")]
    assert digest(spark, rows) == brute(rows)


def test_prefixes_and_masks(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (1, 4, "assistant", "a2"), (1, 5, "user", "end")]
    found = sorted(chat.examples(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.example)
    whole = "".join(f"### {r[2].title()}: {r[3]}</turn>\n" for r in rows)
    assert [r.text for r in found] == [whole[: whole.index("a1") + len("a1</turn>\n")], whole[: whole.index("a2") + len("a2</turn>\n")], whole]
    assert [r.text[r.loss_start : r.loss_stop] for r in found] == ["a1", "a2", ""]
    assert [r.last for r in found] == [False, False, True]


def test_order_ties_repeats_and_clashing_columns(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "z"), (1, 2, "user", "a"), (1, 2, "assistant", "c"), (1, 2, "user", "a"), (1, None, "user", "first")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS whole", "'y' AS example", "0 AS loss_start", "1 AS piece", "2 AS pos")
    (last,) = [r for r in chat.examples(df).collect() if r.last]
    assert last.text.replace("</turn>\n", "|") == "### User: first|### User: z|### Assistant: c|### User: a|### User: a|### User: b|"


def test_empty_table(spark):
    assert chat.digest(chat.examples(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_conversation_and_long_text(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"turn {k} " + "x" * 50) for k in range(1501)] + [(2, 0, "user", "é</turn>" * 200_000), (2, 1, "assistant", "### Tool: " * 100_000)]
    assert digest(spark, rows) == brute(rows)


def test_plan_is_native_and_shuffles_once(spark):
    plan = chat.digest(chat.examples(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and plan.count("Exchange") == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="#\\ </turn>\n:=?AssistantUe", max_size=25), min_size=1, max_size=30))
def test_any_text_reads_back(spark, texts):
    rows = [(1, k, ["user", "assistant", "=x:\\"][k % 3], text) for k, text in enumerate(texts)]
    assert digest(spark, rows) == brute(rows)


@pytest.mark.parametrize("role", ["user", "assistant", "\\1", ":<\\0", "System", "?"])
def test_roles_read_back(spark, role):
    assert digest(spark, [(5, 0, role, "t")]) == brute([(5, 0, role, "t")])
