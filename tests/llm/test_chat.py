import hashlib

import pytest
from pyspark.sql import functions as F

from tallyvane.llm import chat
from tallyvane.llm.queries import CONTROL_TEXT, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, tokens string, id string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    """What reading back must give, by conversation, from the rows alone."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())
    for c in {r[0] for r in rows}:
        said = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        loss = "".join(t for role, t in said if role == "assistant")
        out[c] = (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)), len(loss), sha(loss))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def check(spark, rows, **kw):
    made = chat.windows(frame(spark, rows), **kw).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(made).collect()}
    assert got == plain(rows)
    return sorted(made.collect(), key=lambda r: (str(r.conv_id), r.tokens_before))


def test_escape_is_reversible(spark):
    texts = ["", "\\", "\\\\<|", "<|end|>", "<\\|end|>", CONTROL_TEXT, "<<SYS>> a <</SYS>>", "<<|turn|>", "[[INST]]", "<\\\\|x|>", "a\\</s>\\", "é<s>\n🙂"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("*", chat.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.u == r.t
        assert not any(c in r.e for c in (*chat.CONTROL, chat.OPEN, chat.SAYS, chat.CLOSE))


def test_odd_rows(spark):
    rows = [
        (1, 1, "user", "hi"), (1, 2, "assistant", "<|end|> \\ <|says|>"), (1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"), (1, None, "system", "first"), (2, 0, None, None), (2, 1, "assistant", ""),
        (None, 0, "user", "no id"), (None, 1, "assistant", "x" * 50_000), (3, 0, "tool<|says|>", "[/INST]\nend\n"), (4, 0, "assistant", "é" * 7 + " 🙂" * 3000),
    ]
    made = check(spark, rows)
    assert any(r.over_budget for r in made)
    empty = frame(spark, rows).limit(0)
    assert chat.digest(chat.windows(empty)).count() == 0


def test_windows_repeat_and_mask(spark):
    rows = [(5, 0, "system", "be brief " * 4)] + [(5, i, "assistant" if i % 2 == 0 else "user", f"turn {i} " + "word " * (i % 7 * 5)) for i in range(1, 80)]
    rows += [(6, 0, "user", "a"), (6, 1, "system", "late"), (6, 2, "assistant", "big " * 300), (6, 3, "user", "b"), (6, 4, "assistant", "c")]
    made = check(spark, rows, budget=256, history=48)
    five = [r for r in made if r.conv_id == 5]
    assert len(five) > 5
    for i, r in enumerate(five):
        assert r.n_tokens <= 256 and not r.over_budget
        assert r.formatted.startswith("<|turn|>system<|says|>be brief")
        assert (r.n_repeated >= 1) == (i > 0)
        for s in r.loss:
            assert r.formatted[: s.start].endswith("<|turn|>assistant<|says|>") and r.formatted[s.end :].startswith("<|end|>")
    spans = [r.formatted[s.start : s.end] for r in five for s in r.loss]
    assert spans == [t for _, _, role, t in rows[:80] if role == "assistant"]
    assert any(r.n_repeated > 1 for r in five)
    six = [r for r in made if r.conv_id == 6]
    assert six[0].formatted.startswith("<|turn|>user") and six[-1].formatted.startswith("<|turn|>system<|says|>late") and any(r.over_budget for r in six)


def test_long_conversation_is_dealt_over_ranges(spark):
    rows = [(1, i % 40, "assistant" if i % 2 else "user", f"{i} words here") for i in range(3000)] + [(k, 0, "user", "x") for k in range(2, 20)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = check(spark, rows, budget=128, history=16)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len({r.part for r in made if r.conv_id == 1}) > 2


def test_query_has_the_control_conversation_and_no_python(spark):
    df = QUERIES["op11_budgeted_windows"](spark, "/root/testdata/sf0.001")
    row = df.filter("conv_id = -7").first()
    assert row.n_turns == 2 and row.loss_chars == len(CONTROL_TEXT) and row.loss_sha256 == sha(CONTROL_TEXT)
    assert row.turns_sha256 == sha(f"user\n{CONTROL_TEXT}\nassistant\n{CONTROL_TEXT}\n")
    plan = df._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("budget,history", [(64, 0), (64, 64), (4000, 500)])
def test_any_budget(spark, budget, history):
    rows = [(c, t, ("user", "assistant")[t % 2], "w " * (c * t % 90)) for c in range(6) for t in range(30)]
    check(spark, rows, budget=budget, history=history)
