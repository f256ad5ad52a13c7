"""Chat conversations as training windows under a token budget, with a loss mask."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.llm.common import col, placed, table

OPEN, SAYS, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings of this and of public templates; "<|" covers all that begin so.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Marks of a turn, counted as tokens.
MARKS = 4


def escape(text: Column) -> Column:
    r"""No control string is left: each has a backslash after its first character, each backslash is doubled."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: of two backslashes one stays, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def count_tokens(text: Column) -> Column:
    """Token measure: each begun run of four characters of a word."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]{1,4}"))


def windows(
    df: DataFrame, budget: int = 2048, history: int = 256, tokens: Callable[[Column], Column] = count_tokens,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Operator 11. Windows of whole turns: (id, part, tokens_before, n_repeated, n_tokens, over_budget, formatted, loss).

    Turns of a conversation are laid on a line by prefix sums of their tokens. What the budget
    leaves beside the system turn and the history (a quarter of it at least) is the room; the line
    is cut each half room, and a window takes the turns that begin in one cell. Turns of over half a
    room are windows of their own. So a window's own turns never exceed the room unless one turn
    does, and no turn depends on more than two sums: a conversation of any number of turns is cut in
    parallel. Each window is led by the first turn of role ``system``, once it has been said, and by
    the last turns of the window before, up to ``history`` tokens; these ``n_repeated`` turns are
    outside the loss mask. ``loss`` holds (start, end) of each own assistant text in ``formatted``,
    in code points, end exclusive. ``over_budget`` marks windows that one long turn or a long system
    turn drives beyond the budget. Rows of a conversation are in order of (tokens_before); ``part``
    splits a long conversation in that order into parts of bounded size.

    Defined cases: null texts and roles are empty; rows order by turn (null first), then role, then
    MD5 of the text; rows that repeat are turns of their own; a null id is a conversation; no turn is
    ever cut or dropped; an empty table gives an empty result; other columns are not read. Roles
    other than ``system`` and ``assistant`` are formatted as they are and never under the mask.
    """
    string = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    rows = df.select(col(id_col).alias("id"), col(turn_col).alias("turn"), string(role_col).alias("role"), string(text_col).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SAYS))
    said = rows.select(
        "id", "turn", "role", F.md5("text").alias("digest"), (tokens(F.col("text")) + MARKS).cast("bigint").alias("tokens"),
        F.length(head).cast("bigint").alias("head"), F.concat(head, escape(F.col("text")), F.lit(CLOSE)).alias("marked"),
    ).withColumn("chars", F.length("marked").cast("bigint"))
    line = table(placed(said, F.col("id"), [F.col("turn"), F.col("role"), F.col("digest")], ("tokens", "chars")), "turns")

    system = line.filter(F.col("role") == "system").groupBy("_group").agg(F.min("_pos").alias("_pos"))
    leads = line.join(system, ["_group", "_pos"]).select("_group", F.struct(F.col("_pos").alias("pos"), "tokens", "chars", "marked").alias("lead"))
    #: one row per conversation and range, so the turns of a long conversation do not meet at one key
    ranges = table(line.select("_group", "_part").distinct().join(leads, "_group", "left"), "ranges")

    turns = line.join(ranges.select("_group", "_part", F.coalesce("lead.tokens", F.lit(0)).alias("reserved")), ["_group", "_part"])
    room = F.greatest(F.lit(budget - history) - F.col("reserved"), F.lit(budget // 4))
    half = F.greatest(F.floor(room / 2), F.lit(1))
    a, b = F.col("_before_tokens"), F.col("_before_chars")
    cell = 2 * F.floor(a / half) + (F.col("tokens") > half).cast("bigint")
    spans = turns.groupBy("_group", cell.alias("cell")).agg(
        F.min(a).alias("at"), F.max(a + F.col("tokens")).alias("to"), F.min("_part").alias("_part"), F.first("id").alias("id"),
        F.array_sort(F.collect_list(F.struct(
            F.col("_pos").alias("pos"), a.alias("a"), b.alias("b"), "tokens", "head", "chars", (F.col("role") == "assistant").alias("target"), "marked"))).alias("turns"),
    )
    spans = table(spans, "spans")
    tails = spans.select("_group", F.col("to").alias("at"), F.filter("turns", lambda t: F.col("to") - t["a"] <= history).alias("tail"))
    joined = spans.join(tails, ["_group", "at"], "left").join(ranges, ["_group", "_part"], "left")
    joined = joined.withColumn("all", F.concat(F.coalesce("tail", F.slice("turns", 1, 0)), F.col("turns")))
    first = F.col("all")[0]
    led = F.coalesce(F.col("lead.pos") < first["pos"], F.lit(False))
    joined = joined.withColumn("shift", F.when(led, F.col("lead.chars")).otherwise(0) - first["b"]).withColumn("led", led)
    total = F.aggregate("all", F.lit(0).cast("bigint"), lambda s, t: s + t["tokens"]) + F.when(F.col("led"), F.col("lead.tokens")).otherwise(0)
    return joined.select(
        F.col("id").alias(id_col), F.col("_part").alias("part"), F.col("at").alias("tokens_before"),
        (F.coalesce(F.size("tail"), F.lit(0)) + F.col("led").cast("int")).alias("n_repeated"), total.alias("n_tokens"), (total > budget).alias("over_budget"),
        F.concat(F.when(F.col("led"), F.col("lead.marked")).otherwise(""), F.array_join(F.transform("all", lambda t: t["marked"]), "")).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["target"]), lambda t: F.struct(
            (F.col("shift") + t["b"] + t["head"]).alias("start"), (F.col("shift") + t["b"] + t["chars"] - len(CLOSE)).alias("end"))).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted window: array of (role, text), as they were before formatting."""
    parts = F.split(formatted, rf"\Q{CLOSE}\E")
    sides = lambda part: F.split(F.substr(part, F.lit(len(OPEN) + 1)), rf"\Q{SAYS}\E")
    pair = lambda s: F.struct(unescape(s[0]).alias("role"), unescape(s[1]).alias("text"))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.transform(F.array(sides(p)), pair)[0])


def digest(made: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the windows say, read back from them: one row per conversation.

    Ranges of a conversation are put together first and the conversation from them, so a long one
    meets in one task as a few rows. Its digest is still taken of one string: a conversation of
    more than 2 GB of text can be formatted but not digested.
    """
    turns = F.col("turns")
    under = F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    read = made.withColumn("turns", read_turns(F.col("formatted"))).select(
        F.struct(col(id_col).alias("id")).alias("key"), "part", "tokens_before", F.length("formatted").cast("bigint").alias("n_formatted"),
        (F.size(turns) - F.col("n_repeated")).cast("bigint").alias("n"),
        F.array_join(F.transform(F.slice(turns, F.col("n_repeated") + 1, F.size(turns)), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(under, "").alias("under"),
    )
    together = lambda order, name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name]), "").alias(name)
    totals = [F.sum("n").alias("n"), F.sum("n_formatted").alias("n_formatted")]
    parts = read.groupBy("key", "part").agg(together("tokens_before", "said"), together("tokens_before", "under"), *totals)
    whole = parts.groupBy("key").agg(together("part", "said"), together("part", "under"), *totals)
    return whole.select(
        F.col("key.id").alias(id_col), F.col("n").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"),
        F.length("under").cast("bigint").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.col("n_formatted").alias("formatted_chars"),
    )
