"""Preference pairs as one prompt and two masked completions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, kind_of, orderable, shuffle_partitions

OPEN, CLOSE = "<|", "|>"


#: At most so many ranges of conversation ids, and so many ids sampled for each.
RANGES, SAMPLES = 1 << 14, 8
#: Where a turn without a number goes: before all others.
FIRST = -(1 << 63)


def turn_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) of each turn: a null role is a user's, a null text is empty, a null turn comes first.

    Conversations of integral ids are ordered by them, all others by their ids as strings;
    rows of a null conversation are left out.
    """
    rows = conversations.select(orderable(conversations, conv_col).alias("conv_id"), F.coalesce(col(turn_col).cast("bigint"), F.lit(FIRST)).alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit("user")).alias("role"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.where("conv_id IS NOT NULL")


def _starts(rows: DataFrame, per_range: int) -> list:
    """Ids that begin the ranges but the first, in order: every SAMPLES-th of those that a hash picks, at most RANGES of them."""
    ids = rows.select("conv_id").distinct()
    n = ids.count()
    ranges = min(RANGES, max(1, n // per_range))
    every = max(1, n // (ranges * SAMPLES))
    # About ranges * SAMPLES ids, so the bound on what is sent to the driver doesn't grow with them.
    picked = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).collect())
    return picked[SAMPLES::SAMPLES]


def _range_of(key: Column, starts: Column, n: int) -> Column:
    """The number of starts (sorted, n of them) that are not beyond key, by binary search."""
    ends = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        before = F.element_at(starts, middle + 1) <= key
        return (
            F.when(acc["low"] >= acc["high"], acc)
            .when(before, F.struct((middle + 1).alias("low"), acc["high"].alias("high")))
            .otherwise(F.struct(acc["low"].alias("low"), middle.alias("high")))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), ends, step)["low"]


def spliced_pairs(conversations: DataFrame, per_range: int = 256) -> DataFrame:
    """(pair_id, chosen, rejected): a preference pair of each conversation but the last.

    chosen is the conversation; rejected has its first half (rounded up) and goes on as the
    next conversation there is, in the order of ids, does from there.

    Texts are shuffled once, by ranges of ids: the first conversation of a range, which is
    the next one to the last of the range before, goes to both, and within a range the next one is
    found by a window.  Ranges begin at ids that a hash of them picks, so they are even
    whatever the ids are, with about per_range conversations each until there are RANGES.

    Rows of a null conversation are left out; repeated rows count once; ties of turn are
    ordered by role and text; a null turn comes first; one conversation or none gives no rows;
    other columns are ignored, whatever their names.
    """
    rows = turn_rows(conversations)
    found = _starts(rows, per_range)
    home = F.lit(0)
    rows = rows.withColumn("also", F.lit(None).cast("int"))
    if found:
        starts = F.from_json(F.lit(json.dumps(found)), f"array<{kind_of(rows, 'conv_id')}>")
        home = _range_of(F.col("conv_id"), starts, len(found))
        rows = rows.withColumn("also", F.when(F.element_at(starts, F.greatest(home, F.lit(1))) == F.col("conv_id"), home - 1))
    rows = rows.withColumn("home", home)
    placed = rows.withColumn("range", F.explode(F.array_compact(F.array("home", "also")))).drop("also")
    spread = placed.repartition(max(1, min(2 * shuffle_partitions(rows), len(found) + 1)), "range")
    turns = spread.groupBy("range", "conv_id", "home").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    turns = turns.withColumn("others", F.lead("turns").over(Window.partitionBy("range").orderBy("conv_id"))).where("range = home AND others IS NOT NULL")
    half = F.ceil(F.size("turns") / 2).cast("int")
    rejected = F.concat(F.slice("turns", 1, half), F.slice("others", half + 1, F.size("others")))
    return turns.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def _rendered(turns: Column) -> Column:
    """Each turn as the template has it; markers inside of texts and roles are defused."""
    safe = lambda x: F.replace(x, F.lit(OPEN), F.lit("<\\|"))
    return F.transform(turns, lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit(CLOSE + "\n"), safe(t["text"]), F.lit("<|end|>\n")))


def _spans(turns: Column, rendered: Column, loss_role: str) -> Column:
    """The loss-bearing parts of joined turns as "start-end" in characters, joined by commas."""
    sizes = F.transform(F.arrays_zip(turns.alias("t"), rendered.alias("r")), lambda z: F.struct(F.length(z["r"]).alias("n"), F.length(F.replace(z["t"]["role"], F.lit(OPEN), F.lit("<\\|"))).alias("head"), (z["t"]["role"] == loss_role).alias("loss")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at, end = acc["at"], acc["at"] + x["n"]
        span = F.concat((at + x["head"] + 5).cast("string"), F.lit("-"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(x["loss"], F.concat(acc["out"], F.when(acc["out"] == "", "").otherwise(","), span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def format_preferences(pairs: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(pair_id, prefix_turns, prompt, chosen, chosen_loss, rejected, rejected_loss) of each pair; pair_id is kept as it is.

    The longest common prefix of turns (role and text alike) is rendered once, as prompt;
    what is left of either conversation is its completion.  A turn is rendered as
    "<|role|>\\n text <|end|>\\n" without the spaces; "<|" inside of a text or role becomes
    "<\\|", so texts can't forge turns.  The loss columns list the spans of a completion,
    in characters, that bear loss: texts of loss_role with the end marker; all else is
    masked.

    Turns are compared in place of Python by array functions, so one shuffle gathers the
    turns and there is none here.  Equal conversations, or one that is a prefix of the
    other, give empty completions with no spans.  A null or empty conversation has no
    turns; a null role is a user's and a null text is empty; repeated pairs give repeated
    rows; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    clean = lambda c: F.transform(F.coalesce(col(c), F.array().cast("array<struct<turn:bigint,role:string,text:string>>")), lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = pairs.select(col("pair_id").alias("pair_id"), clean("chosen").alias("a"), clean("rejected").alias("b"))
    shorter = F.least(F.size("a"), F.size("b"))
    same = F.transform(F.arrays_zip(F.slice("a", 1, shorter).alias("x"), F.slice("b", 1, shorter).alias("y")), lambda z: z["x"] == z["y"])
    first = F.array_position(same, False)
    rows = rows.withColumn("k", F.when(first > 0, first - 1).otherwise(shorter).cast("int"))
    rows = rows.withColumns({"p": F.slice("a", 1, F.col("k")), "a": F.slice("a", F.col("k") + 1, F.size("a")), "b": F.slice("b", F.col("k") + 1, F.size("b"))})
    rows = rows.withColumns({"ra": _rendered(F.col("a")), "rb": _rendered(F.col("b"))})
    return rows.select(
        "pair_id",
        F.col("k").cast("bigint").alias("prefix_turns"),
        F.array_join(_rendered(F.col("p")), "").alias("prompt"),
        F.array_join("ra", "").alias("chosen"),
        _spans(F.col("a"), F.col("ra"), loss_role).alias("chosen_loss"),
        F.array_join("rb", "").alias("rejected"),
        _spans(F.col("b"), F.col("rb"), loss_role).alias("rejected_loss"),
    )


def _sql_side(name: str) -> str:
    rendered = f"list_transform({name}, lambda t: '<|' || replace(t.role, '<|', '<\\|') || '|>' || chr(10) || replace(t.txt, '<|', '<\\|') || '<|end|>' || chr(10))"
    return f"""array_to_string({rendered}, '') AS {name}_text,
  array_to_string(list_filter(list_transform({name}, lambda t, i: CASE WHEN t.role = 'assistant' THEN
    (coalesce(list_sum(list_transform({rendered}[1:i - 1], lambda s: length(s))), 0)::BIGINT + length(t.role) + 5)::VARCHAR || '-' ||
    (coalesce(list_sum(list_transform({rendered}[1:i], lambda s: length(s))), 0)::BIGINT - 1)::VARCHAR END), lambda s: s IS NOT NULL), ',') AS {name}_loss"""


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'txt': txt}} ORDER BY turn NULLS FIRST, role, txt) AS turns FROM t GROUP BY conv_id),
n AS (SELECT conv_id, lead(conv_id) OVER (ORDER BY conv_id) AS after FROM c),
p AS (SELECT x.conv_id AS pair_id, x.turns AS a, list_concat(x.turns[1:(len(x.turns) + 1) // 2], y.turns[(len(x.turns) + 1) // 2 + 1:]) AS b
  FROM c x JOIN n ON n.conv_id = x.conv_id JOIN c y ON y.conv_id = n.after),
k AS (SELECT *, least(len(a), len(b)) AS shorter FROM p),
f AS (SELECT *, coalesce(list_position(list_transform(range(1, shorter + 1), lambda i: a[i] = b[i]), false) - 1, shorter)::BIGINT AS k0 FROM k),
g AS (SELECT *, CASE WHEN k0 < 0 THEN shorter ELSE k0 END AS k FROM f),
s AS (SELECT pair_id, k AS prefix_turns, a[1:k] AS prompt, a[k + 1:] AS chosen, b[k + 1:] AS rejected FROM g),
r AS (SELECT pair_id, prefix_turns, {_sql_side("prompt")}, {_sql_side("chosen")}, {_sql_side("rejected")} FROM s)
SELECT pair_id, prefix_turns::BIGINT AS prefix_turns, prompt_text AS prompt, chosen_text AS chosen, chosen_loss, rejected_text AS rejected, rejected_loss FROM r"""
