"""Preference formatting of chosen and rejected conversations (DataFrame functions only).

Both sides of a pair are tables of turns. The longest common prefix of turns is rendered once, as
the prompt; what follows it on either side is that side's completion, and both completions stand
side by side in one row a position. Only the assistant's turns in a completion are trained on: of each,
the text and the end mark.

Texts are shuffled by conversation and bucket of TURN_BUCKET turns, once a side, and stay there; what
a bucket must know of the others of its conversation (turns and characters before it, where the
prefix ends) is worked out from one small row a bucket. So a conversation of any length is never
collected into one row or one task.

Defined results: turns are ordered by turn number (null first), role and text; rows that repeat
a whole turn count once; a null role is rendered as "user", a null text as empty, yet a null and
an empty text are different turns; a side without turns has an empty completion; equal sides have
all in the prompt and no completion; rows with a null pair_id form a pair of their own. Columns
other than pair_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN_BUCKET = 1024


KEYS = ["_none", "_pair", "_bucket"]


def _keyed(rows: DataFrame, bucket: Column, *columns) -> DataFrame:
    none = F.col("pair_id").isNull()
    return rows.select(none.alias("_none"), F.coalesce("pair_id", F.lit(0).cast("long")).alias("_pair"), bucket.alias("_bucket"), *columns)


def _before(value: str) -> Column:
    """The sum of ``value`` over the buckets of a conversation before this one."""
    w = Window.partitionBy("_none", "_pair").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))


def positions(turns: DataFrame) -> DataFrame:
    """pair_id, pos, role, text: the turns of each conversation, numbered from 0."""
    bucket = F.coalesce(F.floor(F.col("turn") / TURN_BUCKET), F.lit(-(2**60)).cast("long"))
    one = _keyed(turns, bucket, "turn", "role", "text").repartition(*KEYS).distinct()
    before = one.groupBy(*KEYS).agg(F.count("*").alias("n")).select(*KEYS, _before("n").alias("_before"))
    order = Window.partitionBy(*KEYS).orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    out = one.withColumn("_row", F.row_number().over(order)).join(before, KEYS)
    return out.select(F.when(~F.col("_none"), F.col("_pair")).alias("pair_id"), (F.col("_before") + F.col("_row") - 1).alias("pos"), "role", "text")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE + "\n"))


def _head(role: Column) -> Column:
    return F.length(F.concat(F.lit(OPEN), F.coalesce(role, F.lit("user")), F.lit("\n")))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each pair and position of numbered turns (``positions``) of both sides: pair_id, pos;

    in the common prefix prompt, its rendered turn, and prompt_start, its first character in the whole
    prompt; after it chosen and rejected, either side's rendered turn (null where a side has ended),
    with chosen_start, chosen_mask_start, chosen_mask_end (and rejected_ likewise): its first character and
    the trained characters in that side's whole completion (null where there are none). A part's
    text is its column's values in the order of pos."""
    bucket = F.floor(F.col("pos") / TURN_BUCKET)
    turn, nothing = F.struct("role", "text"), F.lit(None).cast("struct<role:string,text:string>")
    sides = _keyed(chosen, bucket, "pos", turn.alias("a"), nothing.alias("b")).unionByName(_keyed(rejected, bucket, "pos", nothing.alias("a"), turn.alias("b")))
    both = sides.repartition(*KEYS).groupBy(*KEYS, "pos").agg(F.first("a", ignorenulls=True).alias("a"), F.first("b", ignorenulls=True).alias("b"))
    size = lambda x: F.when(F.col(x).isNotNull(), F.length(render(F.col(f"{x}.role"), F.col(f"{x}.text")))).otherwise(0).cast("long")
    w = Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sum_ = lambda x: F.coalesce(F.sum(size(x)).over(w), F.lit(0).cast("long"))
    laid = both.select("*", size("a").alias("la"), size("b").alias("lb"), sum_("a").alias("ca"), sum_("b").alias("cb"), (~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))
    # one row a bucket: its characters, and its first difference; the prefix is as long on both sides
    per = laid.groupBy(*KEYS).agg(F.sum("la").alias("sa"), F.sum("lb").alias("sb"), F.min(F.when(F.col("differs"), F.struct("pos", "ca"))).alias("d"))
    per = per.select(*KEYS, _before("sa").alias("_a"), _before("sb").alias("_b"), F.col("d.pos").alias("d"), F.col("d.ca").alias("dc"))
    first = F.min(F.struct(F.col("d").isNull(), "d", (F.col("_a") + F.col("dc")).alias("chars"))).over(Window.partitionBy("_none", "_pair"))
    per = per.select(*KEYS, "_a", "_b", first.alias("_end")).select(*KEYS, "_a", "_b", F.col("_end.d").alias("_end"), F.col("_end.chars").alias("_chars"))
    found = laid.join(per, KEYS)
    common_ = F.col("_end").isNull() | (F.col("pos") < F.col("_end"))

    def side(x: str, name: str) -> list[Column]:
        there = ~common_ & F.col(x).isNotNull()
        start = F.col(f"_{x}") + F.col(f"c{x}") - F.col("_chars")
        train = there & F.coalesce(F.col(f"{x}.role") == "assistant", F.lit(False))
        return [
            F.when(there, render(F.col(f"{x}.role"), F.col(f"{x}.text"))).alias(name), F.when(there, start).alias(f"{name}_start"),
            F.when(train, start + _head(F.col(f"{x}.role"))).alias(f"{name}_mask_start"), F.when(train, start + F.col(f"l{x}") - 1).alias(f"{name}_mask_end"),
        ]

    return found.select(
        F.when(~F.col("_none"), F.col("_pair")).alias("pair_id"), "pos", F.when(common_, render(F.col("a.role"), F.col("a.text"))).alias("prompt"),
        F.when(common_, F.col("_a") + F.col("ca")).alias("prompt_start"), *side("a", "chosen"), *side("b", "rejected"),
    )


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Makes a rejected side for numbered ``turns``: the conversation up to its last assistant turn,
    which is replaced by the last assistant turn of the conversation with the next id (an empty one
    where there is none); what follows it is left out. Without an assistant turn it is unchanged."""
    last = turns.where("role = 'assistant' AND pair_id IS NOT NULL").groupBy("pair_id").agg(F.max(F.struct("pos", "text")).alias("last"))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("last.text").alias("_other"))
    ends = last.select("pair_id", F.col("last.pos").alias("_last")).join(other, "pair_id", "left")
    text = F.when(F.col("pos") == F.col("_last"), F.coalesce("_other", F.lit(""))).otherwise(F.col("text"))
    return turns.join(ends, "pair_id", "left").where("_last IS NULL OR pos <= _last").select("pair_id", "pos", "role", text.alias("text"))
