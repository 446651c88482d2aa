"""Preference formatting, in DataFrame operations only.

Two conversations are a pair: one chosen, one rejected.  The turns they share
from the start are the prompt, rendered once; each side's further turns are its
completion, in which only the assistant's words are trained on.

*Longest common prefix.*  Turns meet by (pair, turn) and are compared by their
role and text; the first turn that one side lacks, repeats or has otherwise is
where the pair diverges.  Both steps are partial aggregations over narrow rows,
so neither a long conversation nor a popular first turn is gathered for it.

*Pairs.*  A row holds a pair's prompt and both completions with their masks.
A pair of up to ``SEGMENT_TURNS`` turns is one row, however its turns are numbered.
A longer one takes a row for every so many turn numbers, in the order of
``segment``, so that no task gathers a whole long conversation; texts are shuffled once, by (pair, segment).  Turns repeated
more than ``SEGMENT_TURNS`` times are dealt to segments of their own.

Rendering is ``<|im_start|>role`` newline text ``<|im_end|>`` newline.  A mask lists
the characters ``[start, end)`` of its completion that carry loss: the text and
end marker of each assistant turn.

Defined cases: a null role renders as nothing but takes part in comparison, as
does a null text; a null turn sorts last, in the last segment; a conversation without its partner
has no prompt and is not ``paired``; two equal conversations are all prompt;
repeated turns end the prompt and are all rendered, by role and text; an empty
table gives no rows; texts of any length are rendered whole.  Rows with a null
conversation id are in no pair: each is a row of its own, a completion not
``paired``.  Only the columns named are read, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import BROADCAST_BYTES

LAST = (1 << 63) - 1
START, END = "<|im_start|>", "<|im_end|>"
#: Turns of one row, and copies of a turn before they are dealt to rows of their own.
SEGMENT_TURNS = 256


def by_parity(conv_id: str = "conv_id") -> tuple[Column, Column]:
    """The pairing of the driver's table: ids 2k (chosen) and 2k + 1 (rejected)."""
    return F.floor(F.col(conv_id) / 2).cast("long"), F.when(F.pmod(F.col(conv_id), F.lit(2)) == 1, "rejected").otherwise("chosen")


def _turns(turns: DataFrame, pair: Column, side: Column, turn: str, role: str, text: str) -> DataFrame:
    return turns.select(
        pair.alias("pair_id"), side.alias("side"), F.coalesce(F.col(turn), F.lit(LAST)).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )


def _met(rows: DataFrame) -> DataFrame:
    """(pair_id, turn) with the number of turns of each side and whether they are the same."""
    said = F.sha2(F.concat_ws("\0", F.coalesce(F.concat(F.lit("r"), "role"), F.lit("n")), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("n"))), 256)
    chosen, rejected = (F.count(F.when(F.col("side") == x, 1)) for x in ("chosen", "rejected"))
    met = rows.where("pair_id IS NOT NULL").groupBy("pair_id", "turn").agg(chosen.alias("c"), rejected.alias("r"), F.min(said).alias("least"), F.max(said).alias("most"))
    same = (F.col("c") == 1) & (F.col("r") == 1) & (F.col("least") == F.col("most"))
    return met.select("pair_id", "turn", "c", "r", same.alias("same"))


def _rendered(role: Column, text: Column) -> tuple[Column, Column]:
    header = F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"))
    return header, F.concat(header, F.coalesce(text, F.lit("")), F.lit(END + "\n"))


def pairs(turns: DataFrame, pair: Column, side: Column, *, turn: str = "turn", role: str = "role", text: str = "text", segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """pair_id, segment, part, prompt, chosen, rejected, chosen_mask, rejected_mask, paired: a row per pair, and more for long ones.

    ``part`` is 0, or counts the rows of a segment that repeated turns fill.
    """
    rows = _turns(turns, pair, side, turn, role, text)
    met = _met(rows)
    numbered = F.when(F.col("turn") < LAST, F.col("turn"))
    of_pair = met.groupBy("pair_id").agg(
        F.min(F.when(~F.col("same"), F.col("turn"))).alias("cut"), ((F.sum("c") > 0) & (F.sum("r") > 0)).alias("paired"), F.count("*").alias("n_turns"), F.max(numbered).alias("highest")
    )
    # a pair of few turns is one segment, however they are numbered; turns without a number go with the last
    long = of_pair.where(F.col("n_turns") > segment_turns).select("pair_id", "highest")
    rows_of, turns_of = rows.where("pair_id IS NOT NULL"), met.select("pair_id", "turn")
    segment = F.lit(0).cast("long")
    if n_long := long.count():
        long = F.broadcast(long) if 32 * n_long <= BROADCAST_BYTES else long
        rows_of, turns_of = (x.join(long, "pair_id", "left") for x in (rows_of, turns_of))
        low = "least(turn, highest)"
        whole = F.expr(f"({low} - pmod({low}, {segment_turns})) div {segment_turns}")  # without fractions, which lose digits
        segment = F.when(F.col("highest").isNotNull(), whole).otherwise(segment)
    known = turns_of.select("pair_id", segment.alias("segment")).distinct().join(of_pair.select("pair_id", "cut", "paired"), "pair_id")
    hot = met.where(F.col("c") + F.col("r") > segment_turns).select("pair_id", "turn", F.ceil((F.col("c") + F.col("r")) / segment_turns).alias("parts"))
    keyed = rows_of.withColumn("segment", segment).drop("highest").withColumn("part", F.lit(0).cast("long"))
    if n_hot := hot.count():  # a turn repeated so often is spread by its words and its input partition
        spread = F.pmod(F.xxhash64("role", "text", "here"), F.col("parts")) + 1
        hot = F.broadcast(hot) if 64 * n_hot <= BROADCAST_BYTES else hot  # beyond that, adaptive execution splits its keys
        placed = keyed.drop("part").withColumn("here", F.spark_partition_id()).join(hot, ["pair_id", "turn"], "left")
        keyed = placed.withColumn("part", F.coalesce(spread, F.lit(0).cast("long"))).drop("parts", "here")
    joined = keyed.join(known, ["pair_id", "segment"])
    shared = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    said = F.struct("turn", "role", "text")
    lists = joined.groupBy("pair_id", "segment", "part").agg(
        F.first("paired").alias("paired"),
        F.array_sort(F.collect_list(F.when(shared & (F.col("side") == "chosen"), said))).alias("p"),  # a shared turn is rendered once
        F.array_sort(F.collect_list(F.when(~shared & (F.col("side") == "chosen"), said))).alias("c"),
        F.array_sort(F.collect_list(F.when(~shared & (F.col("side") == "rejected"), said))).alias("r"),
    )
    nobody = rows.where("pair_id IS NULL").select(
        "pair_id", F.lit(0).cast("long").alias("segment"), F.lit(0).cast("long").alias("part"), F.lit(False).alias("paired"), F.array().cast("array<struct<turn:bigint,role:string,text:string>>").alias("p"),
        F.array(said).alias("c"), F.array().cast("array<struct<turn:bigint,role:string,text:string>>").alias("r"),
    )
    text_of = lambda c: F.array_join(F.transform(c, lambda m: _rendered(m["role"], m["text"])[1]), "")

    def mask(c: str) -> Column:
        spans = F.array().cast("array<struct<start:int,end:int>>")

        def add(state: Column, m: Column) -> Column:
            header, rendered = _rendered(m["role"], m["text"])
            span = F.struct((state["at"] + F.length(header)).alias("start"), (state["at"] + F.length(rendered) - 1).alias("end"))
            trains = m["role"].eqNullSafe(F.lit("assistant"))
            return F.struct((state["at"] + F.length(rendered)).alias("at"), F.when(trains, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(c, F.struct(F.lit(0).alias("at"), spans.alias("spans")), add)["spans"]

    return lists.unionByName(nobody).select(
        "pair_id", "segment", "part", text_of("p").alias("prompt"), text_of("c").alias("chosen"), text_of("r").alias("rejected"), mask("c").alias("chosen_mask"), mask("r").alias("rejected_mask"), "paired"
    )
