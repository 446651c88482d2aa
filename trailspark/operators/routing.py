"""Training rows: group advantages, and the pieces of label masks over token arrays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_advantage(rows: DataFrame, group: list[str], reward: str) -> DataFrame:
    """Reward less the group's mean; groups without spread are dropped.

    Groups are summed before they are shuffled and joined back, so a group of any
    size is in no one task: adaptive execution splits it.
    """
    keys = [f"__{g}" for g in group]
    found = rows.groupBy(*(F.col(g).alias(k) for g, k in zip(group, keys, strict=True))).agg(F.avg(reward).alias("__mean"), (F.max(reward) != F.min(reward)).alias("__spread"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)])
    return rows.join(found.where("__spread"), same).withColumn("advantage", F.col(reward) - F.col("__mean")).drop(*keys, "__mean", "__spread")


def code_points(text: Column) -> Column:
    """The tokenizer of the tests: one token a character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` computed once however often ``f`` names it, also inside of lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def find_subsequence(values: Column, target: Column) -> Column:
    """0-based place of the first match; null if there is none or nothing to find.

    Equal arrays need no search.  Others are searched as delimited text: one linear
    search, and the delimiters before the match count the place.
    """
    text = lambda xs: F.concat(F.lit(","), F.array_join(xs.cast("array<string>"), ","), F.lit(","))
    commas = lambda before: F.length(before) - F.length(F.replace(before, F.lit(","))) - 1
    placed = lambda hay: let(F.instr(hay, text(target)), lambda at: F.when(at > 0, let(F.left(hay, at), commas)))
    return F.when(F.size(target) > 0, F.when(values == target, 0).otherwise(let(text(values), placed)))


def overlapping(offsets: Column, start: Column, end: Column) -> Column:
    """Which half-open token spans meet the label's."""
    return F.transform(offsets, lambda o: (o["end"] > start) & (o["start"] < end))


def drop_truncated(rows: DataFrame, truncated: str = "truncated") -> DataFrame:
    return rows.where(~F.coalesce(F.col(truncated), F.lit(False)))
