"""Seeded order, slices, quotas, set algebra and paired audits of task tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.session import cut


def seeded_key(seed: int, task_id: str, prompt: str) -> Column:
    """Hash that orders tasks the same way on every machine."""
    return F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(task_id).cast("string"), F.lit("\0"), F.col(prompt)), 256)


def seeded_top(tasks: DataFrame, n: int, *, seed: int = 42, task_id: str = "task_id", prompt: str = "prompt") -> DataFrame:
    """The first ``n`` tasks in seeded order with their ``position``.

    The top-n runs on ids and keys; each task keeps ``n`` candidates, so no
    global sort.  Texts are joined back afterwards.
    """
    top = tasks.select(task_id, seeded_key(seed, task_id, prompt).alias("key")).orderBy("key", task_id).limit(n)
    placed = top.withColumn("position", F.row_number().over(Window.orderBy("key", task_id)))  # n rows
    return tasks.join(placed.drop("key"), task_id)


def three_way_split(tasks: DataFrame, n_first: int, n_second: int, *, seed: int = 42, task_id: str = "task_id", prompt: str = "prompt") -> DataFrame:
    """(task, part): the first and next tasks in seeded order, and the rest."""
    placed = seeded_top(tasks.select(task_id, prompt), n_first + n_second, seed=seed, task_id=task_id, prompt=prompt).select(task_id, "position")
    part = F.when(F.col("position") <= n_first, "first").when(F.col("position").isNotNull(), "second").otherwise("rest")
    return tasks.select(task_id).join(placed, task_id, "left").select(task_id, part.alias("part"))


def quota_fill(tasks: DataFrame, n_deep: int, n_shallow: int, *, key: str = "key", task_id: str = "task_id", deep_ok: str = "deep_ok", shallow_ok: str = "shallow_ok") -> DataFrame:
    """(task, tier, position, mode): the first deep tasks, then the first shallow ones of those left; modes alternate."""
    order = [key, task_id]
    deep = tasks.where(deep_ok).orderBy(*order).limit(n_deep).select(task_id, *([key] if key != task_id else []), F.lit("deep").alias("tier"))
    left = tasks.where(shallow_ok).join(deep.select(task_id), task_id, "left_anti")
    shallow = left.orderBy(*order).limit(n_shallow).select(task_id, *([key] if key != task_id else []), F.lit("shallow").alias("tier"))
    placed = deep.unionByName(shallow).withColumn("position", F.row_number().over(Window.partitionBy("tier").orderBy(*order)))
    return placed.select(task_id, "tier", "position", F.when((F.col("position") - 1) % 2 == 0, "shadow").otherwise("visible").alias("mode"))


def lazy_quota_fill(tasks: DataFrame, n_deep: int, n_shallow: int, attempt: Callable[[DataFrame, bool], DataFrame], *, key: str = "key", task_id: str = "task_id", least: int = 8) -> DataFrame:
    """``quota_fill`` where it is costly to know which tasks fit: they are tried in waves, in the order of (key, task), until both quotas are full.

    ``attempt(wave, deep)`` gives (task, deep_ok, shallow_ok) of the wave's tasks;
    ``deep`` says whether deep ones are still wanted.  A wave has as many tasks as
    places are left, ``least`` at least, so no task after the wave of the last one
    taken is tried.  A wave is the next rows by a limit, not a sort of all tasks.
    """
    order, taken = [key, task_id], []
    have = {"deep": 0, "shallow": 0}
    after = None
    while (wanted := n_deep + n_shallow - sum(have.values())) > 0:
        rest = tasks if after is None else tasks.where((F.col(key) > after[0]) | (F.col(key) == after[0]) & (F.col(task_id) > after[1]))
        wave = cut(rest.orderBy(*order).limit(max(least, wanted)))
        last = wave.orderBy(*(F.desc(c) for c in order)).select(*order).first()
        if last is None:
            break
        found = attempt(wave, have["deep"] < n_deep)
        tried = wave.select(*order).join(found.select(task_id, "deep_ok", "shallow_ok"), task_id)
        # what a tier has from before moves its positions on
        moved = F.col("position") + F.create_map(*(F.lit(x) for kv in have.items() for x in kv))[F.col("tier")]
        got = quota_fill(tried, n_deep - have["deep"], n_shallow - have["shallow"], key=key, task_id=task_id).withColumn("position", moved)
        taken.append(cut(got.withColumn("mode", F.when((F.col("position") - 1) % 2 == 0, "shadow").otherwise("visible"))))
        for r in taken[-1].groupBy("tier").agg(F.count("*").alias("n")).collect():
            have[r.tier] += r.n
        after = tuple(last)
    if taken:
        return reduce(DataFrame.unionByName, taken)
    none = tasks.limit(0).select(*order, F.lit(False).alias("deep_ok"), F.lit(False).alias("shallow_ok"))
    return quota_fill(none, 0, 0, key=key, task_id=task_id)


def id_violations(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """(a, b, shared, only_a, only_b) of each pair of id tables, in one pass over all."""
    marked = reduce(DataFrame.unionByName, [df.select(F.col(column).alias("id"), F.lit(name).alias("t")) for name, df in tables.items()])
    sets = marked.groupBy("id").agg(F.collect_set("t").alias("ts"))  # at most one entry a table
    has = lambda n: F.array_contains("ts", n)
    pairs = [(a, b) for i, a in enumerate(tables) for b in list(tables)[i + 1 :]]
    sums = [x for a, b in pairs for x in (F.count_if(has(a) & has(b)), F.count_if(has(a) & ~has(b)), F.count_if(~has(a) & has(b)))]
    one = sets.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *(F.col(f"s{3 * i + j}").alias(n) for j, n in enumerate(("shared", "only_a", "only_b")))) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def repeated_ids(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def field_audit(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem): keys on one side only, and fields that differ (null equals null)."""
    a, b = left.select(key, *fields).alias("a"), right.select(key, *fields).alias("b")
    there = [F.col(f"{s}.__there") for s in ("a", "b")]
    both = a.withColumn("__there", F.lit(True)).alias("a").join(b.withColumn("__there", F.lit(True)).alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    differing = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields)))
    problem = F.when(there[0].isNull(), F.array(F.lit("missing left"))).when(there[1].isNull(), F.array(F.lit("missing right"))).otherwise(differing)
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(problem).alias("problem"))


def last_by(df: DataFrame, keys: list[str], order: Column, value: str) -> DataFrame:
    """The last value of each key: an aggregate, so partial results combine before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))
