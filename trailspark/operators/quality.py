"""Integrity constraints of a prepared data set: each returns its violations as (name, key, detail) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.operators.split import field_audit


def rows_where(df: DataFrame, name: str, bad: Column, key: str | Column = "case_id", detail: Column | None = None) -> DataFrame:
    """Row-local constraints: metadata, system prompts, placeholders, lengths, FINAL, containment."""
    return df.where(F.coalesce(bad, F.lit(True))).select(F.lit(name).alias("name"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def counts(df: DataFrame, name: str, by: list[str], expected: dict[tuple, int]) -> DataFrame:
    """Row counts by group against what is expected, both ways."""
    spark = df.sparkSession
    label = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in by))
    found = df.groupBy(label.alias("key")).agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([("/".join("-" if x is None else str(x) for x in k), n) for k, n in expected.items()], "key string, wanted long")
    both = found.join(F.broadcast(wanted), "key", "left").unionByName(wanted.join(found, "key", "left_anti").select("key", F.lit(0).cast("long").alias("n"), "wanted"))
    return both.where(~F.col("n").eqNullSafe(F.coalesce("wanted", F.lit(0)))).select(F.lit(name).alias("name"), "key", F.concat_ws(" of ", F.col("n").cast("string"), F.coalesce("wanted", F.lit(0)).cast("string")).alias("detail"))


def same_ids(found: DataFrame, expected: DataFrame, name: str, key: str = "case_id") -> DataFrame:
    a, b = found.select(key).distinct(), expected.select(key).distinct()
    side = lambda x, y, word: x.join(y, key, "left_anti").select(F.lit(name).alias("name"), F.col(key).cast("string").alias("key"), F.lit(word).alias("detail"))
    return side(b, a, "missing").unionByName(side(a, b, "extra"))


def disjoint(parts: DataFrame, name: str, key: str = "case_id", part: str = "split") -> DataFrame:
    many = parts.groupBy(key).agg(F.array_sort(F.collect_set(part)).alias("ps")).where(F.size("ps") > 1)
    return many.select(F.lit(name).alias("name"), F.col(key).cast("string").alias("key"), F.array_join("ps", ",").alias("detail"))


def matched(left: DataFrame, right: DataFrame, name: str, fields: list[str], key: str = "case_id") -> DataFrame:
    return field_audit(left, right, key, fields).select(F.lit(name).alias("name"), F.col(key).cast("string").alias("key"), F.col("problem").alias("detail"))


def zipped(left: DataFrame, right: DataFrame, name: str, fields: list[str], position: str = "line") -> DataFrame:
    """Rows at the same place of two ordered tables: a row without a partner, or a field that differs, is a violation."""
    a = left.select(position, F.struct(*fields).alias("a"))
    b = right.select(F.col(position).alias("__at"), F.struct(*fields).alias("b"))
    both = a.join(b, F.col(position) == F.col("__at"), "full")
    gone = F.when(F.col("a").isNull(), "missing left").when(F.col("b").isNull(), "missing right")
    differ = F.filter(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields)), lambda x: x.isNotNull())
    problem = F.explode(F.when(gone.isNotNull(), F.array(gone)).otherwise(differ))
    return both.select(F.lit(name).alias("name"), F.coalesce(position, "__at").cast("string").alias("key"), problem.alias("detail"))


def artifacts(manifest: DataFrame, files: DataFrame, name: str = "artifact") -> DataFrame:
    """Manifest entries (path, sha256, bytes) against the files' own digests."""
    return matched(manifest, files, name, ["sha256", "bytes"], "path")


def pinned(sources: DataFrame, constants: dict[str, str], name: str = "source") -> DataFrame:
    wanted = sources.sparkSession.createDataFrame(list(constants.items()), "name string, sha256 string")
    return matched(sources, wanted, name, ["sha256"], "name")


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def tally(violations: DataFrame) -> DataFrame:
    return violations.groupBy("name").agg(F.count("*").alias("violations"))
