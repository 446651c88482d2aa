"""JSON Lines with line numbers, presence-aware fields, documents, digests, writers."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspark.sources import ordered


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the lines that are not blank, numbered from 1 in each file.

    A file is read in splits: the lines of each are counted first, and a line's
    number is its place in its split after the lines of the splits before.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row a split
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    placed = splits.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = rows.join(F.broadcast(placed), ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))
    return numbered.where(F.trim("value") != "")


def read_jsonl(spark: SparkSession, path: str, *, require_rows: bool = False) -> DataFrame:
    """(line, row variant); a line that is not a JSON object fails with its place."""
    lines = read_lines(spark, path)
    if require_rows and lines.isEmpty():
        raise ValueError(f"no traces in {path}")
    row = F.try_parse_json("value")
    is_object = F.coalesce(F.schema_of_variant(row).startswith("OBJECT"), F.lit(False))
    failed = F.raise_error(F.concat(F.lit(f"{path}:"), F.col("line").cast("string"), F.lit(": expected a JSON object")))
    return lines.select("line", F.when(is_object, row).otherwise(failed.cast("variant")).alias("row"))


def read_tasks(spark: SparkSession, path: str, limit: int | None = None, *, split_bytes: int = ordered.SPLIT_BYTES) -> DataFrame:
    """Task rows with their place ``idx`` and defaults, the first ``limit`` of them or all; a row without its required fields fails.

    Only the splits that hold the first rows are read, and each numbers its own.
    """
    fields = "arm string, blueprint_root string, case_id string, prompt array<struct<role:string,content:string>>, source string, split string, task_id long, test_code string, trace_prefix string"
    rows = ordered.first_lines(spark, path, limit, split_bytes=split_bytes).withColumn("t", F.from_json("value", fields))
    needed = F.col("t.case_id").isNotNull() & F.col("t.prompt").isNotNull() & F.col("t.blueprint_root").isNotNull() & F.col("t.test_code").isNotNull()
    failed = F.raise_error(F.concat(F.lit(f"{path}:"), F.col("line").cast("string"), F.lit(": missing fields")))
    return rows.select(
        F.when(needed, F.col("t.case_id")).otherwise(failed.cast("string")).alias("case_id"), F.col("idx").cast("int").alias("idx"), F.coalesce("t.arm", F.lit("a")).alias("arm"),
        F.coalesce("t.source", F.lit("mbpp")).alias("source"), F.coalesce("t.task_id", "idx").alias("source_task_id"), "t.prompt", "t.blueprint_root",
        F.coalesce(F.nullif("t.trace_prefix", F.lit("")), "t.blueprint_root").alias("trace_prefix"), "t.test_code", "t.split",
    )


def present(row: Column, path: str) -> Column:
    """Whether a field is there, even if null."""
    return F.try_variant_get(row, path, "variant").isNotNull()


def number(row: Column, path: str) -> Column:
    """A number, with true as 1; null for anything else."""
    return F.coalesce(F.try_variant_get(row, path, "double"), F.try_variant_get(row, path, "boolean").cast("double"))


def passes(row: Column) -> Column:
    """Solved: by metrics.passed if there, else reward if there, else the task reward; null counts as 0."""
    value = F.when(present(row, "$.metrics.passed"), number(row, "$.metrics.passed")).when(present(row, "$.reward"), number(row, "$.reward")).otherwise(number(row, "$.rewards.mbpp_reward"))
    return F.coalesce(value, F.lit(0.0)) > 0


def task_id(row: Column, line: Column) -> Column:
    """The first of case_id, idx, the row's own task_id and the line number that is there."""
    text = lambda p: F.try_variant_get(row, p, "string")
    return (
        F.when(present(row, "$.task.data.case_id"), text("$.task.data.case_id")).when(present(row, "$.task.data.idx"), text("$.task.data.idx"))
        .when(present(row, "$.task_id"), text("$.task_id")).otherwise(line.cast("string"))
    )


STATE = (
    "calls array<struct<tool:string,id:string>>, results map<string,struct<success:boolean,outcome:string>>, "
    "prediction_targets array<struct<sampled_prediction:string,actual:string,decision:string>>"
)


def state(row: Column) -> Column:
    """The runtime record: the first object with calls under info, else at the top, whatever its name."""
    inside = lambda part: F.map_values(F.from_json(F.to_json(part), "map<string,variant>"))
    holds = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & F.try_variant_get(v, "$.calls", "variant").isNotNull()
    first = lambda part: F.to_json(F.get(F.filter(inside(part), holds), F.lit(0)))
    return F.from_json(F.coalesce(first(F.try_variant_get(row, "$.info", "variant")), first(row)), STATE)


def token_count(row: Column) -> Column:
    """Tokens of a trace: its own total, else all nodes' ids, else the usage; null if none is known."""
    nodes = F.from_json(F.to_json(F.try_variant_get(row, "$.nodes", "variant")), "array<struct<token_ids:array<int>>>")
    listed = F.when((F.size(nodes) > 0) & F.forall(nodes, lambda n: n["token_ids"].isNotNull()), F.aggregate(nodes, F.lit(0).cast("long"), lambda a, n: a + F.size(n["token_ids"])))
    usage = F.coalesce(F.try_variant_get(row, "$.usage.prompt_tokens", "long"), F.lit(0)) + F.coalesce(F.try_variant_get(row, "$.usage.completion_tokens", "long"), F.lit(0))
    own = F.when(F.schema_of_variant(F.try_variant_get(row, "$.num_total_tokens", "variant")) == "BIGINT", F.try_variant_get(row, "$.num_total_tokens", "long"))
    return F.coalesce(own, F.when(listed > 0, listed), F.when(usage > 0, usage))


def load_traces(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation traces: task, solved, calls, results, targets, n_tokens."""
    rows = read_jsonl(spark, path, require_rows=True)
    r, s = F.col("row"), state(F.col("row"))
    return rows.select(
        task_id(r, F.col("line")).alias("task"), passes(r).alias("solved"), F.coalesce(s["calls"], F.expr("array()").cast("array<struct<tool:string,id:string>>")).alias("calls"),
        F.coalesce(s["results"], F.expr("map()").cast("map<string,struct<success:boolean,outcome:string>>")).alias("results"),
        F.coalesce(s["prediction_targets"], F.expr("array()").cast("array<struct<sampled_prediction:string,actual:string,decision:string>>")).alias("targets"), token_count(r).alias("n_tokens"),
    )


def load_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(name, outcome): whether the first reward, in the order of the file, is above 0; the last line of a name wins.

    A variant sorts its keys, so rewards are read from the line itself.
    """
    rows = read_lines(spark, path)
    row = F.try_parse_json("value")
    failed = F.raise_error(F.concat(F.lit(f"{path}:"), F.col("line").cast("string"), F.lit(": expected a JSON object"))).cast("string")
    name = F.when(F.coalesce(F.schema_of_variant(row).startswith("OBJECT"), F.lit(False)), F.try_variant_get(row, "$.task.data.name", "string")).otherwise(failed)
    first = F.get(F.map_values(F.from_json("value", "rewards map<string,string>")["rewards"]), F.lit(0))
    read = rows.select("line", name.alias("name"), first.alias("first"))
    first = F.col("first")
    passed = F.when(first == "true", 1.0).when(first == "false", 0.0).otherwise(first.try_cast("double")) > 0
    return read.groupBy("name").agg(F.max_by(F.coalesce(passed.cast("int"), F.lit(0)), "line").alias("outcome"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> list[dict]:
    """One JSON object a line with sorted keys, in order, in as many parts as the rows need; returns the reports of the parts.

    Rows are dealt by ranges of ``order``, which adaptive execution sizes.  Nulls
    are left out.
    """
    line = F.to_json(F.struct(*sorted(df.columns)))
    ordered.write_lines(df.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")), path)
    return ordered.parts_of(path)


def write_manifest(path: str, artifacts: dict[str, dict], sources: dict, split: dict) -> None:
    """The manifest document, published by an atomic rename; ``artifacts`` has the digest and size of each file."""
    found = {name: {"sha256": a["sha256"], "bytes": a["bytes"]} for name, a in artifacts.items()}
    publish_text(path, json.dumps({"artifacts": found, "sources": sources, "split": split}, indent=2, sort_keys=True) + "\n")


def publish_text(path: str, text: str) -> None:
    part = Path(f"{path}.part")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)


def fetch(url: str, sha256: str, cache: str, name: str) -> Path:
    """A cached download: used again only if its hash is right; a wrong hash is an error."""
    target = Path(cache) / name
    if not target.exists() or hashlib.sha256(target.read_bytes()).hexdigest() != sha256:
        part = target.with_name(target.name + ".part")
        with urllib.request.urlopen(url) as response:
            part.write_bytes(response.read())
        if hashlib.sha256(part.read_bytes()).hexdigest() != sha256:
            part.unlink()
            raise ValueError(f"{url} has another hash than {sha256}")
        os.replace(part, target)
    return target


def read_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_workspace(spark: SparkSession, path: str, placeholder: str) -> DataFrame:
    """Files whose whole text is not the placeholder."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), "value").where(F.col("value") != placeholder)
