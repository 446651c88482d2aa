"""Task sets as an agent's harness takes them: options, typed tasks, workspaces, records."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.operators import transcript
from trailspark.sources.lines import publish_text, read_tasks


@dataclass(frozen=True)
class TaskOptions:
    """Longest trace, in tokens, that counts."""

    max_trace_tokens: int = 4096


@dataclass(frozen=True)
class SetOptions:
    """Where the tasks are, and how many are taken."""

    data_path: str | None = None
    max_samples: int | None = None
    task: TaskOptions = field(default_factory=TaskOptions)


@dataclass(frozen=True)
class HarnessOptions:
    """Limits of an agent's run."""

    arm: str = "a"
    max_tool_calls: int = 8
    tool_timeout: int = 30


def blueprint_path(value: str, root: str | Path) -> Path:
    """An absolute path as it is, another from ``root``; it must exist."""
    path = Path(value).expanduser()
    return (path if path.is_absolute() else Path(root, path)).resolve(strict=True)


def load(spark: SparkSession, options: SetOptions) -> DataFrame:
    """Typed tasks in the order of their file, with ``name`` and the resolved ``blueprint_root``."""
    if not options.data_path:
        raise ValueError("a task set needs a data_path")
    data = Path(options.data_path).expanduser().resolve(strict=True)
    rows = read_tasks(spark, str(data), options.max_samples)
    for r in rows.select("blueprint_root").distinct().toLocalIterator():
        blueprint_path(r.blueprint_root, data.parent)
    root = F.when(F.startswith("blueprint_root", F.lit("/")), F.col("blueprint_root")).otherwise(F.concat(F.lit(f"{data.parent}/"), "blueprint_root"))
    return rows.withColumn("name", F.col("case_id")).withColumn("blueprint_root", root)


def same_arm(tasks: DataFrame, options: HarnessOptions) -> DataFrame:
    """``tasks``; a task of another arm than the harness fails."""
    wrong = F.raise_error(F.concat(F.lit(f"harness arm {options.arm} does not match task arm "), F.coalesce("arm", F.lit("null")))).cast("string")
    return tasks.withColumn("arm", F.when(F.col("arm") == options.arm, F.col("arm")).otherwise(wrong))


def archive(folder: str | Path, prefix: str) -> bytes:
    """A gzipped tar of a folder's files under ``prefix``."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        tar.add(Path(folder).resolve(strict=True), arcname=prefix)
    return out.getvalue()


def finalise(traces: DataFrame, documents: DataFrame, *, truncated: str = "truncated", branch_lengths: str = "branch_lengths", options: TaskOptions | None = None) -> DataFrame:
    """``traces`` with the runtime ``record`` of their document (trace, record); a truncated or overlong trace fails."""
    cap = (options or TaskOptions()).max_trace_tokens
    reason = transcript.truncation_reason(F.col(truncated), F.col(branch_lengths), cap)
    kept = traces.withColumn(truncated, F.when(reason.isNull(), F.col(truncated)).otherwise(F.raise_error(F.concat(F.col("trace"), F.lit(": "), reason)).cast("boolean")))
    return kept.join(documents.select("trace", F.try_parse_json("record").alias("record")), "trace", "left")


def write_records(records: DataFrame, folder: str, name: Callable[[str], str] = lambda trace: trace.replace("/", "_")) -> int:
    """The record of each trace (trace, record) as a file of its own in ``folder``, each published whole; returns how many."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for r in records.toLocalIterator():
        publish_text(f"{folder}/{name(r.trace)}.json", json.dumps(json.loads(r.record), sort_keys=True))
        n += 1
    return n


#: Messages that a chat template must render as ``transcript.render`` does.
PARITY = (("system", "SYS"), ("user", "USR "), ("assistant", 'CALL read_file {"id":"c1"}'), ("tool", "RESULT c1:\nstatus: success\n"))


def template_parity(spark: SparkSession, apply: Callable[[Iterable[dict[str, str]]], str]) -> None:
    """An error unless a tokenizer's chat template, with a generation prompt, renders as ``transcript.render`` does."""
    rows = spark.range(1).select(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in PARITY)).alias("m"))
    wanted = rows.select(transcript.render(F.col("m"), generation_prompt=True).alias("r")).first().r
    found = apply([{"role": r, "content": c} for r, c in PARITY])
    if found != wanted:
        raise ValueError(f"the chat template renders {found!r}, not {wanted!r}")
