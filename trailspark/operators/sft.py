"""Supervised traces: the messages of each arm and recovery mode, and their matched fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspark.functions.canonical import object_of
from trailspark.functions.protocol import failed_block
from trailspark.functions.text import compact_call

# The empty workspace and the closing turn.
PLACEHOLDER = "# Write your function here.\n"
FINAL = "FINAL: implemented the function and passed the tests."
#: Candidates that fail before the last, by mode.
DEPTH = {None: 0, "shadow": 1, "visible": 1, "deep_shadow": 2, "deep_visible": 2}


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


class _Script:
    """Appends turns; call ids count up."""

    def __init__(self, prefix: Column):
        self.prefix, self.messages, self.n = prefix, [], 0

    def step(self, tool: str, fields: dict[str, Column], failed: Column | None = None, tags: tuple[Column, str] | None = None, out: Column | None = None) -> None:
        self.n += 1
        call_id = F.lit(f"c{self.n}")
        call = compact_call(tool, F.struct(call_id.alias("id"), *(v.alias(k) for k, v in fields.items())))
        if tags:
            call = F.concat(F.lit("<PREDICTION>"), tags[0], F.lit(f"</PREDICTION>\n<DECISION>{tags[1]}</DECISION>\n"), call)
        self.messages.append(_message("assistant", call))
        fine = F.concat(F.lit("RESULT "), call_id, F.lit(":\nstatus: success\nstdout:\n"), out if out is not None else F.lit({"apply_patch": "patch applied", "python_test": "tests passed"}.get(tool, "")))
        self.messages.append(_message("tool", fine if failed is None else failed_block(call_id, failed)))

    def patch(self, find: Column, replace: Column, tags=None) -> None:
        self.step("apply_patch", {"file_path": F.concat(self.prefix, F.lit("/solution.py")), "find": find, "replace": replace}, tags=tags)

    def test(self, failed=None, tags=None) -> None:
        self.step("python_test", {"project_path": self.prefix}, failed, tags)


def messages(arm: str, mode: str | None, prompt: Column, prefix: Column, first_code: Column, failures: list[tuple[Column, Column, Column]]) -> Column:
    """All messages; ``failures``: (outcome, find, replace) of each failing candidate and the patch after it."""
    s = _Script(prefix)
    s.step("read_file", {"file_path": F.concat(prefix, F.lit("/solution.py"))}, out=F.lit(PLACEHOLDER.rstrip()))
    s.patch(F.lit(PLACEHOLDER), first_code)
    for outcome, find, replace in failures:
        if arm == "b" and mode.endswith("shadow"):
            s.patch(find, replace, (outcome, "REVISE"))
            continue
        s.test(outcome, (F.lit("PASS"), "KEEP") if arm == "b" else None)
        s.patch(find, replace)
    s.test(tags=(F.lit("PASS"), "KEEP") if arm == "b" else None)
    return F.concat(prompt, F.array(*s.messages, _message("assistant", F.lit(FINAL))))


def matched_key(task_id: Column, id_type: T.DataType, initial: Column, outcome: Column, final: Column) -> Column:
    """What both arms of a task share: the digest of a canonical JSON object."""
    text = {"initial_code": initial, "initial_outcome": outcome, "final_code": final, "final_outcome": F.lit("PASS")}
    return F.sha2(object_of({"task_id": (task_id, id_type), **{k: (c, T.StringType()) for k, c in text.items()}}), 256)


def traces(tasks: DataFrame, arm: str) -> DataFrame:
    """One arm's rows.

    ``tasks``: task_id, case_id, prompt (messages), trace_prefix, code,
    test_code, mode, initial_code, and per failing candidate i = 1, 2:
    outcome_i, find_i, replace_i (null beyond the mode's depth).
    """
    failure = lambda i: (F.col(f"outcome_{i}"), F.col(f"find_{i}"), F.col(f"replace_{i}"))
    mode = F.col("mode")
    first = F.coalesce("initial_code", "code")
    depth = F.when(mode.isNull(), 0).when(mode.startswith("deep"), 2).otherwise(1)
    given = F.when(F.col("outcome_1").isNotNull(), 1).otherwise(0) + F.when(F.col("outcome_2").isNotNull(), 1).otherwise(0)
    built = F.when(depth != given, F.raise_error(F.lit("mode and recovery do not fit")).cast("array<struct<role:string,content:string>>"))
    for m, n in DEPTH.items():
        here = mode.isNull() if m is None else mode == m
        built = built.when(here, messages(arm, m, F.col("prompt"), F.col("trace_prefix"), first, [failure(i + 1) for i in range(n)]))
    outcome = F.coalesce("outcome_1", F.lit("PASS"))
    return tasks.select(
        F.lit(arm).alias("arm"), "case_id", F.sha2(first, 256).alias("candidate_code_sha256"), outcome.alias("candidate_outcome"), F.col("outcome_2").alias("second_candidate_outcome"),
        F.sha2("code", 256).alias("final_code_sha256"), F.lit("PASS").alias("final_outcome"), matched_key(F.col("task_id"), tasks.schema["task_id"].dataType, first, outcome, F.col("code")).alias("matched_key"),
        built.alias("messages"), F.col("mode").alias("recovery_mode"), "task_id", "test_code", F.when(mode.isNull(), "direct").otherwise("recovery").alias("trace_type"),
    )
