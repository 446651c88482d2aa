"""Offline replay of the agent protocol over stored turns.

The state of a trace is small (workspace text, pending candidate, ids, budget),
so a trace is replayed by one ordered fold; traces are dealt by key.  No test's
outcome changes what follows in a trace: the fold notes the programs to be tested,
each pair of program and tests that any trace has is run once, and the outcomes
are joined to the traces.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.protocol import DECISION, PREDICTION
from trailspark.functions.text import strip
from trailspark.operators import execution
from trailspark.operators.workspace import RESULT, Result, Workspace
from trailspark.schema import DECISIONS, OUTCOMES
from trailspark.session import cut

_TARGETS = "array<struct<candidate_call_id:string,context_messages:array<struct<role:string,content:string>>,sampled_prediction:string,actual:string,decision:string,shadow:boolean,candidate_sha256:string>>"
REPLAYED = (
    "trace string, calls array<string>, tools array<string>, outcomes array<string>, visible array<string>, predicted array<string>, actual array<string>, "
    "decisions array<string>, shadow array<boolean>, context_turns array<int>, errors array<string>, final_success boolean, final_sha256 string, "
    f"results array<{RESULT}>, targets {_TARGETS}, params array<map<string,string>>, final_verification {RESULT}"
)
#: What the fold knows of a trace: outcomes of tests are places in ``programs`` (``PENDING``).
FOLDED = (
    "trace string, calls array<string>, tools array<string>, predicted array<string>, decisions array<string>, shadow array<boolean>, context_turns array<int>, errors array<string>, final_sha256 string, "
    f"results array<{RESULT}>, targets {_TARGETS}, params array<map<string,string>>, final_verification {RESULT}, programs array<string>, test_code string"
)
PENDING = "#"
_CALL = re.compile(r"CALL\s+(\S+)\s+(.*)", re.S)


def read_calls(text: str, used: set[str]) -> tuple[list[tuple[str, str, dict]], list[str]]:
    calls, errors, seen = [], [], set(used)
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line.startswith("CALL "):
            continue
        m = _CALL.fullmatch(line)
        try:
            body = json.loads(m[2]) if m else None
        except ValueError:
            body = None
        problem = None
        if not isinstance(body, dict) or not re.fullmatch(r"[A-Za-z_]\w*", m[1]):
            problem = "malformed CALL"
        elif not isinstance(body.get("id"), str) or not body["id"]:
            problem = "CALL requires a string id"
        elif not all(isinstance(v, str) for v in body.values()):
            problem = "CALL arguments must be strings"
        elif body["id"] in seen:
            problem = f"duplicate CALL id {body['id']}"
        if problem:
            errors.append(f"line {number}: {problem}")
        else:
            seen.add(body["id"])
            calls.append((m[1], body["id"], {k: v for k, v in body.items() if k != "id"}))
    return calls, errors


def shape_error(text: str, calls: list, deciding: bool) -> str | None:
    lines = [x for x in (y.strip() for y in text.splitlines()) if x]
    marked = sum(x.startswith("CALL ") for x in lines)
    if not calls:
        return None if len(lines) == 1 and lines[0].startswith("FINAL:") else "assistant turn must contain exactly one CALL or one FINAL"
    if len(calls) > 1:
        return "assistant turn requires exactly one CALL"
    if deciding:
        good = len(lines) == 3 and marked == 1 and re.fullmatch(PREDICTION, lines[0]) and re.fullmatch(DECISION, lines[1]) and lines[2].startswith("CALL ")
        return None if good else "Arm B prediction turn requires PREDICTION, DECISION, and one CALL"
    return None if len(lines) == 1 and marked == 1 else "CALL turn cannot contain additional text"


@dataclass
class Replay:
    arm: str
    space: Workspace
    budget: int = 8
    pending: str | None = None
    said: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    results: list = field(default_factory=list)
    targets: list = field(default_factory=list)
    turns: list = field(default_factory=list)
    errors: list = field(default_factory=list)

    @property
    def code(self) -> str:
        return self.space.files.get("solution.py", "")

    def sha256(self) -> str:
        return hashlib.sha256(self.code.encode("utf-8", "surrogatepass")).hexdigest()

    def target(self, turn: int, prediction, decision, result: Result, shadow: bool) -> None:
        # a kept test whose call failed has no class; it counts as OTHER
        self.turns.append(turn)
        self.targets.append({
            "candidate_call_id": self.pending, "context_messages": list(self.said), "sampled_prediction": prediction, "actual": result.outcome or "OTHER", "decision": decision, "shadow": shadow, "candidate_sha256": self.sha256(),
        })

    def execute(self, call) -> Result:
        found = self.space.call(call[0], call[2])
        self.calls.append((call[1], call[0], call[2]))
        self.results.append(found)
        return found

    def turn(self, number: int, text: str) -> bool:
        """Whether the loop goes on after an assistant turn."""
        calls, errors = read_calls(text, {c[0] for c in self.calls})
        deciding = self.arm == "b" and self.pending is not None
        if not errors and (problem := shape_error(text, calls, deciding)):
            errors = [problem]
        if errors:
            self.errors += errors
            return False
        if deciding:
            tags = [re.findall(p, text) for p in (PREDICTION, DECISION)]
            prediction, decision = (x[0] if len(x) == 1 else None for x in tags)
            wanted = {"KEEP": "python_test", "REVISE": "apply_patch"}
            problem = None
            if not calls:
                problem = "a pending candidate needs a decision"
            elif prediction not in OUTCOMES or decision not in DECISIONS:
                problem = "unknown prediction or decision"
            elif calls[0][0] != wanted[decision]:
                problem = f"{decision} requires {wanted[decision]}"
            elif len(self.calls) >= self.budget:
                problem = "tool budget exhausted"
            if problem or decision == "REVISE":
                self.target(number, prediction, decision, self.space.test(), True)  # before the patch; costs no budget
            if problem:
                self.errors.append(problem)
                return False
            result = self.execute(calls[0])
            if decision == "KEEP":
                self.target(number, prediction, decision, result, False)
            self.pending = calls[0][1] if decision == "REVISE" and result.success else None
            return True
        if not calls:
            return False
        if len(self.calls) >= self.budget:
            self.errors.append("tool budget exhausted")
            return False
        if self.arm == "b" and calls[0][0] == "python_test":
            self.errors.append("python_test without a candidate")
            return False
        result = self.execute(calls[0])
        if self.arm == "b" and calls[0][0] == "apply_patch" and result.success:
            self.pending = calls[0][1]
        return True


def _noted(programs: list[str]):
    """Stands in for ``run_tests``: notes each program once, and gives its place as the outcome."""

    def note(code: str, tests: str, timeout: float) -> dict:
        if code not in programs:  # no more than a trace has calls
            programs.append(code)
        return {"success": False, "outcome": f"{PENDING}{programs.index(code)}", "exit_code": 0, "timed_out": False, "detail": ""}

    return note


class _Trace:
    """A trace that is being folded."""

    def __init__(self, first, budget: int):
        held, prefix = first.workspace, getattr(first, "trace_prefix", None)
        self.trace, self.tests, self.programs, self.number, self.ended = first.trace, first.test_code or "", [], 0, False
        files = {"solution.py": held} if isinstance(held, str) else dict(held or {})
        self.replay = Replay(first.arm, Workspace(self.tests, files, run=_noted(self.programs), **({"prefix": prefix} if prefix else {})), budget)

    def add(self, role: str | None, content: str | None) -> None:
        if self.ended:
            return
        if role == "assistant" and not self.replay.turn(self.number, content or ""):
            self.ended = True
            return
        self.number += 1
        self.replay.said.append({"role": role, "content": content})

    def row(self) -> tuple:
        r = self.replay
        final = r.space.test()
        return (
            self.trace, [c[0] for c in r.calls], [c[1] for c in r.calls], *([t[k] for t in r.targets] for k in ("sampled_prediction", "decision", "shadow")), r.turns, r.errors, r.sha256(),
            [{"id": c[0], **vars(x)} for c, x in zip(r.calls, r.results, strict=True)], r.targets, [c[2] for c in r.calls], {"id": None, **vars(final)}, self.programs, self.tests,
        )


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in re.split(r", (?=\w+ )", schema)]


def _folded(turns: DataFrame, budget: int) -> DataFrame:
    """One row of ``FOLDED`` per trace: turns come in order, and a task holds one trace at a time."""
    names = _names(FOLDED)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            done = []
            for row in rows.itertuples(index=False):
                if held is None or row.trace != held.trace:
                    if held is not None:
                        done.append(held.row())
                    held = _Trace(row, budget)
                held.add(row.role, row.content)
            yield pd.DataFrame(done, columns=names)
        if held is not None:
            yield pd.DataFrame([held.row()], columns=names)

    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartition(width, "trace").sortWithinPartitions("trace", F.asc_nulls_last("turn")).mapInPandas(fold, FOLDED)


def replay(turns: DataFrame, *, budget: int = 8, timeout: float = 5) -> DataFrame:
    """One row per trace; ``turns``: trace, turn, role, content, arm, test_code, workspace (the last three the same in a trace).

    ``workspace`` is the text of ``solution.py``, or a map of paths to texts; it is at
    ``trace_prefix`` if there is such a column.
    """
    folded = cut(_folded(turns, budget))
    ran = execution.verify(folded.select("trace", "test_code", F.posexplode("programs").alias("at", "code")), timeout=timeout)
    runs = ran.groupBy(F.col("trace").alias("t")).agg(F.array_sort(F.collect_list(F.struct("at", "run"))).alias("runs"))  # a trace's programs, a few
    both = folded.join(runs, F.col("trace").eqNullSafe(F.col("t")), "left")
    run = lambda outcome: F.get("runs", F.substring(outcome, len(PENDING) + 1, 9).cast("int"))["run"]
    pending = lambda outcome: F.coalesce(F.startswith(outcome, F.lit(PENDING)), F.lit(False))
    late = F.lit(f"tests timed out after {timeout:g}s")

    def tested(id_: Column, x: Column) -> Column:
        told = F.when(x["timed_out"], late).otherwise(x["detail"])
        return F.struct(
            id_.alias("id"), x["success"].alias("success"), F.when(x["success"], told).otherwise("").alias("stdout"), F.when(x["success"], "").otherwise(told).alias("stderr"),
            x["exit_code"].alias("exit_code"), x["timed_out"].alias("timed_out"), x["outcome"].alias("outcome"),
        )

    settled = lambda r: F.when(pending(r["outcome"]), tested(r["id"], run(r["outcome"]))).otherwise(r)
    actual = lambda t: F.when(pending(t["actual"]), run(t["actual"])["outcome"]).otherwise(t["actual"])
    found = both.withColumns({
        "results": F.transform("results", settled), "targets": F.transform("targets", lambda t: t.withField("actual", actual(t))), "final_verification": settled(F.col("final_verification")),
    })
    seen = F.filter(F.arrays_zip("tools", "results"), lambda z: z["tools"] == "python_test")
    return found.withColumns({
        "outcomes": F.transform("results", lambda r: r["outcome"]), "visible": F.transform(seen, lambda z: z["results"]["outcome"]), "actual": F.transform("targets", lambda t: t["actual"]), "final_success": F.col("final_verification.success"),
    }).select(*_names(REPLAYED))


def records(replayed: DataFrame, arms: DataFrame) -> DataFrame:
    """(trace, record): the runtime record of each replayed trace as one JSON object; ``arms``: trace, arm."""
    bare = lambda r: F.struct(*(r[n].alias(n) for n in ("success", "stdout", "stderr", "exit_code", "timed_out", "outcome")))
    call = F.transform(F.arrays_zip("tools", "calls", "params"), lambda c: F.struct(c["tools"].alias("tool"), c["calls"].alias("id"), c["params"].alias("params")))
    results = F.map_from_entries(F.transform("results", lambda r: F.struct(r["id"], bare(r))))
    record = F.struct("arm", call.alias("calls"), bare(F.col("final_verification")).alias("final_verification"), results.alias("results"), F.col("targets").alias("prediction_targets"), F.col("errors").alias("protocol_errors"))
    return replayed.join(arms, "trace").select("trace", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def label_counts(replayed: DataFrame, by_trace: bool = False) -> DataFrame:
    """(outcome, n), or (trace, outcome, n), of the verified labels of replayed traces."""
    rows = replayed.select("trace", F.explode("actual").alias("outcome"))
    return rows.groupBy(*(["trace"] if by_trace else []), "outcome").agg(F.count("*").alias("n"))


def told_otherwise(turns: DataFrame, replayed: DataFrame) -> DataFrame:
    """(trace, call, told): tool turns of a trace whose text is not that of the call's result when it is run again; the nth tool turn is the nth call."""
    tools = turns.where("role = 'tool'").groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("turn", "content"))).alias("told"))  # a trace's tool turns, a few
    some = lambda r, n: F.when(F.coalesce(r[n], F.lit("")) != "", F.concat(F.lit(f"{n}:\n"), strip(r[n])))
    lines = lambda r: F.array_compact(F.array(F.concat(F.lit("status: "), F.when(r["success"], "success").otherwise("failed")), F.when(r["timed_out"], F.lit("timed_out: true")), some(r, "stdout"), some(r, "stderr")))
    block = lambda r: F.concat(F.lit("RESULT "), r["id"], F.lit(":\n"), F.array_join(lines(r), "\n"))
    both = replayed.join(tools, "trace").select("trace", F.explode(F.arrays_zip("results", "told")).alias("x")).where("x.results IS NOT NULL AND x.told IS NOT NULL")
    return both.where(F.col("x.told.content") != block(F.col("x.results"))).select("trace", F.col("x.results.id").alias("call"), F.col("x.told.content").alias("told"))


def expected_shape(mode: Column, arm: Column, first: Column, second: Column) -> Column:
    """struct<predicted, verified, decisions, visible> that a training trace of a mode must show."""
    one, ok = F.array(first), F.array(F.lit("PASS"))
    two = F.array(first, second)
    n = lambda word, k: F.array(*(F.lit(word) for _ in range(k)))
    shadow, visible, deep_s, deep_v = (mode == x for x in ("shadow", "visible", "deep_shadow", "deep_visible"))
    verified = F.when(shadow | visible, F.concat(one, ok)).when(deep_s | deep_v, F.concat(two, ok)).otherwise(ok)
    predicted = F.when(visible, n("PASS", 2)).when(deep_v, n("PASS", 3)).otherwise(verified)
    decisions = (
        F.when(shadow, F.array(F.lit("REVISE"), F.lit("KEEP"))).when(visible, n("KEEP", 2)).when(deep_s, F.concat(n("REVISE", 2), n("KEEP", 1)))
        .when(deep_v, n("KEEP", 3)).otherwise(n("KEEP", 1))
    )
    seen = F.when((arm == "b") & (shadow | deep_s), ok).otherwise(verified)
    none = F.array().cast("array<string>")
    only_b = lambda c: F.when(arm == "b", c).otherwise(none)
    return F.struct(only_b(predicted).alias("predicted"), only_b(verified).alias("verified"), only_b(decisions).alias("decisions"), seen.alias("visible"))


def shape_violations(replayed: DataFrame, plan: DataFrame) -> DataFrame:
    """(trace, problem) where a replay differs from its plan (trace, arm, mode, first_outcome, second_outcome)."""
    both = replayed.join(plan, "trace", "right").withColumn("e", expected_shape(F.col("mode"), F.col("arm"), F.col("first_outcome"), F.col("second_outcome")))
    differs = lambda name, c: F.when(~F.col(c).eqNullSafe(F.col(f"e.{name}")), name)
    problems = F.array_compact(F.array(
        F.when(F.coalesce(F.size("errors"), F.lit(1)) > 0, "errors"), F.when(~F.coalesce("final_success", F.lit(False)), "final"), differs("predicted", "predicted"),
        differs("verified", "actual"), differs("decisions", "decisions"), differs("visible", "visible"),
    ))
    return both.select("trace", F.explode(problems).alias("problem"))


