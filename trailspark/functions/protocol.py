"""The agents' line protocol: calls, predictions, decisions, turn shapes, results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailspark.functions import text as T
from trailspark.schema import DECISIONS, OUTCOMES

# The tags and the call line of the protocol.
PREDICTION = r"<PREDICTION>\s*([A-Z_]+)\s*</PREDICTION>"
DECISION = r"<DECISION>\s*([A-Z_]+)\s*</DECISION>"
TOOL_NAME = r"[A-Za-z_]\w*"

# Texts of failed results by outcome.
FAILURE_TEXT = {
    "ASSERTION_FAILURE": "tests failed",
    "RUNTIME_ERROR": "generated solution raised a runtime error",
    "SYNTAX_ERROR": "generated solution has a syntax error",
    "TIMEOUT": "tests timed out",
    "OTHER": "tests failed",
}


def lookup(key: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


# What a failed run's error output says, by outcome, the first that applies.  The error texts below are fixed too.
STDERR_MARKS = (("SYNTAX_ERROR", ("SyntaxError", "IndentationError")), ("ASSERTION_FAILURE", ("AssertionError",)), ("RUNTIME_ERROR", ("Traceback (most recent call last)",)))


def outcome_of_stderr(stderr: Column, timed_out: Column) -> Column:
    """The failure class of a run."""
    out = F.when(F.coalesce(timed_out, F.lit(False)), "TIMEOUT")
    for outcome, marks in STDERR_MARKS:
        for mark in marks:
            out = out.when(F.coalesce(F.contains(stderr, F.lit(mark)), F.lit(False)), outcome)
    return out.otherwise("OTHER")


def outcome_of_result(outcome: Column, success: Column) -> Column:
    """A valid class as it is; else by success."""
    return F.when(outcome.isin(*OUTCOMES), outcome).when(F.coalesce(success, F.lit(False)), "PASS").otherwise("OTHER")


def parse_lines(lines: Column) -> Column:
    """array<struct<line, tool, id, params, error>> of an array of lines: all null but ``line`` where none is a call.

    Each transform names what the next needs more than once; a payload is parsed
    once, to a variant, from which the rest is taken.
    """
    shape = r"(?s)\ACALL\s+(\S+)\s+(.*)\z"
    bare = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), T.strip(x).alias("bare")))
    split = F.transform(bare, lambda x: F.struct(
        x["line"].alias("line"), F.startswith(x["bare"], F.lit("CALL ")).alias("is_call"), F.regexp_extract(x["bare"], shape, 1).alias("tool"), F.regexp_extract(x["bare"], shape, 2).alias("payload")
    ))
    read = F.transform(split, lambda x: F.struct(
        x["line"].alias("line"), x["is_call"].alias("is_call"), x["tool"].alias("tool"), F.when(x["is_call"], F.try_parse_json(x["payload"])).alias("json"),
    ))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    read = F.transform(read, lambda x: F.struct(
        x["line"].alias("line"), x["is_call"].alias("is_call"), x["tool"].alias("tool"), x["json"].alias("json"), F.when(is_object(x["json"]), x["json"].cast("map<string,variant>")).alias("kinds")
    ))
    text = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")) == "STRING"
    name = F.lit(rf"(?U)\A{TOOL_NAME}\z")

    def error(x: Column) -> Column:
        call_id = F.try_element_at(x["kinds"], F.lit("id"))
        return (
            F.when((x["tool"] == "") | x["json"].isNull(), "malformed CALL: bad JSON")
            .when(~F.rlike(x["tool"], name) | x["kinds"].isNull(), "malformed CALL")
            .when(~text(call_id) | (call_id.try_cast("string") == ""), "CALL requires a string id")
            .when(~F.forall(F.map_values(x["kinds"]), text), "CALL arguments must be strings")
        )

    judged = F.transform(read, lambda x: F.struct(x.alias("x"), F.when(x["is_call"], error(x)).alias("error")))

    def row(y: Column) -> Column:
        x, ok = y["x"], y["x"]["is_call"] & y["error"].isNull()
        params = F.transform_values(F.map_filter(x["kinds"], lambda k, v: k != "id"), lambda k, v: v.cast("string"))
        call_id = F.try_element_at(x["kinds"], F.lit("id")).cast("string")
        return F.struct(
            x["line"].alias("line"), F.when(ok, x["tool"]).alias("tool"), F.when(ok, call_id).alias("id"), F.when(ok, params).alias("params"), y["error"].alias("error")
        )

    return F.transform(judged, row)


def parse_call(line: Column) -> Column:
    """struct<line, tool, id, params, error> of one line."""
    return F.get(parse_lines(F.array(line)), F.lit(0))


_CALLS = "array<struct<tool:string,id:string,params:map<string,string>>>"


def parse_calls(text: Column) -> Column:
    """struct<calls, errors> of a turn, in line order; a repeated id is an error and not a call."""
    some = F.filter(parse_lines(T.splitlines(text)), lambda x: x["id"].isNotNull() | x["error"].isNotNull())
    start = F.struct(F.array().cast(_CALLS).alias("calls"), F.array().cast("array<string>").alias("errors"))

    def step(s: Column, x: Column) -> Column:
        again = F.exists(s["calls"], lambda c: c["id"] == x["id"])
        call = F.array(F.struct(x["tool"].alias("tool"), x["id"].alias("id"), x["params"].alias("params")))
        problem = F.when(x["error"].isNotNull(), x["error"]).when(again, F.concat(F.lit("duplicate CALL id "), x["id"]))
        said = F.concat(F.lit("line "), x["line"].cast("string"), F.lit(": "), problem)
        calls = F.when(x["id"].isNotNull() & ~F.coalesce(again, F.lit(False)), F.concat(s["calls"], call)).otherwise(s["calls"])
        return F.struct(calls.alias("calls"), F.when(said.isNotNull(), F.array_append(s["errors"], said)).otherwise(s["errors"]).alias("errors"))

    return F.aggregate(some, start, step)


def parse_prediction(text: Column) -> Column:
    """struct<prediction, decision, errors>; a tag counts only if there is exactly one."""
    predictions, decisions = (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (PREDICTION, DECISION))
    one = lambda xs: F.when(F.size(xs) == 1, xs[0])
    prediction, decision = one(predictions), one(decisions)
    errors = F.array_compact(F.array(
        F.when(F.size(predictions) != 1, "Arm B requires exactly one PREDICTION").when(~prediction.isin(*OUTCOMES), F.concat(F.lit("unknown prediction outcome: "), prediction)),
        F.when(F.size(decisions) != 1, "Arm B requires exactly one DECISION").when(~decision.isin(*DECISIONS), F.concat(F.lit("unknown decision: "), decision)),
    ))
    return F.struct(prediction.alias("prediction"), decision.alias("decision"), errors.alias("errors"))


def turn_shape_error(text: Column, n_calls: Column, arm: Column, pending: Column) -> Column:
    """Why a turn has the wrong shape; null if it is right."""
    lines = F.filter(F.transform(T.splitlines(text), T.strip), lambda x: x != "")
    bound = F.array(F.struct(lines.alias("lines"), n_calls.alias("n"), arm.alias("arm"), pending.alias("pending")))
    return F.get(F.transform(bound, _shape_error), F.lit(0))


def _shape_error(turn: Column) -> Column:
    lines, n_calls = turn["lines"], turn["n"]
    call_lines = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("CALL "))))
    line = lambda i: F.get(lines, F.lit(i))
    whole = lambda c, p: F.rlike(c, F.lit(rf"(?s)\A{p}\z"))
    final = (F.size(lines) == 1) & F.startswith(line(0), F.lit("FINAL:"))
    decided = (F.size(lines) == 3) & (call_lines == 1) & whole(line(0), PREDICTION) & whole(line(1), DECISION) & F.startswith(line(2), F.lit("CALL "))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(n_calls == 0, F.when(~yes(final), "assistant turn must contain exactly one CALL or one FINAL"))
        .when(n_calls != 1, "assistant turn requires exactly one CALL")
        .when((turn["arm"] == "b") & turn["pending"], F.when(~yes(decided), "Arm B prediction turn requires PREDICTION, DECISION, and one CALL"))
        .when(~((F.size(lines) == 1) & (call_lines == 1)), "CALL turn cannot contain additional text")
    )


def result_block(call_id: Column, success: Column, timed_out: Column, stdout: Column, stderr: Column) -> Column:
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}:\n"), T.strip(c)))
    lines = F.array_compact(F.array(
        F.concat(F.lit("status: "), F.when(success, "success").otherwise("failed")), F.when(F.coalesce(timed_out, F.lit(False)), "timed_out: true"), part("stdout", stdout), part("stderr", stderr)
    ))
    return F.concat(F.lit("RESULT "), call_id, F.lit(":\n"), F.array_join(lines, "\n"))


def failed_block(call_id: Column, outcome: Column) -> Column:
    """The result of a failed test; a class without a text is an error."""
    detail = F.coalesce(lookup(outcome, FAILURE_TEXT), F.raise_error(F.concat(F.lit("not a failure: "), F.coalesce(outcome, F.lit("null")))))
    return F.concat(F.lit("RESULT "), call_id, F.lit(":\nstatus: failed\nstderr:\n"), detail)
