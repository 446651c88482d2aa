"""Trace metrics: per trace, pooled report, pass@k.

A trace has task, solved, calls (tool, id), results (by call id: success,
outcome), targets (sampled_prediction, actual, decision) and n_tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions import text as T
from trailspark.functions.numeric import pass_at_k, ratio
from trailspark.functions.protocol import outcome_of_result
from trailspark.schema import OUTCOMES

no = lambda c: F.coalesce(c, F.lit(False))


def tests_of(calls: Column, results: Column) -> Column:
    """array<struct<outcome, success>> of the test calls in order; a missing result is a failure."""
    tests = F.filter(calls, lambda c: c["tool"] == "python_test")
    found = F.transform(tests, lambda c: F.try_element_at(results, c["id"]))
    return F.transform(found, lambda r: F.struct(outcome_of_result(r["outcome"], r["success"]).alias("outcome"), no(r["success"]).alias("success")))


def recovered(tests: Column, good) -> Column:
    """Whether a good test follows the first bad one: a fold of two flags."""
    start = F.struct(F.lit(False).alias("failed"), F.lit(False).alias("won"))
    fold = F.aggregate(tests, start, lambda s, t: F.struct((s["failed"] | ~good(t)).alias("failed"), (s["won"] | (s["failed"] & good(t))).alias("won")))
    return fold["won"]


def per_trace(traces: DataFrame, key: str = "task") -> DataFrame:
    """A row of metrics per trace, in one narrow projection."""
    rows = traces.withColumn("tests", tests_of(F.col("calls"), F.col("results")))
    t, p = F.col("tests"), F.col("targets")
    passed = lambda x: x["outcome"] == "PASS"
    size = lambda xs: F.size(xs).cast("long")
    bad, good = F.filter(p, lambda x: ~x["actual"].eqNullSafe("PASS")), F.filter(p, lambda x: x["actual"].eqNullSafe("PASS"))
    revised = lambda xs: F.filter(xs, lambda x: x["decision"].eqNullSafe("REVISE"))
    right = F.filter(p, lambda x: no(x["sampled_prediction"] == x["actual"]))
    first = lambda of_test: F.when(F.size(p) > 0, no(F.get(p, F.lit(0))["actual"] == "PASS")).otherwise(no(of_test(F.get(t, F.lit(0)))))
    patches = F.filter("calls", lambda c: c["tool"] == "apply_patch")
    return rows.select(
        key, "solved", size("calls").alias("tool_calls"), size(t).alias("test_calls"), F.greatest(F.lit(0), size(patches) - 1).alias("revisions"),
        first(passed).alias("first_patch_success"), first(lambda x: x["success"]).alias("first_patch_correct"),
        F.exists(t, lambda x: ~passed(x)).alias("had_failure"), (F.col("solved") & recovered(t, passed)).alias("recovered_solved"),
        F.exists(t, lambda x: ~x["success"]).alias("had_executed_failure"), recovered(t, lambda x: x["success"]).alias("recovered_any"),
        size(p).alias("predictions"), size(right).alias("right_predictions"), size(bad).alias("bad_patches"), size(revised(bad)).alias("bad_rejected"),
        size(good).alias("good_patches"), size(revised(good)).alias("good_rejected"), ratio(size(right), size(p)).alias("prediction_accuracy"),
        ratio(size(revised(bad)), size(bad)).alias("bad_patch_rejection_rate"), ratio(size(revised(good)), size(good)).alias("unnecessary_rejection_rate"), "n_tokens",
    )


def report(traces: DataFrame, key: str = "task") -> DataFrame:
    """One row of pooled metrics; fails unless each task has one trace."""
    rows = per_trace(traces, key)
    total = lambda c: F.sum(F.col(c).cast("long"))
    n = F.count("*")
    when = lambda c, x: F.sum(F.when(F.col(c), F.col(x)))
    one = rows.agg(
        n.alias("traces"), F.count_distinct(key).alias("tasks"), ratio(total("solved"), n).alias("final_pass_at_1"), ratio(total("first_patch_success"), n).alias("first_patch_success"),
        total("had_failure").alias("tasks_with_executed_failure"), ratio(total("recovered_solved"), total("had_failure")).alias("executed_failure_recovery_rate"),
        ratio(when("solved", "test_calls"), total("solved")).alias("visible_python_tests_per_solved_task"), ratio(total("test_calls"), n).alias("average_visible_python_tests"),
        ratio(total("tool_calls"), n).alias("average_visible_tool_calls"), ratio(total("revisions"), n).alias("average_revisions"), F.avg("n_tokens").alias("average_total_tokens"),
        total("predictions").alias("prediction_count"), ratio(total("right_predictions"), total("predictions")).alias("prediction_accuracy"),
        ratio(total("bad_rejected"), total("bad_patches")).alias("bad_patch_rejection_rate"), ratio(total("good_rejected"), total("good_patches")).alias("good_patch_unnecessary_rejection_rate"),
    )
    single = F.assert_true(F.col("traces") == F.col("tasks"), "report needs exactly one trace per task")
    return one.withColumn("__ok", single).where(F.col("__ok").isNull()).drop("__ok", "tasks")


def confusion(targets: DataFrame) -> DataFrame:
    """(predicted, actual, n) of (sampled_prediction, actual) rows with a valid actual; others predicted are INVALID."""
    valid = targets.where(F.col("actual").isin(*OUTCOMES))
    predicted = F.when(F.col("sampled_prediction").isin(*OUTCOMES), F.col("sampled_prediction")).otherwise("INVALID")
    return valid.groupBy(predicted.alias("predicted"), "actual").agg(F.count("*").alias("n"))


def f1_by_class(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 of all classes, and the mean F1 over all of them, seen or not."""
    sums = matrix.agg(*(x for o in OUTCOMES for x in (
        F.coalesce(F.sum(F.when((F.col("predicted") == o) & (F.col("actual") == o), F.col("n"))), F.lit(0)).alias(f"tp_{o}"),
        F.coalesce(F.sum(F.when(F.col("predicted") == o, F.col("n"))), F.lit(0)).alias(f"p_{o}"), F.coalesce(F.sum(F.when(F.col("actual") == o, F.col("n"))), F.lit(0)).alias(f"a_{o}"))))
    rows = F.array(*(F.struct(F.lit(o).alias("class"), F.col(f"tp_{o}").alias("tp"), F.col(f"p_{o}").alias("predicted"), F.col(f"a_{o}").alias("actual")) for o in OUTCOMES))
    f1 = lambda r: ratio(2 * r["tp"], r["predicted"] + r["actual"])
    macro = F.aggregate(rows, F.lit(0.0), lambda a, r: a + f1(r)) / len(OUTCOMES)
    flat = sums.select(F.explode(rows).alias("r"), macro.alias("macro_f1"))
    r = F.col("r")
    return flat.select("r.class", ratio(r["tp"], r["predicted"]).alias("precision"), ratio(r["tp"], r["actual"]).alias("recall"), f1(r).alias("f1"), "macro_f1")


def f1_map(matrix: DataFrame) -> DataFrame:
    """The same as one row with a map by class."""
    return f1_by_class(matrix).agg(F.map_from_entries(F.collect_list(F.struct("class", "f1"))).alias("prediction_f1_by_class"), F.first("macro_f1").alias("prediction_macro_f1"))


def attempts_by_task(attempts: DataFrame, task: str = "task", passed: str = "passed") -> DataFrame:
    return attempts.groupBy(task).agg(F.count("*").alias("n"), F.sum(F.col(passed).cast("long")).alias("c"))


def summarise(attempts: DataFrame, k: int, **names) -> DataFrame:
    """One row: tasks, tasks with any pass, mean pass@k."""
    rows = attempts_by_task(attempts, **names).withColumn("p", pass_at_k(F.col("n"), F.col("c"), k))
    return rows.agg(F.count("*").alias("tasks"), F.count_if(F.col("c") > 0).alias("tasks_with_any_pass"), F.avg("p").alias("pass_at_k"))


def compare(before: DataFrame, after: DataFrame, k: int, *, strict: bool = True) -> DataFrame:
    """One row comparing pass@k by task; strict fails unless both have the same tasks."""
    a, b = (attempts_by_task(x).select("task", pass_at_k(F.col("n"), F.col("c"), k).alias(p)) for x, p in ((before, "a"), (after, "b")))
    both = a.join(b, "task", "full_outer" if strict else "inner")
    if strict:
        same = F.assert_true(F.col("a").isNotNull() & F.col("b").isNotNull(), "both sides need the same tasks")
        both = both.withColumn("__ok", same).where(F.col("__ok").isNull())
    return both.agg(
        F.count("*").alias("tasks"), F.avg("a").alias("before_pass_at_k"), F.avg("b").alias("after_pass_at_k"), (F.avg("b") - F.avg("a")).alias("delta"),
        F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") < F.col("a")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"),
    )


def binary_reward(truncated: Column, calls: Column, results: Column, final_success: Column, protocol_errors: Column, messages: Column) -> Column:
    """1 if a successful test was shown to the agent before a FINAL turn and the hidden check passed cleanly; else 0.

    ``messages`` have role, content and tool_call_id.
    """
    tests = F.filter(calls, lambda c: (c["tool"] == "python_test") & no(F.try_element_at(results, c["id"])["success"]))
    first = F.get(tests, F.lit(0))["id"]
    last = F.try_element_at(messages, F.lit(-1))
    final = (last["role"] == "assistant") & F.startswith(T.strip(last["content"]), F.lit("FINAL:"))
    earlier = F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))
    shown = F.exists(earlier, lambda m: (m["role"] == "tool") & (m["tool_call_id"] == first))
    ok = ~no(truncated) & first.isNotNull() & no(final_success) & (F.coalesce(F.size(protocol_errors), F.lit(0)) <= 0) & final & shown
    return no(ok).cast("int")
