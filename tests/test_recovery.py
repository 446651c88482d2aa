"""Recoveries found in waves against one after another, and quotas filled by trying no more tasks than needed."""

import random

import pytest
from pyspark.sql import functions as F

from trailspark.operators import execution, split
from trailspark.plans import dataset, fixtures

PROGRAMS = {
    "line": ("def f(a, b, c):\n    return a + b - c\n", "assert f(1, 2, 3) == 0\nassert f(2, 1, 1) == 2\n"),
    "late": ("def f(x):\n    a = 1 + 2 + 3 + 4\n    b = 2 * 2 * 2\n    c = x * 1\n    return c\n", "assert f(5) == 5\nassert f(0) == 0\n"),
    "never": ("def f(x):\n    return x + 1 + 2 + 3\n", "assert f\n"),
    "nothing": ("def f(x):\n    return x\n", "assert f(1) == 1\n"),
    "twice": ("def f(x):\n    x = x + 1\n    x = x + 1\n    return x\n", "assert f(1) == 3\n"),
}


def in_turn(code, tests):
    """(first failure, chain, runs until the first, runs until the second), a run after another."""
    ran, failing, one, one_at, two, two_at = 0, [], None, None, None, None
    lines = code.splitlines(keepends=True)
    for row, before, after, whole in execution.mutate(code):
        if whole.count(after) != 1:
            continue
        ran += 1
        outcome = execution.run_tests(whole, tests)["outcome"]
        if outcome == "PASS":
            continue
        failing.append((row, before, after, whole, outcome))
        if one is None:
            one, one_at = (whole, after, before, outcome), ran
            continue
        a_row, _, _, a_whole, a_outcome = failing[0]
        low, high = min(row, a_row), max(row, a_row)
        find, put = ("".join(x.splitlines(keepends=True)[low : high + 1]) for x in (a_whole, whole))
        if two is None and find != put and a_whole.count(find) == 1:
            two, two_at = (a_whole, a_outcome, find, put, outcome, after, before), ran
    return one, two, one_at or ran, two_at or ran, len(lines)


@pytest.fixture(scope="module")
def programs(spark):
    return spark.createDataFrame([(k, c, t) for k, (c, t) in PROGRAMS.items()], "case_id string, code string, test_code string")


def test_waves_find_what_turns_find_with_few_runs(spark, programs):
    want = {k: in_turn(*p) for k, p in PROGRAMS.items()}
    for deep, answers in ((0, execution.first_failures), (1, execution.chained_failures)):
        runs = execution.run_until(programs, answers, timeout=5)
        found = {r.case_id: tuple(r)[1:] for r in answers(runs.where(execution.FAILED)).collect()}
        assert found == {k: w[deep] for k, w in want.items() if w[deep]}
        counts = {r.case_id: r["count"] for r in runs.groupBy("case_id").count().collect()}
        for k, w in want.items():
            assert counts.get(k, 0) <= max(2, 2 * w[2 + deep]), k
    all_ = execution.candidates(programs).groupBy("case_id").count().collect()
    assert sum(r["count"] for r in all_) > sum(w[2] for w in want.values())  # some mutations are not run
    assert execution.one_step_recovery(programs.limit(0)).count() == 0


@pytest.mark.parametrize(("n_deep", "n_shallow"), [(0, 0), (2, 3), (5, 0), (0, 7), (4, 9), (60, 60)])
def test_lazy_quotas_fill_as_eager_ones_and_stop(spark, n_deep, n_shallow):
    rng = random.Random(n_deep * 31 + n_shallow)
    data = [(i, rng.randrange(12), rng.random() < 0.3, rng.random() < 0.5) for i in range(70)]
    rows = spark.createDataFrame(data, "task_id long, key int, d boolean, s boolean")
    tried = []

    def attempt(wave, deep):
        tried.append(({r.task_id for r in wave.collect()}, deep))
        return wave.select("task_id", (F.col("d") & F.lit(deep)).alias("deep_ok"), F.col("s").alias("shallow_ok"))

    columns = ["task_id", "tier", "position", "mode"]
    eager = split.quota_fill(rows.withColumnRenamed("d", "deep_ok").withColumnRenamed("s", "shallow_ok"), n_deep, n_shallow).select(columns)
    lazy = split.lazy_quota_fill(rows, n_deep, n_shallow, attempt).select(columns)
    assert sorted(map(tuple, lazy.collect())) == sorted(map(tuple, eager.collect()))
    order = [i for i, *_ in sorted(data, key=lambda r: (r[1], r[0]))]
    seen = [i for wave, _ in tried for i in sorted(wave, key=order.index)]
    assert seen == order[: len(seen)]  # in order, each once
    taken = {r.task_id for r in lazy.collect()}
    full = len(taken) == n_deep + n_shallow
    if full and taken:
        assert tried[-1][0] & taken and len(seen) - (max(map(order.index, taken)) + 1) < len(tried[-1][0])
        assert len(tried[-1][0]) <= max(8, n_deep + n_shallow)
    else:
        assert full or len(seen) == 70


def test_recoveries_run_only_the_first_waves(spark, monkeypatch):
    tasks = fixtures.doubling_or_not(spark.range(1, 200).withColumnRenamed("id", "k"), "k")
    tried, plain = [], execution.run_until
    monkeypatch.setattr(execution, "run_until", lambda wave, *a, **o: tried.append(wave.count()) or plain(wave, *a, **o))
    got = dataset.recoveries(tasks, 1, 2, seed=42, timeout=5).collect()
    assert sorted(r.mode for r in got) == ["deep_shadow", "shadow", "visible"] and sum(tried) <= 24
    with pytest.raises(ValueError, match="recoveries, not 9"):
        dataset.recoveries(tasks.where("task_id < 4"), 9, 0, seed=42, timeout=5)
