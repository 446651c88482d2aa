"""Programs for the operators that run code, a few by hand and others made from the keys of a table; no table of the driver has any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TASKS = [
    ("has_key", "def has_key(d, k):\n    if k in d:\n        return True\n    return False\n", "assert has_key({1: 2}, 1)\nassert not has_key({}, 1)\n"),
    ("total", "def total(xs):\n    out = 0\n    for x in xs:\n        out = out + x\n    return out\n", "assert total([1, 2]) == 3\nassert total([]) == 0\n"),
    ("at", "def at(xs, i):\n    j = i + 1\n    return xs[j - 1]\n", "assert at([5, 6], 0) == 5\nassert at([5, 6], 1) == 6\n"),
]
_CANDIDATES = [
    ("pass", "x = 1\n", "assert x == 1"), ("assertion", "x = 1\n", "assert x == 2"), ("runtime", "x = {}['a']\n", "assert x"), ("syntax", "def f(:\n", ""),
    ("indent", "def f():\nreturn 1\n", ""), ("loop", "while True:\n    pass\n", ""), ("exit", "raise SystemExit(0)\n", "assert False"), ("forged", "print('passed-0')\nraise SystemExit(0)\n", "assert False"), ("other", "import os\nos._exit(3)\n", ""),
]


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TASKS, "case_id string, code string, test_code string")


def candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CANDIDATES, "case_id string, code string, test_code string")


def generated(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """A program of five lines for each row."""
    number = lambda n, base: (F.col(key) % n + base).cast("string")
    code = F.format_string("def f(x):\n    y = x + %s\n    if y >= %s:\n        return y\n    return min(y, %s)\n", number(7, 1), number(11, 20), number(5, 50))
    return rows.select(F.concat(F.lit("doc_"), F.col(key).cast("string")).alias("case_id"), code.alias("code"))


def candidates_of(rows: DataFrame, key: str) -> DataFrame:
    """A candidate of every outcome in turn, no two of them equal."""
    k = F.col(key).cast("string")
    bodies = ["x = 1", "x = 2", "x = {}['a']", "def f(:", "raise SystemExit(0)", "while True: pass"]
    body = F.element_at(F.array(*(F.lit(b) for b in bodies)), (F.col(key) % len(bodies)).cast("int") + 1)
    return rows.select(k.alias("case_id"), F.concat(F.lit("n = "), k, F.lit("\n"), body, F.lit("\n")).alias("code"), F.lit("assert x == 1\n").alias("test_code"))


def doubling(rows: DataFrame, key: str) -> DataFrame:
    """Tasks whose solution is twice the sum of the argument and the key."""
    k = F.col(key).cast("int")
    code = F.format_string("def f(x):\n    y = x + %d\n    return y * 2\n", k)
    tests = F.format_string("assert f(3) == %d\nassert f(0) == %d\n", 2 * (3 + k), 2 * k)
    return rows.select(F.col(key).cast("string").alias("case_id"), code.alias("code"), tests.alias("test_code"))


def doubling_or_not(rows: DataFrame, key: str) -> DataFrame:
    """``doubling`` tasks by turns with tasks that no test fails and tasks whose only failure is that of one token."""
    made = doubling(rows, key).withColumn("k", F.col("case_id").cast("int"))
    free = F.format_string("def f(x):\n    y = x + %d\n    return y * 2\n", F.col("k"))
    single = F.format_string("def f(x):\n    return x * %d\n", F.col("k"))
    kind = F.col("k") % 3
    code = F.when(kind == 0, F.col("code")).when(kind == 1, free).otherwise(single)
    tests = F.when(kind == 0, F.col("test_code")).when(kind == 1, F.lit("assert f(0) is not None\n")).otherwise(F.format_string("assert f(0) == 0 or f(1) + 1 == %d\n", F.col("k") + 1))
    return made.select("case_id", F.col("k").cast("long").alias("task_id"), F.concat(F.lit("task "), "case_id").alias("prompt"), code.alias("code"), tests.alias("test_code"))


def sft_tasks(rows: DataFrame, key: str) -> DataFrame:
    """Tasks that add up numbers from the key on, in each recovery mode by turns."""
    k = F.col(key).cast("long")
    source = lambda start, sum_: F.concat(F.lit("def total(xs):\n"), start, F.lit("    for x in xs:\n"), F.lit(sum_), F.lit("    return out\n"))
    start = lambda n: F.concat(F.lit("    out = "), n.cast("string"), F.lit("\n"))
    wrong_sum, right_sum = "        out = out - x\n", "        out = out + x\n"
    mode = F.element_at(F.array(F.lit(None).cast("string"), *(F.lit(m) for m in ("shadow", "visible", "deep_shadow", "deep_visible"))), (k % 5).cast("int") + 1)
    some, deep = k % 5 > 0, k % 5 > 2
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))
    fail = F.lit("ASSERTION_FAILURE")
    return rows.select(
        k.alias("task_id"), F.concat_ws("_", F.coalesce(mode, F.lit("direct")), k.cast("string")).alias("case_id"), mode.alias("mode"), source(start(k), right_sum).alias("code"),
        F.when(deep, source(start(k + 1), wrong_sum)).when(some, source(start(k), wrong_sum)).alias("initial_code"),
        F.when(some, fail).alias("outcome_1"), F.when(some, F.lit(wrong_sum)).alias("find_1"), F.when(some, F.lit(right_sum)).alias("replace_1"),
        F.when(deep, fail).alias("outcome_2"), F.when(deep, start(k + 1)).alias("find_2"), F.when(deep, start(k)).alias("replace_2"),
        F.format_string("assert total([1, 2]) == %s\nassert total([]) == %s\n", (k + 3).cast("string"), k.cast("string")).alias("test_code"),
        F.lit("data/blueprints/total").alias("trace_prefix"), F.array(message("system", "s"), message("user", "u")).alias("prompt"),
    )
