"""The driver's tables in the shapes of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Event types as outcomes and tools; SYNTAX_ERROR stays unseen.
OUTCOME = {"purchase": "PASS", "view": "ASSERTION_FAILURE", "error": "RUNTIME_ERROR", "click": "TIMEOUT"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    outcome = F.when(e == "purchase", "PASS").when(e == "view", "ASSERTION_FAILURE").when(e == "error", "RUNTIME_ERROR").when(e == "click", "TIMEOUT").otherwise("OTHER")
    tool = F.when(e == "click", "apply_patch").when(e == "signup", "read_file").otherwise("python_test")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("task"), "ts", F.to_date("ts").alias("day"), "value", outcome.alias("outcome"), tool.alias("tool"), (outcome == "PASS").alias("passed")
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with the outcome predicted: the user's previous one."""
    w = Window.partitionBy("task").orderBy("ts", "event_id")
    return attempts(spark, sf_dir).withColumn("predicted", F.lag("outcome").over(w))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("predicted") == "PASS", "KEEP").otherwise("REVISE")
    return steps(spark, sf_dir).select("event_id", "task", F.col("predicted").alias("sampled_prediction"), F.col("outcome").alias("actual"), decision.alias("decision"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace per user and day."""
    row = F.struct("ts", "event_id", "tool", "outcome", "predicted")
    rows = F.array_sort(F.collect_list(row))
    grouped = steps(spark, sf_dir).groupBy(F.concat_ws("/", F.col("task").cast("string"), F.col("day").cast("string")).alias("task")).agg(rows.alias("r"))
    call_id = lambda x: F.concat(F.lit("c"), x["event_id"].cast("string"))
    tests = F.filter("r", lambda x: x["tool"] == "python_test")
    result = lambda x: F.struct(call_id(x), F.struct((x["outcome"] == "PASS").alias("success"), x["outcome"].alias("outcome")))
    target = lambda x: F.struct(x["predicted"].alias("sampled_prediction"), x["outcome"].alias("actual"), F.when(x["predicted"] == "PASS", "KEEP").otherwise("REVISE").alias("decision"))
    return grouped.select(
        "task", (F.element_at("r", -1)["outcome"] == "PASS").alias("solved"), F.transform("r", lambda x: F.struct(x["tool"].alias("tool"), call_id(x).alias("id"))).alias("calls"),
        F.map_from_entries(F.transform("r", result)).alias("results"), F.transform(tests, target).alias("targets"), (F.size("r") * 7).cast("long").alias("n_tokens"),
    )
