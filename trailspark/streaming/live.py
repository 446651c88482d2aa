"""Streaming forms of the trace metrics (an extension; the batch operators are the reference semantics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome_counts(attempts: DataFrame, *, at: str = "ts", every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Outcomes by event-time window; rows later than ``late`` are dropped by the watermark."""
    return (
        attempts.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, every), "outcome")
        .agg(F.count("*").alias("n"), F.sum((F.col("outcome") == "PASS").cast("long")).alias("passes"))
        .select(F.col("window.start").alias("start"), "outcome", "n", "passes")
    )


def run_available(query_input: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what is there now, then stop; the result is a table of this name in memory."""
    query = query_input.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query_input.sparkSession.table(name)
