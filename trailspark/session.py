"""Session settings that the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(name: str = "trailspark", cores: int | str = "*", partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster, pass the same settings to spark-submit.

    Adaptive execution sizes the shuffles: start with many partitions and let it
    join small ones and split skewed ones.
    """
    shuffle = partitions or (os.cpu_count() or 8)
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Tables that ``cut`` has written and that are still there.
_cuts: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by ``spark.checkpoint.dir``; only a local session may lack it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trailspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends, and it can be joined with what it came from."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _cuts.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete what ``cut`` wrote: to be called when the DataFrames that came of it are no longer read."""
    while _cuts:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
