"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch.  Whole texts may be long: a Python worker holds one batch at a time.
BATCH_BYTES = 4 << 20

#: Largest table, in bytes as estimated by its builder, that is sent to all executors.
BROADCAST_BYTES = 32 << 20

#: White space of the word definitions that split on ASCII blanks only.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the bytes of the session's Arrow batches, unless the user set a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", str((1 << 31) - 1)):  # Spark's defaults
        spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it then gets a folder of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="trailspark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Helper tables and files made by this driver that are still there.
_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def clean_up(spark: SparkSession) -> None:
    """Delete all helper tables and files: to be called when the DataFrames that the operators returned are no longer read."""
    for path in list(_made):
        delete(spark, path)


def spare_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
