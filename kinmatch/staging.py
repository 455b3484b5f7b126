"""Tables written between the steps of a run."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none (tests, one machine), a temporary one is set."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinmatch-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: a later step goes on from there when executors are lost. The table goes with the driver's JVM."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver's garbage collected: its heap shrinks to what is still needed, and Spark removes what past steps shuffled. A driver may
    else not do so for long, and keeps all the memory that a large plan took."""
    gc.collect()
    spark._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Removes tables of stage() that no later step reads, and what the steps before them shuffled."""
    spark = tables[0].sparkSession
    for df in tables:
        held = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)
    collect_garbage(spark)
