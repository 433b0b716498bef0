"""Tables in the shared folder, which cut lineage and survive lost executors; rows dealt by number."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where none is set and all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or "file://" + tempfile.mkdtemp(prefix="lumenlog-")).rstrip("/")


def written(df: DataFrame, tag: str = "step") -> DataFrame:
    """`df` as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/lumenlog-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """`df` dealt by `keys` to one partition for each `TASK_ROWS` rows of `of` (default: itself), at least one a core if that
    is less than one for each eighth of them.

    Spark merges partitions by their compressed bytes, of which sorted keys and times have very few, so that a task may
    get millions of rows and sort them several times over; partitions of a given number are left as they are."""
    rows = (df if of is None else of).count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(rows // TASK_ROWS, min(cores, rows * 8 // TASK_ROWS)) + 1, *keys)
