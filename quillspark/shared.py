"""What jobs share: cutting lineage in the folder that all executors see, and small helpers.

The folder is the one that ``spark.checkpoint.dir`` names. Only a session on one machine
(tests) may leave it unset; a temporary folder is set then. On a cluster that is an error:
a folder of one machine can't be read by the others.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many rows (a few dozen bytes each) may be sent to all executors.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; set to a temporary one if a session on one machine names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, for tables of many rows: a Parquet table in the shared folder, which takes a
    fraction of a checkpoint's room."""
    at = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def together(jobs: list[Callable[[], object]]) -> list:
    """Runs independent jobs side by side, so that small ones don't wait for each other; the first error is raised."""
    with ThreadPoolExecutor(max_workers=8) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (cut, of slim rows) marked for sending to all executors if it is counted to have
    at most ``rows`` rows; otherwise as it is, and joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` (just read) over all cores where its files give fewer tasks than half of them: a
    table of one row group would keep one core busy. Tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
