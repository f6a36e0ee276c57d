"""The folder that driver and executors share, and what is cut or broadcast with it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers or short strings that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; set here only where it is unset and Spark runs inside one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="memlake-")
        spark.conf.set("spark.checkpoint.dir", top)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(top)
    return top


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from there, so that nothing before it runs twice."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Marked for a broadcast if it has at most limit rows (counted first), else as it is."""
    limit = BROADCAST_ROWS if limit is None else limit
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(scan: DataFrame, *by: str) -> DataFrame:
    """A scan of which fewer parts hold rows than there are cores, dealt to all of them by the hash of by; any other scan as it is.

    A file's part holds rows only where one of its row groups lies, so parts are told by their rows, of which no column is read.

    For work that costs far more than moving its rows, as splitting texts into words: a file of one
    row group is one task otherwise. Only for what comes straight from files, as the parts are asked for.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    parts = scan.select(F.spark_partition_id().alias("part")).distinct().count()
    return scan.repartition(cores, *by) if parts < cores else scan
