"""Shared helpers of the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deleted (or split on) by every operator that speaks of white space: space, tab, LF, VT, FF, CR.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what one Arrow batch holds: few rows, as one row can be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    It is set here only where it is unset and Spark runs inside one machine; on a
    cluster without the setting this raises, as a machine-local folder would lose data.
    """
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
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with little to do
    would put off while executors' disks fill. What Python held is let go by its own
    collection first, so the driver's takes more than one turn.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/memlake-{name}-{uuid.uuid4().hex}"


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores as it takes to be none of the columns."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded_share(key: Column, n: int, total: Column | int, seed: int) -> Column:
    """Keeps about 4 * n (and 200) of total rows by a seeded hash of the key, all of them if there are fewer.

    A sample of n is then taken from what is kept: however many tasks read the table, they
    hand on a bounded number of rows together.
    """
    share = F.lit(4.0 * n + 200) / F.greatest(F.lit(1), total if isinstance(total, Column) else F.lit(total))
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53)) < share


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing will read again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, component), component the smallest id.

    Large-star/small-star contraction. Every round groups by node with partial
    aggregation, never gathers a neighbourhood into a list, and is cut by a reliable
    checkpoint. Ids that meet no edge are not returned.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    signature = lambda df: df.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
    total = signature(edges)
    for _ in range(max_rounds if total[0] else 0):
        # large star: every larger neighbour of a node links to the node's smallest neighbour (itself included)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller-or-equal neighbour links to the smallest one
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges_new = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges_new = cut(edges_new)
        sig = signature(edges_new)
        edges = edges_new
        if sig == total:
            break
        total = sig
    else:
        if total[0]:
            raise RuntimeError("components did not converge")
    star = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("id"), "component").distinct())
