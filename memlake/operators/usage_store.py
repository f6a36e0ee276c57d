"""Usage kept up by batches: moments and sketches a day, which merge for any window without the events.

usage/batch=B/      (day, kind, source, key, n, tokens, sumsq, least, most): sums and extremes, as usage_rollup has them
sketches/batch=B/   (day, kind, n, users, latency): a HyperLogLog of users and a KLL sketch of
                    latencies of each day and kind

A batch holds only its own rows' share, so entering one reads nothing that was there
before, and writing it again replaces its own folders. All merges are Spark's aggregates.
The most frequent sources come from the sums: a sketch of a fixed number of items has none
left where more sources than that are about equally frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators.telemetry import _key

#: Precision of the sketches: registers' bits, KLL's k (a rank error under 1 % for 400).
HLL_BITS, KLL_K = 14, 400
MOMENTS = "day date, kind string, source string, key string, n long, tokens long, sumsq long, least long, most long"


class UsageStore:
    """The store below a root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, audit: DataFrame, batch: int) -> None:
        """Enter audit rows (ts, kind, source, tokens, latency_ms) as one batch; rows without a time belong to no day's window, but to the whole."""
        t = F.coalesce("tokens", F.lit(0)).cast("long")
        rows = audit.withColumn("day", F.to_date("ts")).withColumns({"kind": F.coalesce("kind", F.lit("?")), "who": F.coalesce(F.col("source").cast("string"), F.lit("?"))})
        sums = rows.groupBy("day", "kind", F.col("who").alias("source"), _key().alias("key")).agg(F.count("*").alias("n"), F.sum(t).alias("tokens"), F.sum(t * t).alias("sumsq"), F.min(t).alias("least"), F.max(t).alias("most"))
        kinds = rows.groupBy("day", "kind").agg(F.count("*").alias("n"), F.hll_sketch_agg("who", F.lit(HLL_BITS)).alias("users"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(KLL_K)).alias("latency"))
        sums.write.mode("overwrite").parquet(f"{self.root}/usage/batch={batch}")
        kinds.write.mode("overwrite").parquet(f"{self.root}/sketches/batch={batch}")

    def _days(self, rows: DataFrame, first: str | None, last: str | None) -> DataFrame:
        kept: Column = F.lit(True)
        if first is not None:
            kept = kept & (F.col("day") >= F.lit(first).cast("date"))
        if last is not None:
            kept = kept & (F.col("day") <= F.lit(last).cast("date"))
        return rows.where(kept)

    def rollup(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """(key, n, tokens, sumsq, least, most, mean) of the days from first to last: usage_rollup of their events."""
        rows = self._days(self.spark.read.schema(MOMENTS).parquet(f"{self.root}/usage"), first, last)
        sums = rows.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "tokens", "sumsq")), F.min("least").alias("least"), F.max("most").alias("most"))
        return sums.withColumn("mean", F.round(F.col("tokens") / F.col("n"), 6))

    def summary(self, first: str | None = None, last: str | None = None, top: int = 5) -> DataFrame:
        """(kind, n, users, p50, p95, top): calls and the most frequent sources, as (item, count), exactly; users and latencies from the merged sketches."""
        rows = self._days(self.spark.read.parquet(f"{self.root}/sketches"), first, last)
        merged = rows.groupBy("kind").agg(F.sum("n").alias("n"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("latency").alias("latency"))
        each = self._days(self.spark.read.schema(MOMENTS).parquet(f"{self.root}/usage"), first, last).groupBy("kind", "source").agg(F.sum("n").alias("count"))
        place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("count"), "source"))
        listed = F.array_sort(F.collect_list(F.struct("place", F.col("source").alias("item"), "count")))
        most = each.withColumn("place", place).where(F.col("place") <= top).groupBy("kind").agg(F.transform(listed, lambda x: F.struct(x["item"].alias("item"), x["count"].alias("count"))).alias("top"))
        at = lambda p: F.when(F.kll_sketch_get_n_double("latency") > 0, F.kll_sketch_get_quantile_double("latency", F.lit(p)))
        return merged.join(most, "kind").select("kind", "n", F.hll_sketch_estimate("users").alias("users"), at(0.5).alias("p50"), at(0.95).alias("p95"), "top")
