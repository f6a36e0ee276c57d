"""Daily usage report from the audit events: calls, tokens, users and latencies of each kind.

    spark-submit --py-files ... jobs/daily_usage.py --events IN --output OUT [--config jobs/daily_usage.json] [--since 2024-01-31]

Events (event_id, ts, user_id, event_type, value, props) are rolled up by day and kind into
OUT/day=D/. The newest day of the output is the high-water mark: a run reads only events
from `late_days` days before it, and replaces just the days that it has rows for (dynamic
partition overwrite). So a rerun gives the same files' rows, and days that were complete
stay as they are. Events that come later than that are taken in by a run with --since.
"""

from __future__ import annotations

import argparse
import datetime
import logging
from dataclasses import dataclass

from memlake.operators import telemetry
from memlake.shared import cut
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import read_settings

log = logging.getLogger("jobs.daily_usage")
REPORT = "kind string, calls long, tokens long, mean_tokens double, most_tokens long, users long, p50_ms double, p95_ms double, day date"


@dataclass(frozen=True)
class Settings:
    late_days: int = 1


def read_report(spark: SparkSession, output: str) -> DataFrame:
    """The report as it stands; empty before the first run."""
    try:
        return spark.read.schema(REPORT).parquet(output)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REPORT)


def utc_day(ts: Column, kind: str) -> Column:
    """The day of a time in UTC, whatever the session's zone."""
    return F.to_date(ts) if kind == "timestamp_ntz" else F.date_from_unix_date(F.floor(F.unix_micros(ts) / 86_400_000_000).cast("int"))


def roll_up(events: DataFrame) -> DataFrame:
    """A row for each day and kind of events (day, kind, tokens, latency_ms, user_id); a missing kind is ?."""
    key = F.struct("day", "kind").alias("key")
    sums = telemetry.usage_rollup(events, ["day", "kind"]).select("day", "kind", F.col("n").alias("calls"), "tokens", F.col("mean").alias("mean_tokens"), F.col("most").alias("most_tokens"))
    # one row a user first, so that no day's users meet in one set
    users = events.select("day", "kind", "user_id").where("user_id is not null").distinct().groupBy("day", "kind").agg(F.count("*").alias("users"))
    late = telemetry.usage_percentiles(events.select(key, "latency_ms"), "key", "latency_ms").select("key.*", F.col("p50_linear").alias("p50_ms"), F.col("p95_linear").alias("p95_ms"))
    report = sums.join(users, ["day", "kind"], "left").join(late, ["day", "kind"])
    return report.select("kind", "calls", "tokens", "mean_tokens", "most_tokens", F.coalesce("users", F.lit(0)).alias("users"), "p50_ms", "p95_ms", "day")


def run(spark: SparkSession, events: str, output: str, settings: Settings | None = None, since: datetime.date | None = None) -> int:
    """Bring the report up to date; the number of rows written. Events without a time are left out."""
    s = settings or Settings()
    mark = read_report(spark, output).agg(F.max("day")).first()[0]
    start = since or (mark - datetime.timedelta(days=s.late_days) if mark else None)
    raw = spark.read.parquet(events)
    kind = dict(raw.dtypes)["ts"]
    rows = raw.where("ts is not null")
    if start:  # a bound on the stored column, so that it reaches the scan
        first = F.lit(start.isoformat()).cast(kind) if kind == "timestamp_ntz" else F.timestamp_micros(F.lit((start - datetime.date(1970, 1, 1)).days * 86_400_000_000))
        rows = rows.where(F.col("ts") >= first)
    tokens = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    rows = rows.select(utc_day(F.col("ts"), kind).alias("day"), F.coalesce("event_type", F.lit("?")).alias("kind"), tokens.alias("tokens"), F.col("value").alias("latency_ms"), "user_id")
    report = cut(roll_up(rows))
    report.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(output)
    n = report.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("events"), F.count("*").alias("rows"), F.count_distinct("day").alias("days")).first()
    log.info("%d events read from %s since %s, %d rows of %d days written to %s", n["events"], events, start or "the beginning", n["rows"], n["days"], output)
    return n["rows"]


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("events", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    parser.add_argument("--since", type=datetime.date.fromisoformat)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("daily_usage").getOrCreate()
    try:
        run(spark, given.events, given.output, read_settings(spark, given.config, Settings), given.since)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
