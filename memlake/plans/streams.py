"""Registered queries that run a stream over the driver's tables to its end, held against the same rows in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.plans.queries import _PAIRS, load, query
from memlake.shared import shared_dir
from memlake.streaming import pipelines

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def opened(spark, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, with its times as UTC timestamps."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{sf_dir}/{name}.parquet"
    raw = spark.read.parquet(path)
    # as a pattern: a stream takes one that matches a file or a folder, but by its name only a folder
    df = spark.readStream.schema(raw.schema).parquet(f"{sf_dir}/{name}.parque[t]")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in raw.dtypes if t == "timestamp_ntz"})


def drained(df: DataFrame, mode: str) -> DataFrame:
    """What a stream has put out when all its input is read, from files in the shared folder: no row goes through the driver."""
    spark, name = df.sparkSession, f"stream_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        out = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
        if mode == "complete":  # each batch is the whole result; the last one stays
            out = out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}-out"))
        else:
            out = out.format("parquet").option("path", f"{path}-out")
        out.start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(df.schema).parquet(f"{path}-out")


@query("select event_type || ':' || user_id as key, count(*) as n, sum(json_extract_string(props, '$.k')::bigint)::bigint as tokens from events group by 1")
def q_stream_usage(spark, sf_dir):
    e = opened(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("source"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return drained(pipelines.running_usage(e), "complete").select("key", "n", "tokens")


@query("select time_bucket(interval 1 day, ts)::date::varchar as day, event_type as kind, count(*) as n from events group by all")
def q_stream_windows(spark, sf_dir):
    e = opened(spark, sf_dir, "events").select("ts", F.col("event_type").alias("kind"), F.lit(1).alias("tokens"))
    return drained(pipelines.windowed_usage(e), "complete").select(F.to_date("start").cast("string").alias("day"), "kind", "n")


@query("""with r as (select *, sum(case when prev is null or epoch_us(ts) - epoch_us(prev) > 86400000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events))
select session, key, id from (select user_id::varchar as session, event_type as key, event_id as id, row_number() over (partition by user_id, run, event_type order by ts, event_id) as n from r) where n = 1""")
def q_stream_session_memory(spark, sf_dir):
    e = opened(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("key"), "ts", F.col("event_id").alias("id"))
    return drained(pipelines.session_memory(e), "append").select("session", "key", "id")


@query(f"with {_PAIRS}, mx as (select max(session) as s from pa), ls as (select session, max(turn_index) as t from pa group by session) select pa.session::varchar as session, pa.turn_index::bigint as turn_index, user_pos, coalesce(array_to_string(answers, ','), '') as answers from pa, mx where session < s or turn_index < (select t from ls where ls.session = mx.s)")
def q_stream_turns(spark, sf_dir):
    """A session a day, a turn a minute: all pairs leave but the last one of the session that is still open."""
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(conv_id as int), 0, cast(turn as int))")
    c = opened(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("pos"), F.col("role").alias("type"), at.alias("ts"))
    return drained(pipelines.turn_stream(c), "append").select("session", "turn_index", "user_pos", F.array_join(F.col("assistant_pos").cast("array<string>"), ",").alias("answers"))


@query("""with e as (select *, json_extract_string(props, '$.k')::int % 20 as m from events)
select c.user_id as session, c.event_id, 'src/m' || c.m || '.py' as source from e c where event_type = 'purchase' and exists (select 1 from e v where v.user_id = c.user_id and v.m = c.m and v.ts > c.ts and v.ts <= c.ts + interval 24 hours and v.event_type = 'view')""")
def q_stream_later_use(spark, sf_dir):
    m = F.get_json_object("props", "$.k").cast("int") % 20
    chunks = opened(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("session"), "event_id", "ts", F.format_string("src/m%d.py", m).alias("source"))
    seen = opened(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("session"), F.col("ts").alias("ets"), F.format_string("/repo/src/m%d.py", m).alias("path"))
    return drained(pipelines.later_use(chunks, seen), "append").select("session", "event_id", "source")


@query("select user_id::varchar as session, event_type as key from events group by all")
def q_stream_dedup_within(spark, sf_dir):
    """With a watermark longer than the table, each key of a session comes once."""
    e = opened(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("key"), "ts")
    return drained(pipelines.dedup_within(e, 24 * 365), "append").select("session", "key")


@query("select event_id from events order by ts desc nulls last, event_id desc limit 50")
def q_stream_newest(spark, sf_dir):
    """The live view's ring of the 50 newest rows, over batches in which the newest come neither first nor last."""
    path = f"{shared_dir(spark).rstrip('/')}/newest-{uuid.uuid4().hex}"
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    for k in (2, 0, 4, 1, 3):  # a fifth of the table each, dealt by the hash of the id; files are taken by their age
        raw.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(f"{path}-in")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}-in")
    stream.writeStream.foreachBatch(pipelines.newest(50, path, ("ts", "event_id"))).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return pipelines.read_newest(spark, path, raw.schema).select("event_id")




@query("select event_type || ':' || user_id as key, count(*) as n, sum(json_extract_string(props, '$.k')::bigint)::bigint as tokens from events group by 1")
def q_stream_audit_log(spark, sf_dir):
    """The audit log's files as a stream that is taken up twice: the second run reads only what came after the first."""
    root = f"{shared_dir(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    line = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("source"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    events = load(spark, sf_dir, "events").select(F.pmod("event_id", F.lit(2)).alias("half"), line.alias("e"))
    for half in range(2):
        events.where(F.col("half") == half).select("e.*").write.mode("append").json(f"{root}/in")
        rows = pipelines.audit_tail(spark, f"{root}/in", ".json").select("kind", "source", "tokens")
        rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy(F.concat_ws(":", "kind", "source").alias("key")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
