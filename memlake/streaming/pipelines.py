"""Streams over the audit log, sessions and transcripts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from memlake.functions.scalars import same_target
from memlake.operators.telemetry import usage_rollup
from memlake.operators.turns import SKIPPED
from memlake.sources.log_lines import LogLines
from memlake.sources.readers import AUDIT

running_usage = usage_rollup  # sums, counts and extremes: the batch aggregate is the streaming one (update mode)


def audit_tail(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """The audit log's files as a stream; ts becomes a timestamp, blank and malformed lines are dropped.

    Lines come as they are added; a file that was truncated or replaced starts again.
    """
    spark.dataSource.register(LogLines)
    lines = spark.readStream.format("log_lines").option("suffix", suffix).load(path)
    event = lines.select(F.from_json("line", f"{AUDIT}, broken_ string", {"columnNameOfCorruptRecord": "broken_"}).alias("e")).where("e is not null and e.broken_ is null")
    return event.select("e.*").drop("broken_").withColumn("ts", F.try_to_timestamp("ts"))


def newest(n: int, path: str, order: Sequence[str] = ("ts",)) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the newest n rows of the whole stream below a path, in a folder a batch.

    A batch's ring is the newest of its own rows and of the ring before it, so rows that
    arrive late take their place. A batch that runs again replaces its own ring and starts
    from the same one; at most n rows are read and written a batch.
    """

    def keep(df: DataFrame, batch: int) -> None:
        before = read_newest(df.sparkSession, path, df.schema, batch)
        ring = df.unionByName(before).orderBy(*(F.desc(c) for c in order)).limit(n)
        ring.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return keep


def read_newest(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The ring that the last batch (before the given one) left; empty where none did."""
    try:
        rings = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    rings = rings if before is None else rings.where(F.col("batch") < before)
    last = rings.agg(F.max("batch")).first()[0]
    return rings.where(F.col("batch") == (-1 if last is None else last)).select(*schema.names)


def dedup_within(rows: DataFrame, hours: int = 24) -> DataFrame:
    """The first row of each (session, key) within the watermark: bounded state, one entry a key."""
    return rows.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["session", "key"])


def windowed_usage(audit: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tokens and calls of each kind by time window, late rows accepted up to the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return audit.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n", "tokens")


def session_usage(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each session between gaps."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.session_window("ts", gap).alias("w"), "session").agg(F.count("*").alias("n")).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def later_use(chunks: DataFrame, events: DataFrame, hours: int = 24) -> DataFrame:
    """Chunks whose file a later event of the session works on, as a stream-stream semi join within the watermarks: the batch rule's paths."""
    c = chunks.withWatermark("ts", f"{hours} hours").alias("c")
    e = events.withWatermark("ets", f"{hours} hours").select(F.col("session").alias("es"), "ets", "path", F.element_at(F.split("path", "/"), -1).alias("ebase")).alias("e")
    on = F.expr(f"c.session = e.es and element_at(split(c.source, '/'), -1) = e.ebase and e.ets > c.ts and e.ets <= c.ts + interval {hours} hours") & same_target(F.col("e.path"), F.col("c.source"))
    return c.join(e, on, "left_semi")


class TurnPairing(StatefulProcessor):
    """Pairs the turns of a session as its events arrive: a pair leaves when the next user event comes, the last one when the session falls silent."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "turn long, user_pos long, answers array<long>, timer long")

    def _row(self, key: Any, turn: int, user: int, answers: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], turn, user, answers)], columns=["session", "turn_index", "user_pos", "assistant_pos"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, user, answers, timer = self.open.get() if self.open.exists() else (-1, None, [], None)
        answers, out = list(answers or []), []
        events = pd.concat(list(rows)).sort_values("pos")
        for pos, kind in zip(events["pos"], events["type"], strict=True):
            if kind == "user":
                if user is not None:
                    out.append(self._row(key, turn, user, answers))
                turn, user, answers = turn + 1, int(pos), []
            elif kind == "assistant" and user is not None:
                answers.append(int(pos))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = int(events["ts"].max().timestamp() * 1000) + self.idle_ms
        self.handle.registerTimer(timer)
        self.open.update((turn, user, answers, timer))
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            turn, user, answers, _ = self.open.get()
            self.open.clear()
            if user is not None:
                yield self._row(key, turn, user, list(answers or []))

    def close(self) -> None:
        pass


def turn_stream(events: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(session, turn_index, user_pos, assistant_pos) of a stream (session, pos, type, ts, optional isSidechain).

    Side chains and types that are no turns are left out. A session's state goes when it has
    been silent for the idle time; turns that come after that are counted from 0 again.
    """
    kept = events.where(~F.col("type").isin(*SKIPPED))
    if "isSidechain" in events.columns:
        kept = kept.where(~F.coalesce("isSidechain", F.lit(False)))
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    schema = "session string, turn_index long, user_pos long, assistant_pos array<long>"
    return kept.select("session", "pos", "type", "ts").withWatermark("ts", late).groupBy("session").transformWithStateInPandas(TurnPairing(ms), schema, "Append", "EventTime")


class SessionMemory(StatefulProcessor):
    """The first row of each key of a session; the whole memory goes once the session was silent for its time, and every row puts that off.

    A session's memory is read once and written once a batch: a call to the store costs far more than a row's work.
    """

    def __init__(self, ttl_us: int, most: int) -> None:
        self.ttl_us, self.most = ttl_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "seen array<string>, until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["us", "id"])
        held = self.memory.get()
        seen, until = (set(held[0]), held[1]) if held else (set(), None)
        before, out = until, []
        for i, (k, us) in enumerate(zip(events["key"].tolist(), events["us"].tolist(), strict=True)):
            if until is not None and us > until:
                seen.clear()
            if k not in seen:
                seen.add(k)
                out.append(i)
            until = us + self.ttl_us if until is None else max(until, us + self.ttl_us)
        if until != before:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.handle.registerTimer(self._timer(until))
        if out or until != before:
            kept = sorted(seen, key=lambda k: (k is not None, k))[-self.most :] if len(seen) > self.most else list(seen)
            self.memory.update((kept, until))
        if out:
            yield events.iloc[out][["session", "key", "ts", "id"]]

    @staticmethod
    def _timer(until: int) -> int:
        """The first millisecond after the end: a row in time is never behind it."""
        return until // 1000 + 1

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.memory.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_memory(rows: DataFrame, hours: float = 24, most: int = 2000, late: str = "10 minutes") -> DataFrame:
    """(session, key, ts, id) of rows (session, key, ts, id) that their session had not seen: exact, with one lifetime a session.

    The memory of a session keeps its `most` greatest keys, as its stored form does.
    """
    df = rows.select("session", "key", "ts", "id", F.unix_micros("ts").alias("us")).withWatermark("ts", late).groupBy("session")
    schema = f"session string, key string, ts timestamp, id {dict(rows.dtypes)['id']}"
    return df.transformWithStateInPandas(SessionMemory(int(hours * 3_600_000_000), most), schema, "Append", "EventTime")
