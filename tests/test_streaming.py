from datetime import datetime, timedelta
from unittest.mock import MagicMock

import pandas as pd
from memlake.plans import streams
from memlake.streaming import pipelines as P
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def run(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def source(spark, tmp_path, rows, schema, name="in"):
    path = str(tmp_path / name)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        del i
    return spark.readStream.schema(schema).parquet(path)


def test_running_usage(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","kind":"k","source":"s","tokens":2}\nbad\n{"ts":"2024-01-01T01:00:00Z","kind":"k","source":"s","tokens":4}\n')
    got = run(P.running_usage(P.audit_tail(spark, str(tmp_path)).where("kind is not null")), "complete", tmp_path, "usage")
    assert [(r["key"], r["n"], r["tokens"]) for r in got] == [("k:s", 2, 6)]


def test_dedup_and_windows(spark, tmp_path):
    rows = [("s", "k", T0, "a", 1), ("s", "k", T0 + timedelta(hours=1), "a", 2), ("s", "l", T0, "a", 4)]
    schema = "session string, key string, ts timestamp, kind string, tokens long"
    df = source(spark, tmp_path, [rows], schema)
    assert len(run(P.dedup_within(df), "append", tmp_path, "dedup")) == 2
    got = run(P.windowed_usage(df), "complete", tmp_path, "win")
    assert [(r["n"], r["tokens"]) for r in got] == [(3, 7)]
    assert len(run(P.session_usage(df), "complete", tmp_path, "sess")) == 2


def test_later_use(spark, tmp_path):
    chunks = source(spark, tmp_path, [[("s", T0, "src/a.py"), ("s", T0, "src/b.py")]], "session string, ts timestamp, source string", "chunks")
    events = source(spark, tmp_path, [[("s", T0 + timedelta(hours=2), "/r/src/a.py"), ("s", T0 - timedelta(hours=2), "/r/src/b.py")]], "session string, ets timestamp, path string", "events")
    got = run(P.later_use(chunks, events), "append", tmp_path, "later")
    assert [r["source"] for r in got] == ["src/a.py"]


def test_turn_stream(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("s", 0, "assistant", at(0), False), ("s", 1, "user", at(1), False), ("s", 2, "assistant", at(2), False), ("s", 3, "assistant", at(2), True), ("s", 4, "summary", at(3), False), ("s", 5, "user", at(3), False), ("s", 6, "assistant", at(4), False)]
    later = [("t", 0, "user", at(600), False)]
    df = source(spark, tmp_path, [rows, later], "session string, pos long, type string, ts timestamp, isSidechain boolean")
    df = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(P.turn_stream(df), "append", tmp_path, "turns")
    assert sorted((r["session"], r["turn_index"], r["user_pos"], r["assistant_pos"]) for r in got) == [("s", 0, 1, [2]), ("s", 1, 5, [6])]  # the last pair leaves as the session is silent


def test_session_memory(spark, tmp_path):
    h = lambda n: T0 + timedelta(hours=n)
    rows = [("s", "k", h(0), 1), ("s", "k", h(23), 2), ("s", "l", h(23), 3), ("s", "k", h(46), 4), ("s", "k", h(71), 5), ("t", "k", h(1), 6)]
    df = source(spark, tmp_path, [rows], "session string, key string, ts timestamp, id long", "mem")
    got = run(P.session_memory(df), "append", tmp_path, "memory")
    assert sorted(r["id"] for r in got) == [1, 3, 5, 6]  # every row puts the session's end off


def test_newest_is_a_ring_over_all_batches(spark, tmp_path):
    path, schema = str(tmp_path / "ring"), spark.createDataFrame([], "ts timestamp, id long").schema
    batch = lambda *days: spark.createDataFrame([(T0 + timedelta(d), d) for d in days], schema)
    keep = P.newest(3, path)
    ring = lambda: sorted(r["id"] for r in P.read_newest(spark, path, schema).collect())
    assert ring() == []
    keep(batch(10, 11, 12, 13), 0)
    assert ring() == [11, 12, 13]
    keep(batch(1, 2, 3, 4), 1)  # an older batch takes no place
    assert ring() == [11, 12, 13]
    keep(batch(5, 12, 20), 2)
    assert ring() == [12, 13, 20] or ring() == [12, 12, 13, 20][1:]
    before = ring()
    keep(batch(5, 12, 20), 2)  # the same batch once more
    assert ring() == before
    keep(batch(), 3)
    assert ring() == before


def test_session_memory_goes_on_over_batches_and_ends_to_the_microsecond(spark, tmp_path):
    at = lambda **k: T0 + timedelta(**k)
    # within one millisecond: the session's last microsecond, and the next
    first = [("s", "k", at(microseconds=500), 1), ("s", None, at(microseconds=500), 2), ("t", "k", at(microseconds=500), 3)]
    second = [("s", "k", at(days=1, microseconds=500), 4), ("s", "l", at(days=1, microseconds=500), 5), ("t", "k", at(days=1, microseconds=501), 6)]
    third = [("u", "k", at(days=9), 7)]
    source(spark, tmp_path, [first, second, third], "session string, key string, ts timestamp, id long", "mem")
    df = spark.readStream.schema("session string, key string, ts timestamp, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "mem"))
    got = run(P.session_memory(df), "append", tmp_path, "memory_batches")
    assert sorted(r["id"] for r in got) == [1, 2, 3, 5, 6, 7]


def test_session_memory_asks_the_store_as_often_for_many_rows_as_for_one():
    def calls(n):
        handle = MagicMock()
        handle.getValueState.return_value.get.return_value = (["a"], 10**15)
        memory = P.SessionMemory(86_400_000_000, 2000)
        memory.init(handle)
        us = range(10**15, 10**15 + n)
        rows = pd.DataFrame({"session": "s", "key": [f"k{i}" for i in us], "ts": pd.to_datetime(us, unit="us"), "id": us, "us": us})
        assert sum(len(x) for x in memory.handleInputRows(("s",), iter([rows]), None)) == n
        return len(handle.mock_calls)

    assert calls(1) == calls(1000) <= 6


def test_drained_rows_lie_in_files(spark, tmp_path):
    schema = "session string, key string, ts timestamp"
    for n, rows in enumerate(([], [("s", "k", T0), ("s", "k", T0), ("s", "l", T0)])):
        df = source(spark, tmp_path, [rows], schema, f"drained{n}")
        out = streams.drained(P.dedup_within(df), "append")
        assert out.count() == 2 * n and (n == 0 or out.inputFiles())
        whole = streams.drained(df.groupBy("session").count(), "complete")
        assert [tuple(r) for r in whole.collect()] == [("s", 3)] * n and whole.inputFiles()
