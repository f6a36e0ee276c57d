import datetime
import json
import os
import subprocess
import sys

import duckdb
import pytest
from jobs import daily_usage, document_memory, queries
from jobs.settings import read_settings
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
T = datetime.datetime(2024, 3, 1, 12)


def add_file(spark, folder, rows, schema):
    """One more file in a folder that a job reads."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def chunks(spark, output):
    return sorted((r["doc_id"], r["chunk_idx"], r["document"], r["lang"]) for r in document_memory.current_chunks(spark, output).collect())


def text(word, n=100):
    return " ".join(f"{word}{i}" for i in range(n))


def test_document_memory_takes_only_what_is_new(spark, tmp_path):
    given, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    add_file(spark, given, [(1, text("a"), "en", "s"), (2, text("b", 200), None, "s"), (3, None, "en", None), (None, text("n"), "en", "s"), (4, "too short", "en", "s")], document_memory.DOCUMENT)
    assert document_memory.run(spark, given, out, state) == 1
    first = chunks(spark, out)
    assert [(d, i, la) for d, i, _, la in first] == [(1, 0, "en"), (2, 0, None), (2, 1, None)]
    assert first[1][2].split()[-16:] == first[2][2].split()[:16]
    assert document_memory.run(spark, given, out, state) == 0
    assert chunks(spark, out) == first
    # a changed, a repeated, a new and an emptied document
    add_file(spark, given, [(1, text("changed"), "en", "s"), (2, text("b", 200), None, "s"), (5, text("e"), "de", "s")], document_memory.DOCUMENT)
    assert document_memory.run(spark, given, out, state) == 1
    second = chunks(spark, out)
    assert [(d, i) for d, i, _, _ in second] == [(1, 0), (2, 0), (2, 1), (5, 0)] and second[0][2].startswith("changed0")
    stored = spark.read.parquet(f"{out}/versions")
    assert sorted((r["doc_id"], r["batch"]) for r in stored.collect()) == [(1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]
    add_file(spark, given, [(5, "", "de", "s")], document_memory.DOCUMENT)
    document_memory.run(spark, given, out, state)
    assert [d for d, *_ in chunks(spark, out)] == [1, 2, 2]


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    given, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for i in range(3):
        add_file(spark, given, [(i, text(f"w{i}", 300), "en", "s"), (9, text(f"v{i}"), "en", "s")], document_memory.DOCUMENT)
        document_memory.run(spark, given, out, state)
    before, versions = chunks(spark, out), spark.read.parquet(f"{out}/versions").count()
    # as after a failure between the output and the stream's own mark
    for name in os.listdir(f"{state}/commits"):
        if name.strip(".").startswith("2"):
            os.remove(f"{state}/commits/{name}")
    assert document_memory.run(spark, given, out, state) == 1
    assert chunks(spark, out) == before and spark.read.parquet(f"{out}/versions").count() == versions


def test_half_a_batch_is_not_read(spark, tmp_path):
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    add_file(spark, given, [(1, text("a"), "en", "s")], document_memory.DOCUMENT)
    document_memory.run(spark, given, out, str(tmp_path / "state"))
    whole = chunks(spark, out)
    spark.read.schema(document_memory.CHUNK).parquet(f"{out}/chunks").drop("batch").withColumn("document", F.lit("half")).write.partitionBy("lang").parquet(f"{out}/chunks/batch=1")
    assert chunks(spark, out) == whole


def test_the_youngest_file_of_a_batch_decides(spark, tmp_path):
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, word in enumerate(("old", "young")):
        folder = tmp_path / f"one{i}"
        add_file(spark, folder, [(1, text(word), "en", "s")], document_memory.DOCUMENT)
        os.makedirs(given, exist_ok=True)
        (file,) = folder.glob("part-*")
        os.rename(file, f"{given}/{word}.parquet")
        os.utime(f"{given}/{word}.parquet", (1_700_000_000 + i * 60,) * 2)
    document_memory.run(spark, given, out, str(tmp_path / "state"))
    assert [c[2].split()[0] for c in chunks(spark, out)] == ["young0"]


EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(i, day, value=1.0, kind="view", user=1, k=2):
    return (i, T + datetime.timedelta(days=day), user, kind, value, json.dumps({"k": k}))


def report(spark, output):
    return {(str(r["day"]), r["kind"]): (r["calls"], r["tokens"], r["users"], r["p50_ms"]) for r in daily_usage.read_report(spark, output).collect()}


def test_daily_usage_over_growing_input(spark, tmp_path):
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    add_file(spark, given, [event(1, 0), event(2, 0, 3.0, user=2), event(3, 1), event(4, 2, kind=None), (5, None, 1, "view", 1.0, "{}"), (6, T, None, "empty", None, "broken")], EVENT)
    assert daily_usage.run(spark, given, out) == 4
    first = report(spark, out)
    assert first == {("2024-03-01", "view"): (2, 4, 2, 2.0), ("2024-03-01", "empty"): (1, 0, 0, None), ("2024-03-02", "view"): (1, 2, 1, 1.0), ("2024-03-03", "?"): (1, 2, 1, 1.0)}
    old = {p.name for p in (tmp_path / "out" / "day=2024-03-01").iterdir()}
    assert daily_usage.run(spark, given, out) == 2 and report(spark, out) == first
    # more of the newest day, a late one within the limit, and one beyond it
    add_file(spark, given, [event(7, 2, k=5), event(8, 3), event(9, 1, 9.0), event(10, 0)], EVENT)
    daily_usage.run(spark, given, out)
    second = report(spark, out)
    assert second[("2024-03-03", "view")] == (1, 5, 1, 1.0) and second[("2024-03-04", "view")] == (1, 2, 1, 1.0) and second[("2024-03-02", "view")] == (2, 4, 1, 5.0)
    assert second[("2024-03-01", "view")] == (2, 4, 2, 2.0) and {p.name for p in (tmp_path / "out" / "day=2024-03-01").iterdir()} == old
    daily_usage.run(spark, given, out, since=datetime.date(2024, 3, 1))
    assert report(spark, out)[("2024-03-01", "view")][0] == 3


def test_days_do_not_depend_on_the_session_zone(spark, tmp_path):
    for kind in ("timestamp", "timestamp_ntz"):
        given, out = str(tmp_path / f"in-{kind}"), str(tmp_path / f"out-{kind}")
        spark.createDataFrame([event(1, 0), event(2, 1)], EVENT).withColumn("ts", F.col("ts").cast(kind)).write.parquet(given)
        zone = spark.conf.get("spark.sql.session.timeZone")
        try:
            spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
            daily_usage.run(spark, given, out)
            daily_usage.run(spark, given, out)
            assert sorted(report(spark, out)) == [("2024-03-01", "view"), ("2024-03-02", "view")]
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)


def test_settings(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"words": 64}')
    assert read_settings(spark, str(path), document_memory.Settings).words == 64
    assert read_settings(spark, None, daily_usage.Settings).late_days == 1
    path.write_text('{"word": 64}')
    with pytest.raises(ValueError, match="word"):
        read_settings(spark, str(path), document_memory.Settings)
    for name, kind in (("document_memory", document_memory.Settings), ("daily_usage", daily_usage.Settings)):
        assert read_settings(spark, f"{ROOT}/jobs/{name}.json", kind) == kind()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_jobs_against_sql(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf)
    db = duckdb.connect()
    for t in ("documents", "events"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = db.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in rows.select(*names).collect())


def test_command_line(tmp_path, sf):
    given = [sys.executable, f"{ROOT}/jobs/daily_usage.py", "--events", f"{sf}/events.parquet", "--output", str(tmp_path / "report"), "--config", f"{ROOT}/jobs/daily_usage.json"]
    done = subprocess.run(given, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=180, check=True)
    assert "events read from" in done.stderr and list((tmp_path / "report").glob("day=2024-*"))
