import datetime

import pytest
from memlake.functions import udtfs
from memlake.operators import admin, ingest, telemetry
from memlake.operators.usage_store import UsageStore
from memlake.sources import readers
from pyspark.sql import functions as F

T = datetime.datetime(2024, 3, 1, 12)
AUDIT = "ts timestamp, kind string, source string, tokens long, latency_ms double"


def test_usage_store_equals_the_rollup(spark, tmp_path):
    rows = [(T + datetime.timedelta(days=i % 4), ["a", "b", None][i % 3], f"s{i % 7}", i if i % 5 else None, float(i) if i % 6 else None) for i in range(200)] + [(None, "a", "s1", 9, 1.0)]
    df = spark.createDataFrame(rows, AUDIT)
    store = UsageStore(spark, str(tmp_path / "u"))
    for batch in (0, 1, 2, 1):
        store.write(df.where(F.pmod(F.xxhash64("ts", "tokens"), F.lit(3)) == batch), batch)
    order = ["key", "n", "tokens", "sumsq", "least", "most", "mean"]
    take = lambda d: sorted(map(tuple, d.select(order).collect()))
    assert take(store.rollup()) == take(telemetry.usage_rollup(df))
    days = df.where("ts >= '2024-03-02' and ts < '2024-03-04'")
    assert take(store.rollup("2024-03-02", "2024-03-03")) == take(telemetry.usage_rollup(days))
    found = {r["kind"]: r for r in store.summary().collect()}
    assert found["a"]["n"] == 68 and found["?"]["n"] == 66 and found["a"]["users"] == 7
    assert abs(found["b"]["p50"] - 100) < 10 and len(found["b"]["top"]) == 5


def test_most_frequent_sources_of_many(spark, tmp_path):
    """Five thousand sources about equally frequent: none would stand out in a sketch of a thousand."""
    df = spark.range(30_001).select(F.lit(T).alias("ts"), F.lit("a").alias("kind"), F.concat(F.lit("s"), (F.col("id") % 5_000).cast("string")).alias("source"), F.lit(1).cast("long").alias("tokens"), F.lit(1.0).alias("latency_ms"))
    store = UsageStore(spark, str(tmp_path / "u"))
    for batch in (0, 1):
        store.write(df.where(F.pmod(F.xxhash64("source"), F.lit(2)) == batch), batch)
    assert [tuple(x) for x in store.summary().first()["top"]] == [("s0", 7), ("s1", 6), ("s10", 6), ("s100", 6), ("s1000", 6)]


def test_pages(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("id"), F.lit("x").alias("place_x")).repartition(7)
    got = ingest.paged(df, 64)
    assert got.columns == ["id", "place_x", "page"] and all(r["page"] == r["id"] // 64 for r in got.collect())
    assert ingest.paged(df.limit(0), 64).count() == 0
    pages = list(ingest.scroll(df, 300, after=99))
    assert [(len(p), p[0]["id"], at) for p, at in pages] == [(300, 100, 399), (300, 400, 699), (300, 700, None)]


def test_tree_digest(spark):
    digest = lambda *rows: readers.tree_digest(spark.createDataFrame(list(rows), "path string, content string")).first()["digest"]
    one = digest(("a", "x"), ("b", "y"), ("b", "y"))
    assert one == digest(("b", "y"), ("a", "x"), ("b", "y")) != digest(("a", "x"), ("b", "y"))
    assert digest(("ab", "c")) != digest(("a", "bc")) and digest(("a", None)) == digest(("a", "")) != digest()


def test_snapshot_cut_is_the_fold(spark):
    rows = [(i, t) for i, t in enumerate(["x" * 40, " \n ", " y\n" * 30, "z" * 400, "w"])]
    for tokens, lines in ((50, 500), (3000, 500), (3000, 10), (5, 500), (40, 33)):
        want = admin.snapshot_budget([(str(i), t) for i, t in rows], tokens, lines)
        got = admin.snapshot_cut(spark.createDataFrame(rows, "rk int, text string"), tokens, lines).orderBy("rk").collect()
        assert [(str(r["rk"]), r["text"]) for r in got] == want


def test_table_functions(spark):
    udtfs.register_all(spark)
    spark.createDataFrame([(1, "# A\nx\n# B\ny"), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("udtf_docs")
    got = spark.sql("select id, c.* from udtf_docs, lateral chunk_text(text) c").collect()
    assert sorted((r["id"], r["chunk_idx"], r["document"]) for r in got) == [(1, 0, "x"), (1, 1, "y")]
    with pytest.raises(Exception, match="nonsense"):
        spark.sql("select * from udtf_docs, lateral chunk_text(text, 'nonsense')").collect()
    rows = [("s", 3, "assistant"), ("s", 1, "user"), ("s", 0, "assistant"), ("s", 2, "system"), ("t", 5, "user"), ("s", 4, "user")]
    spark.createDataFrame(rows, "session string, pos long, type string").createOrReplaceTempView("udtf_turns")
    got = spark.sql("select * from turn_pairs(table(udtf_turns))").collect()
    assert sorted(map(tuple, got)) == [("s", 0, 1, [3]), ("s", 1, 4, []), ("t", 0, 5, [])]
    with pytest.raises(Exception, match="lacks"):
        spark.sql("select * from turn_pairs(table(udtf_docs))").collect()
