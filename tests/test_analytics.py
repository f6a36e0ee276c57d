from datetime import datetime, timedelta

import pytest
from memlake.operators import admin, evaluation, telemetry
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def test_rollup_defaults(spark):
    df = spark.createDataFrame([(None, None, None), ("a", "s", 2), ("a", "s", 4)], "kind string, source string, tokens long")
    got = {r["key"]: tuple(r)[1:] for r in telemetry.usage_rollup(df).collect()}
    assert got == {"?:?": (1, 0, 0, 0, 0, 0.0), "a:s": (2, 6, 20, 2, 4, 3.0)}


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 7)] + [("b", None)], "k string, x double")
    got = {r["k"]: r for r in telemetry.usage_percentiles(df, "k", "x").collect()}
    # index rint(0.5 * 5) = 2: half to even; plain cuts take places n // 2 and 0.9 n
    assert (got["a"]["p50_cut"], got["a"]["p90_cut"], got["b"]["p50_cut"]) == (4.0, 6.0, None)
    assert got["a"]["p50_indexed"] == 3.0 and got["a"]["p95_indexed"] == 6.0 and got["a"]["p50_linear"] == 3.5 and got["a"]["p95_rank"] == 6.0 and got["b"]["p50_indexed"] == 0.0


def test_later_use(spark):
    chunks = spark.createDataFrame([("s", T0, "src/app.py"), ("s", T0, "src/other.py"), ("t", T0, "src/app.py"), ("s", None, "lib/z.py")], "session string, ts timestamp, source string")
    later, before = T0 + timedelta(hours=1), T0 - timedelta(hours=1)
    events = spark.createDataFrame([("s", later, "/repo/src/myapp.py", None), ("s", before, "/repo/src/app.py", None), ("s", later, None, "edit myapp.py now"), ("s", before, "/r/lib/z.py", None), ("t", later, None, "see app.py.")], "session string, ts timestamp, path string, text string")
    assert sorted((r["session"], r["source"]) for r in telemetry.used_later(chunks, events).collect()) == [("s", "lib/z.py")]
    more = events.unionByName(spark.createDataFrame([("s", later, "/repo/src/app.py", None), ("t", later, None, "see app.py, ok")], events.schema))
    assert sorted((r["session"], r["source"]) for r in telemetry.used_later(chunks, more).collect()) == [("s", "lib/z.py"), ("s", "src/app.py"), ("t", "src/app.py")]


def test_drop_chain(spark):
    rows = [("s", T0, 0, "k1", 0.5, "p"), ("s", T0, 1, "k1", 0.5, "p"), ("s", T0, 2, "k2", None, "p"), ("s", T0, 3, "k3", 0.1, "p"), ("s", T0, 4, "k4", 0.9, "q"), ("s", T0, 5, "k5", 0.9, "p")]
    df = spark.createDataFrame(rows, "session string, ts timestamp, pos int, key string, rerank_score double, root string")
    seen = spark.createDataFrame([("s", "k5")], "session string, key string")
    got = {r["pos"]: r["drop_reason"] for r in telemetry.tag_drops(df, F.col("root") == "p", 0.3, F.lit(True), seen).collect()}
    assert got == {0: None, 1: "deduped", 2: None, 3: "floor", 4: "foreign", 5: "deduped"}


def test_session_dedup(spark):
    rows = [(1, "s", "k", T0), (2, "s", "k", T0 + timedelta(hours=23)), (3, "s", "k", T0 + timedelta(hours=46)), (4, "s", "k", T0 + timedelta(hours=71))]
    df = spark.createDataFrame(rows, "id int, session string, key string, ts timestamp")
    assert [r["id"] for r in telemetry.session_dedup(df).orderBy("id").collect()] == [1, 4]


def test_metrics(spark):
    qrels = spark.createDataFrame([(1, 10, 1), (1, 11, 1), (2, 20, 1), (3, 30, 1), (3, 31, 0)], "qid long, docid long, rel int")
    run = spark.createDataFrame([(1, 10, 0.9), (1, 99, 0.8), (1, 11, 0.7), (2, 21, 1.0), (2, 20, 1.0)], "qid long, docid long, score double")
    got = evaluation.ir_metrics(qrels, run).first()
    assert got["queries"] == 3 and got["recall_at_1"] == round((0.5 + 0 + 0) / 3, 6) and got["mrr"] == round((1 + 0.5) / 3, 6)  # of a tie the greater id comes first
    assert evaluation.ir_metrics(qrels, run.limit(0)).first()["ndcg_at_10"] == 0.0
    # the lowest-ranked chunk's score counts for a document
    hits = spark.createDataFrame([(1, 5, 0.9, 1), (1, 5, 0.2, 7)], "qid long, docid long, score double, rk int")
    assert evaluation.doc_run(hits).first()["score"] == 0.2
    gold = spark.createDataFrame([(1, [1, 2]), (2, [])], "qid long, gold array<bigint>")
    got = {r["qid"]: r["recall"] for r in evaluation.chunk_recall(gold, spark.createDataFrame([(1, 2, 1), (1, 1, 9)], "qid long, id long, rk int"), 5).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_gate(spark):
    scores = spark.createDataFrame([("a.b.mrr", 0.5), ("a.b.latency_p95", 10.0), ("x.y.mrr", None)], "metric string, value double")
    floors = spark.createDataFrame([("a.b.mrr", 0.6), ("a.b.latency_p95", 12.0), ("x.y.mrr", 0.1)], "metric string, bound double")
    assert {r["metric"]: r["ok"] for r in evaluation.gate(scores, floors).collect()} == {"a.b.mrr": False, "a.b.latency_p95": True}
    base = spark.createDataFrame([("a.b.mrr", 0.505)], "metric string, bound double")
    assert evaluation.gate(scores, floors, baseline=base).first()["ok"]
    def rules(values, floors, **how):
        cells = [(evaluation.CELLS[k], values.get(k), floors.get(k)) for k in evaluation.CELLS]
        return {r["field"]: r["value"] for r in evaluation.diagnose(spark.createDataFrame(cells, "metric string, value double, bound double"), **how).collect()}

    fine = dict.fromkeys(evaluation.CELLS, 0.5)
    assert rules(fine, fine) == {} and rules({}, fine) == {}
    assert rules(fine | {"r1": 0.4}, fine) == {"arm_n": "60"} and rules(fine | {"r1": 0.4}, fine, arm_n=78) == {"arm_n": "80"} and rules(fine | {"r1": 0.4, "r5": 0.4}, fine) == {}
    assert rules(fine | {"ndcg": 0.4}, fine) == {"adaptive": "true", "adaptive_delta": "0.25"} and rules(fine | {"late": 9.0, "ndcg": 0.4}, fine, rerank_n=25) == {"rerank_n": "20"}
    assert rules(fine | {"r20": 0.4}, fine) == {"content_dedup": "true"} and rules(fine | {"r20": 0.4}, fine, dedup=True, dedup_cosine=0.97) == {"dedup_cosine": "0.95"}
    assert rules(fine | {"r1": 0.4}, {"r1": 0.5}) == {"arm_n": "60"}  # a missing bound holds


def test_bootstrap(spark):
    pairs = spark.createDataFrame([(i, 0.1 * i + 0.2 + 0.01 * (i % 3), 0.1 * i) for i in range(20)], "qid int, a double, b double")
    one, two = (evaluation.paired_bootstrap(pairs, 500).first() for _ in "ab")
    assert one == two and one["verdict"] == "win" and one["ci_lower"] <= one["delta"] <= one["ci_upper"] and one["delta"] == pytest.approx(0.2095, abs=1e-4)
    same = pairs.withColumn("b", F.col("a"))
    assert evaluation.paired_bootstrap(same, 100).first()["verdict"] == "tie"


def test_stratified(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 3, "rare").otherwise("common").alias("k"))
    got = evaluation.stratified(df, ["k"], 50).collect()
    assert len(got) == 50 and sum(r["k"] == "rare" for r in got) == 1


def test_panels(spark):
    now = F.lit("2024-01-10").cast("timestamp")
    p = spark.createDataFrame([(1, "a", T0, None), (2, None, T0, T0), (3, "z", T0 + timedelta(days=30), None)], "id int, room string, valid_from timestamp, valid_to timestamp")
    assert {r["room"]: r["n"] for r in admin.room_histogram(p, ["a", "b"]).collect()} == {"a": 1, "b": 0, None: 1}
    row = admin.temporal_panel(p, now, 3).first()
    assert (row["live"], row["superseded"], row["future"], row["awaiting_gc"], row["stale"]) == (2, 1, 1, 1, False)
    ranked = admin.snapshot_rank(p.withColumns({"file_path": F.lit("src/x"), "updated_at": F.lit(None).cast("timestamp")}), now, [("src", 0.3)])
    assert [r["id"] for r in ranked.collect()] == [3, 1]  # superseded versions are left out


def test_migrated_aggregates(spark):
    raw = spark.createDataFrame([("a", "7"), ("b", '{"sum": 3, "sumsq": 5, "count": 2, "min": 1, "max": 2}')], "key string, value string")
    got = {r["key"]: (r["sum"], r["sumsq"], r["n"]) for r in telemetry.migrate_aggregates(raw).collect()}
    assert got == {"a": (7, 49, 7), "b": (3, 5, 2)}


def test_mining_channels_and_pointers(spark):
    used = spark.createDataFrame([("q", "r", "b", "hook", "ru", 2), ("q", "r", "a", "mcp", "en", 1)], "query string, repo string, source string, channel string, lang string, ts int")
    row = telemetry.golden_queries(used).first()
    assert (row["positives"], row["channels"], row["lang"]) == (["a", "b"], ["hook", "mcp"], "en")
    c = spark.createDataFrame([([("ru",), ("en",)],), ([],), (None,)], "chunks array<struct<lang:string>>")
    assert tuple(telemetry.channel_summary(c).first()) == (3, 1, 2, 0.5)
    p = spark.createDataFrame([("s", i, "/r/a.md", "H", 0.5, "One  two. Three.") for i in range(100)], "session string, pos int, source string, header string, score double, text string")
    block = telemetry.pointer_lines(p, "/r").first()["block"]
    assert len(block) <= 2000 and block.split("\n")[0] == "- a.md § H (0.50) One two." and len(block.split("\n")) > 50


def test_records_variance_breaches_envelope(spark):
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0)], "k string, x double")
    assert {r["k"]: r["x"] for r in evaluation.response_variance(runs, ["k"], ["x"]).collect()} == {"a": 1.0, "b": 0.0}
    row = spark.createDataFrame([(0.5, 100.0, 900.0)], "recall double, tokens double, p95 double")
    assert evaluation.regression_breaches(row).first()["breaches"] == ["recall", "p95"]
    rec = evaluation.record_metrics(spark.createDataFrame([(1, "q" * 8, ["x" * 40, None], "y" * 8, 0.5), (2, "", [], "", 0.0)], "qid int, question string, contexts array<string>, answer string, recall double")).orderBy("qid").collect()
    assert [tuple(r)[:5] for r in rec] == [(1, 13, 26.0, 5.5, 15.0), (2, 1, 1.0, 0.0, 2.0)]
    env = spark.createDataFrame([("a", "m", 0.5, None, None), ("b", "m", 0.5, 0.7, 0.6)], "axis string, metric string, own double, other double, combined double")
    assert {r["axis"]: r["combined"] for r in evaluation.collapse_envelope(env).collect()} == {"a": 0.5, "b": 0.6}


def test_snapshot_budget():
    rows = [("a", "x" * 40), ("b", " "), ("c", "y" * 400), ("d", "z")]
    assert [p for p, _ in admin.snapshot_budget(rows, tokens=50)] == ["a"] and len(admin.snapshot_budget(rows)) == 3
    assert admin.snapshot_budget([("a", "x" * 400)], tokens=50) == []


def test_percentiles_without_gathering(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.lognormal(3, 2, 400), -rng.lognormal(0, 1, 50), np.zeros(7), np.full(300, 2.5)])
    df = spark.createDataFrame([("k", float(v)) for v in x] + [("one", 3.0)], "k string, x double").repartition(5)
    got = {r["k"]: r for r in telemetry.usage_percentiles(df, "k", "x").collect()}
    s, n = np.sort(x), len(x)
    assert got["k"]["p50_indexed"] == s[round(0.5 * (n - 1))] and got["k"]["p95_indexed"] == s[round(0.95 * (n - 1))] and got["k"]["p95_rank"] == s[int(np.ceil(0.95 * n)) - 1] and got["k"]["p90_cut"] == s[int(0.9 * n)]
    assert got["k"]["p95_linear"] == pytest.approx(np.percentile(x, 95), abs=1e-5) and got["k"]["median"] == pytest.approx(np.median(x), abs=1e-5) and got["one"]["p95_linear"] == 3.0


def test_audit_report(spark):
    df = spark.createDataFrame([("a", "s", 2, 1.0), ("a", "s", 4, 3.0), ("a", "s", None, None), (None, None, 1, 2.0)], "kind string, source string, tokens long, latency_ms double")
    assert {tuple(r) for r in telemetry.audit_report(df).collect()} == {("a:s", 3, 6, 2.0, 1.0, 3.0), ("?:?", 1, 1, 1.0, 2.0, 2.0)}


def test_journal_stats(spark):
    chunk = "struct<source:string,score:double,exists:boolean,lang:string>"
    c = lambda s, e=True, lang="en": (s, 1.0, e, lang)
    rows = [(1, T0, "s", "src/x.py", None, [c("src/a.py")], 0, (0,), ([c("src/b.py")],)), (2, T0, "s", "src/x.py", None, [c("src/z.py", False, "ru")], 2, (0,), None), (3, T0, "s", "doc.md", None, [], 0, (1,), None),
            (4, T0, "s", "src/x.py", None, [], 0, (0,), None), (5, T0, "", None, "mcp", [c("src/a.py", True, "ru"), c("q")], 0, None, None), (6, T0 - timedelta(days=30), "s", "src/x.py", None, [c("src/a.py")], 0, (0,), None)]
    j = spark.createDataFrame(rows, f"row_id int, ts timestamp, session string, target string, kind string, chunks array<{chunk}>, deduped int, dropped struct<stale:int>, shadow struct<chunks:array<{chunk}>>")
    events = spark.createDataFrame([("s", T0 + timedelta(hours=1), "/r/src/a.py", None), ("s", T0 + timedelta(hours=1), None, "see b.py now")], "session string, ts timestamp, path string, text string")
    got = telemetry.journal_stats(j, events, F.lit(T0 + timedelta(days=1))).first()
    assert (got["rows"], got["non_empty"], got["candidates"], got["used_events"], got["shadow_rows"], got["shadow_use_rate"]) == (4, 2, 3, 1, 1, 1.0)
    assert (got["injection_rate"], got["use_rate"], got["useful_per_100_edits"], got["repeat_rate"], got["stale_rate"], got["lang_mismatch_rate"], got["dedup_suppressed_rate"], got["stale_dropped_rate"]) == (0.5, 0.5, 25.0, 0.5, 0.5, 0.5, 0.3333, 0.3333)
    assert tuple(got["mcp"]) == (1, 1, 2, 0.5)


def test_suites_citations_and_samples(spark):
    qrels = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 1, "y")], "qid int, docid string, rel int, axis string")
    run = spark.createDataFrame([(1, "a", 1.0), (2, "c", 2.0), (2, "b", 1.0)], "qid int, docid string, score double")
    report, gate = evaluation.run_suite(evaluation.Suite(qrels, lambda backend: run, {"x.mrr": 0.9, "y.mrr": 0.9, "gone.mrr": 1.0}))
    assert {r["axis"]: r["value"] for r in report.where("metric = 'mrr'").collect()} == {"x": 1.0, "y": 0.5, "overall": 0.75}
    assert {r["metric"]: r["ok"] for r in gate.collect()} == {"x.mrr": True, "y.mrr": False}
    # ties order by falling id
    assert evaluation.ir_metrics(qrels.where("qid = 2"), spark.createDataFrame([(2, "a", 1.0), (2, "b", 1.0)], run.schema)).first()["recall_at_1"] == 1.0
    hits = spark.createDataFrame([(1, "c1", 0.9, 1), (1, "c2", 0.8, 2), (1, "c1", 0.7, 3), (1, None, 0.6, 4)], "qid int, chunk_id string, score double, rk int")
    assert [tuple(r) for r in evaluation.chunk_run(hits).orderBy("rk").collect()] == [(1, "c1", 0.7, 1), (1, "c2", 0.8, 2)]
    text = "# T\n## Context\n\nFirst  part\nof it.\n\nSecond.\n## Decision\nUse `src/a.py` and `src/gone.ts`, not `b.py`.\n## After\n`src/c.py`"
    adr = spark.createDataFrame([("docs/1.md", text), ("docs/2.md", "## Decision\n`src/a.py`")], "path string, text string")
    gold, missing = evaluation.citations(adr, spark.createDataFrame([("src/a.py",), ("src/c.py",)], "path string"))
    assert [tuple(r) for r in gold.collect()] == [("docs/1.md", "First  part\nof it.", ["docs/1.md", "src/a.py"])] and [tuple(r) for r in missing.collect()] == [("docs/1.md", "src/gone.ts")]
    ranked = spark.createDataFrame([(1, i, "r" if i % 2 else "q") for i in range(1, 7)], "qid int, rk int, repo string")
    assert [r["rk"] for r in evaluation.within_after_limit(ranked, spark.createDataFrame([("r",)], "repo string"), 3).orderBy("rk").collect()] == [1, 3]
    rec = spark.range(50).select("id", F.when(F.col("id") == 0, "rare").otherwise("common").alias("axis"))
    assert [r["axis"] for r in evaluation.smoke_subset(rec).collect()] == ["common", "common", "rare"]
    side = spark.createDataFrame([("x", "c", "m", 1, 0.5), ("x", "c", "m", 2, 0.7)], "axis string, col string, metric string, qid int, value double")
    assert [tuple(r)[4:] for r in evaluation.paired_samples(side, side.where("qid = 2")).collect()] == [(0.7, 0.7)]
    files = spark.createDataFrame([("a.md", "# H\none\n# I\ntwo"), ("b.md", "x")], "path string, text string")
    import hashlib

    assert {tuple(r) for r in evaluation.gold_chunks(files.where("path = 'a.md'"), files).collect()} == {("a.md", "a.md#" + hashlib.sha1(t).hexdigest()[:12]) for t in (b"one", b"two")}
