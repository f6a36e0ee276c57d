"""More registered queries over the driver's tables: state, telemetry, evaluation, scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import predicates
from memlake.functions import scalars as S
from memlake.operators import admin, evaluation, hooks, ingest, telemetry
from memlake.operators.usage_store import UsageStore
from memlake.plans.queries import _AUDIT, BONUSES, ORACLE, _BLOB, _HEUR, _JUDGED, _PATHS, P, _bm25, asked, audit, blobs, bm25, judged, load, now, page_paths, points, query, with_points
from memlake.shared import cut, shared_dir, small
from memlake.sources import readers

_NOW = "timestamp '2024-01-28 00:00:00'"


@query("with d as (select doc_id, text, string_split(text, chr(10)) as l from documents), x as (select doc_id, text, l, unnest(range(1, len(l) + 1)) as i from d), s as (select doc_id, i - 1 as pos, l[i] as line, strlen(text) as size, coalesce(list_sum(list_transform(l[1:i-1], lambda z: strlen(z) + 1)), 0) as start from x) select doc_id as path, pos, line from s where size <= 2000 or start > size - 2000")
def q_tail_lines(spark, sf_dir):
    return readers.tail_lines(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text")), 2000)


@query("select doc_id as id, case when doc_id % 10 = 0 then 'xx' else lang end as lang, case when doc_id % 10 = 0 then null else source end as source from documents")
def q_payload_update(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return ingest.update_payload(d, d.where("id % 10 = 0").select("id", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source")))


@query("select doc_id as id from documents where doc_id % 7 <> 3")
def q_delete_ids(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return ingest.delete_ids(d, d.where("id % 7 = 3"))


@query("select doc_id as id, lang, (row_number() over (order by doc_id) - 1) // 64 as page from documents")
def q_scroll(spark, sf_dir):
    return ingest.paged(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), 64)


@query("""with h as (select sha256(encode(strlen(source || '/' || doc_id) || ':' || source || '/' || doc_id || coalesce(text, ''))) as h from documents),
s as (select count(*) as n, """ + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::bigint)::hugeint as w{i}" for i in range(8)) + """ from h)
select n as files, sha256(concat_ws(':', n, w0, w1, w2, w3, w4, w5, w6, w7)) as digest from s""")
def q_tree_digest(spark, sf_dir):
    return readers.tree_digest(load(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("text").alias("content")))


@query("select doc_id as id, case when doc_id % 5 = 0 then 'new' when doc_id % 2 = 0 then 'second' else 'first' end as version, case when doc_id % 5 = 0 then 1 end as extra from documents")
def q_versioned_upsert(spark, sf_dir):
    """Three versions of a collection, the last with a new column; then what a reader sees."""
    root = f"{shared_dir(spark).rstrip('/')}/collection-{S.uuid.uuid4().hex}"
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    ingest.ensure(spark, root, "id long, version string")
    for rows in (d.withColumn("version", F.lit("first")), d.where("id % 2 = 0").withColumn("version", F.lit("second")), d.where("id % 5 = 0").withColumns({"version": F.lit("new"), "extra": F.lit(1)})):
        ingest.commit(spark, root, rows)
    return ingest.read_latest(spark, root)


@query(f"with {P}, pp as (select id, source || '/' || room as pre, valid_to from points) select id from pp where pre in ('src1/en', 'src2/de') and (valid_to is null or valid_to > {_NOW})")
def q_path_prefix_filter(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("path_prefixes", S.path_prefixes(F.col("file_path")))
    where = {"valid_to": "now", "path_prefix": ["src1/en", "src2/de"]}
    return p.where(predicates.predicate(where, p, now="2024-01-28 00:00:00")).select("id")


@query(f"with {_PATHS}, q as (select page_id, case when page_id % 3 = 0 then '/repo/' || path when page_id % 3 = 1 then '/else/' || path else path end as path from pp) select page_id, page_id % 3 <> 1 as inside, (regexp_matches(path, '(^|/)(src|tests)/') and not regexp_matches(path, '[^/](\\.md|\\.json|\\.yaml|\\.yml|\\.toml|\\.env|\\.cfg|\\.ini|\\.lock)$')) as code from q")
def q_path_predicates(spark, sf_dir):
    k = F.col("page_id") % 3
    q = page_paths(spark, sf_dir).withColumn("path", F.when(k == 0, F.concat(F.lit("/repo/"), "path")).when(k == 1, F.concat(F.lit("/else/"), "path")).otherwise(F.col("path")))
    return q.select("page_id", S.in_project(F.col("path"), "/repo").alias("inside"), S.is_code_target(F.col("path")).alias("code"))


@query("select conv_id, turn, regexp_matches(text, '(?i)\\b(fix|refactor|rename|implement|add|remove|delete|update|migrate)\\b') or regexp_matches(text, '(?i)\\b(write|create|build|extract|introduce)\\s+(a|the|new)?\\b') or regexp_matches(text, '(?i)\\bchange\\b') as edit from conversations")
def q_edit_intent(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", S.looks_edit_bound(F.col("text")).alias("edit"))


@query("select conv_id as session, turn as message from conversations where turn % 3 = 0 or turn % 5 = 0")
def q_message_dirty_check(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("message"), S.sha256(F.col("text")).alias("sha"), F.lit("e").alias("epoch"))
    seen = c.where("message % 3 <> 0").withColumn("sha", F.when(F.col("message") % 5 == 0, "old").otherwise(F.col("sha")))
    return ingest.needs_index(c, seen, ("session", "message")).select("session", "message")


@query("select case when doc_id % 2 = 0 then '/abs/' || doc_id else 'rel/' || doc_id end as path from documents where doc_id % 2 = 1 or doc_id % 3 = 0")
def q_manifest_prune(spark, sf_dir):
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "/abs/").otherwise("rel/"), F.col("doc_id").cast("string")).alias("path")
    d = load(spark, sf_dir, "documents")
    return ingest.prune_manifest(d.select(path), d.where("doc_id % 3 = 0").select(path))


@query("select doc_id as id, array_to_string(list_transform(range(1, 4), lambda i: array_to_string([source, lang, 'd' || doc_id || '.md'][1:i], '/')), ',') as prefixes from documents")
def q_prefix_backfill(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("path_prefixes", F.when(F.col("id") % 2 == 0, S.path_prefixes(F.col("file_path"))))
    return ingest.backfill_prefixes(p).select("id", F.array_join("path_prefixes", ",").alias("prefixes"))


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id, json_extract_string(props, '$.k') order by event_id) as n from events) where n = 1")
def q_write_dedup(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("user_id").alias("file_path"), F.get_json_object("props", "$.k").alias("chunk_hash"), F.col("event_id").alias("chunk_idx"))
    return ingest.distinct_chunks(e).select("user_id", "event_id")


@query(f"select event_id, epoch_us(case when event_id % 3 = 0 then ts when event_id % 3 = 1 then ts + interval 1 day else {_NOW} end) as valid_from from events")
def q_valid_from(spark, sf_dir):
    k = F.col("event_id") % 3
    e = load(spark, sf_dir, "events").withColumn("said", F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, " ").otherwise("no time"))
    return e.select("event_id", F.unix_micros(ingest.valid_from(F.col("said"), F.when(k < 2, F.col("ts") + F.expr("interval 1 day")), now())).alias("valid_from"))


@query("select e.event_id, e.user_id as session, coalesce(v.said, '') as task from (select * from events where event_type = 'purchase') e asof left join (select user_id, ts, max('saw ' || event_id) as said from events where event_type = 'view' group by user_id, ts) v on v.user_id = e.user_id and v.ts <= e.ts")
def q_last_task_asof(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    edits = e.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("session"), "ts")
    said = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("session"), "ts").agg(F.max(F.concat(F.lit("saw "), F.col("event_id").cast("string"))).alias("text"))
    return hooks.last_task(edits, said).select("event_id", "session", "task")


@query(f"with {_bm25()} select qid, id, rk from bm join documents on doc_id = id where rk <= 10 and source in ('src0', 'src1', 'src2', 'src3')")
def q_post_limit_semi(spark, sf_dir):
    hits = with_points(spark, sf_dir, cut(bm25(spark, sf_dir))).withColumnRenamed("source", "repo")
    return evaluation.within_after_limit(hits, spark.createDataFrame([(f"src{i}",) for i in range(4)], "repo string"), 10).select("qid", "id", "rk")


@query("select user_id as qid, event_type as metric, avg(value) filter (event_id % 2 = 0) as a, avg(value) filter (event_id % 2 = 1) as b from events group by all having a is not null and b is not null".replace("avg(value) filter (event_id % 2 = 0)", "round(avg(value) filter (event_id % 2 = 0), 6)").replace("avg(value) filter (event_id % 2 = 1)", "round(avg(value) filter (event_id % 2 = 1), 6)"))
def q_paired_samples(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    side = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("qid"), F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return evaluation.paired_samples(side(0), side(1), ("metric", "qid"))


@query(f"""with {_AUDIT}, r as (select kind || ':' || source as key, coalesce(tokens, 0) as tokens, coalesce(latency_ms, 0) as ms from au), s as (select key, count(*) as n, sum(tokens)::bigint as tokens, round(avg(tokens), 6) as mean, list_sort(list(ms)) as v from r group by key)
select key, n, tokens, mean, v[round_even(0.5 * (n - 1), 0)::int + 1] as p50, v[round_even(0.95 * (n - 1), 0)::int + 1] as p95 from s""")
def q_audit_report(spark, sf_dir):
    return telemetry.audit_report(audit(spark, sf_dir))


@query("""with j as (select event_id as row_id, ts, user_id, value, json_extract_string(props, '$.k')::int as k, event_type from events where ts >= timestamp '2024-01-21'), h as (select *, k % 3 > 0 as filled, k % 2 as dd, case when k % 7 = 0 then 1 else 0 end as st, k % 4 > 0 as ex, k % 5 = 0 as ru, k % 6 < 3 as code, k % 8 = 0 as sh from j where event_type in ('purchase', 'signup')),
ev as (select user_id, ts, json_extract_string(props, '$.k')::int % 20 as m from events where event_type = 'view'), f as (select *, filled and exists (select 1 from ev where ev.user_id = h.user_id and ev.m = h.k % 20 and ev.ts > h.ts) as used, sh and exists (select 1 from ev where ev.user_id = h.user_id and ev.m = (h.k + 1) % 20 and ev.ts > h.ts) as su from h),
a as (select count(*) as n, count(*) filter (filled) as ne, count(*) filter (filled or dd > 0 or st > 0) as ca, count(*) filter (used) as u, count(*) filter (sh) as shn, count(*) filter (filled and dd > 0) as rp, count(*) filter (filled and not ex) as sl, count(*) filter (filled and code and ru) as lm, count(*) filter (dd > 0) as ds, count(*) filter (st > 0) as sd, count(*) filter (su) as su from f),
m as (select count(*) as searches, count(*) filter (k % 3 > 0) as wc, count(*) filter (k % 3 > 0 and k % 5 = 0) as ru from j where event_type = 'click')
select n as rows, ne as non_empty, ca as candidates, round(ne / n, 4) as injection_rate, round(u / ne, 4) as use_rate, round(100 * u / n, 2) as useful_per_100_edits, round(rp / ne, 4) as repeat_rate, round(sl / ne, 4) as stale_rate, round(lm / ne, 4) as lang_mismatch_rate, round(ds / ca, 4) as dedup_suppressed_rate, round(sd / ca, 4) as stale_dropped_rate, round(su / shn, 4) as shadow_use_rate,
u as used_events, shn as shadow_rows, searches, wc as with_chunks, wc as chunks_total, round(ru / wc, 4) as ru_share from a, m""")
def q_journal_stats(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    e = load(spark, sf_dir, "events").withColumn("k", k)
    chunk = lambda add: F.array(F.struct(F.format_string("src/m%d.py", (F.col("k") + add) % 20).alias("source"), F.lit(1.0).alias("score"), (F.col("k") % 4 > 0).alias("exists"), F.when(F.col("k") % 5 == 0, "ru").otherwise("en").alias("lang")))
    none = F.array().cast("array<struct<source:string,score:double,exists:boolean,lang:string>>")
    kind = F.when(F.col("event_type") == "click", "mcp")
    target = F.when(F.col("k") % 6 < 3, "src/x.py").otherwise("notes.md")
    journal = e.where("event_type in ('purchase', 'signup', 'click')").select(F.col("event_id").alias("row_id"), "ts", F.col("user_id").alias("session"), target.alias("target"), kind.alias("kind"), F.when(F.col("k") % 3 > 0, chunk(0)).otherwise(none).alias("chunks"), (F.col("k") % 2).alias("deduped"),
                                                                              F.struct(F.when(F.col("k") % 7 == 0, 1).otherwise(0).alias("stale")).alias("dropped"), F.when(F.col("k") % 8 == 0, F.struct(chunk(1).alias("chunks"))).alias("shadow"))
    events = e.where("event_type = 'view'").select(F.col("user_id").alias("session"), "ts", F.format_string("/repo/src/m%d.py", F.col("k") % 20).alias("path"), F.lit(None).cast("string").alias("text"))
    return telemetry.journal_stats(journal, events, now()).select("*", "mcp.*").drop("mcp")


@query("with j as (select json_extract_string(props, '$.k')::int as k from events) select count(*) as searches, count(*) filter (k % 3 > 0) as with_chunks, coalesce(sum(k % 3), 0)::bigint as chunks_total, round(sum(case when k % 5 = 0 then least(k % 3, 1) else 0 end) / sum(k % 3), 4) as ru_share from j")
def q_channel_summary(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    lang = lambda i: F.struct(F.when((F.col("k") % 5 == 0) & (i == 1), "ru").otherwise("en").alias("lang"))
    none = F.array().cast("array<struct<lang:string>>")
    return telemetry.channel_summary(load(spark, sf_dir, "events").withColumn("k", k).select(F.when(F.col("k") % 3 > 0, F.transform(F.sequence(F.lit(1), F.col("k") % 3), lang)).otherwise(none).alias("chunks")))


@query("""with u as (select 'q' || (user_id % 10) as query, event_type as repo, 's' || json_extract_string(props, '$.k') as source, case when event_id % 2 = 0 then 'hook' else 'mcp' end as channel, case when value > 20 then 'en' else 'ru' end as lang, ts from events where value > 15)
select query, repo, array_to_string(list_sort(list(distinct source)), ',') as positives, array_to_string(list_sort(list(distinct channel)), ',') as channels, arg_min(lang, (ts, source)) as lang from u group by query, repo""")
def q_golden_mining(spark, sf_dir):
    e = load(spark, sf_dir, "events").where("value > 15").select(F.concat(F.lit("q"), (F.col("user_id") % 10).cast("string")).alias("query"), F.col("event_type").alias("repo"), F.concat(F.lit("s"), F.get_json_object("props", "$.k")).alias("source"), F.when(F.col("event_id") % 2 == 0, "hook").otherwise("mcp").alias("channel"), F.when(F.col("value") > 20, "en").otherwise("ru").alias("lang"), "ts")
    return telemetry.golden_queries(e).withColumns({c: F.array_join(c, ",") for c in ("positives", "channels")})


@query(f"with {_BLOB}, {_HEUR}, r as (select he.qid, greatest(1, length(answer) // 4) as q, greatest(1, length(he.blob) // 4) as c, recall from he join hr using (qid)) select qid, (q + c)::bigint as in_tokens, round(case when recall > 0 then (q + c) / recall else q + c end, 6) as tokens_per_correct, round(c / q, 6) as compression, (2 * q + c)::double as write_cost from r")
def q_record_metrics(spark, sf_dir):
    recall = evaluation.heuristic_recall(F.col("answer"), F.col("blob"))
    b = blobs(spark, sf_dir).select("qid", F.col("answer").alias("question"), "answer", F.array("blob").alias("contexts"), recall.alias("recall"))
    return evaluation.record_metrics(b).select("qid", "in_tokens", "tokens_per_correct", "compression", "write_cost")


@query("select event_type, round((max(value) - min(value)) / avg(value), 6) as value, round((max(event_id) - min(event_id)) / avg(event_id), 6) as event_id from events group by event_type")
def q_response_variance(spark, sf_dir):
    return evaluation.response_variance(load(spark, sf_dir, "events"), ["event_type"], ["value", "event_id"])


@query("with r as (select user_id, avg(value) / 25 as recall, count(*) * 60 as tokens, max(value) * 10 as p95 from events group by user_id) select user_id, concat_ws(',', case when recall < 0.6 then 'recall' end, case when tokens > 4000 then 'tokens' end, case when p95 > 500 then 'p95' end) as breaches from r")
def q_regression_breaches(spark, sf_dir):
    r = load(spark, sf_dir, "events").groupBy("user_id").agg((F.avg("value") / 25).alias("recall"), (F.count("*") * 60).alias("tokens"), (F.max("value") * 10).alias("p95"))
    return evaluation.regression_breaches(r).select("user_id", F.array_join("breaches", ",").alias("breaches"))


@query(f"""with {_JUDGED}, q2 as (select qr.*, case when qid % 2 = 0 then 'even' else 'odd' end as axis from qr), q3 as (select * from q2 union all select qid, docid, 'overall' from qr),
pq as (select axis, qid, count(*) as n, count(*) filter (rank <= 5) as r5, min(rank) as best from q3 left join ra using (qid, docid) group by axis, qid), m as (select axis, round(avg(r5 / n), 6) as r5, round(avg(coalesce(1 / best, 0)), 6) as mrr from pq group by axis),
l as (select axis || '.recall_at_5' as metric, r5 as value from m union all select axis || '.mrr', mrr from m), f as (select * from (values ('even.mrr', 0.9::double), ('odd.recall_at_5', 0.0::double), ('overall.mrr', 2.0::double)) t(metric, bound)) select metric, value, bound, value >= bound as ok from l join f using (metric)""")
def q_suite_gate(spark, sf_dir):
    gold, run = judged(spark, sf_dir)
    qrels = gold.withColumn("axis", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd"))
    suite = evaluation.Suite(cut(qrels), lambda backend: run, {"even.mrr": 0.9, "odd.recall_at_5": 0.0, "overall.mrr": 2.0})
    return evaluation.run_suite(suite)[1].select("metric", "value", "bound", "ok")


@query(f"with {_bm25()}, h as (select qid, 'c' || (id % 7) as id, score, rk from bm where id % 11 <> 0), g as (select qid, id, arg_max(score, rk) as score, min(rk) as first from h group by qid, id) select qid, id, score, row_number() over (partition by qid order by first) as rk from g")
def q_chunk_run(spark, sf_dir):
    hits = bm25(spark, sf_dir).withColumn("chunk_id", F.when(F.col("id") % 11 != 0, F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))))
    return evaluation.chunk_run(hits)


@query("select id, axis from (select doc_id as id, lang as axis, row_number() over (partition by lang order by md5('0:' || doc_id), doc_id) as n from documents) where n <= 2")
def q_smoke_subset(spark, sf_dir):
    return evaluation.smoke_subset(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("axis")))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""with sr as ({ORACLE['snapshot_rank']}), t as (select sr.id, row_number() over (order by score desc, sr.id) as rk, trim(d.text, {_BLANK}) as text from sr join documents d on d.doc_id = sr.id),
u as (select *, sum(greatest(1, length(text) // 4)) over w as used, sum(length(text) - length(replace(text, chr(10), '')) + 2) over w as height from t where text <> '' window w as (order by rk rows unbounded preceding))
select id, rk::int as rk from u where used <= 9000 and height <= 500""")
def q_snapshot_budget(spark, sf_dir):
    """The snapshot's best points that fit into its budgets."""
    best = admin.snapshot_rank(points(spark, sf_dir).withColumn("updated_at", F.lit(None).cast("timestamp")), now(), BONUSES)
    ranked = best.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return admin.snapshot_cut(ranked.select("id", "rk", "text"), tokens=9000).select("id", "rk")


_WINDOW = "ts::date between date '2024-01-08' and date '2024-01-21'"


@query(f"with {_AUDIT} select kind || ':' || source as key, count(*) as n, sum(tokens)::bigint as tokens, sum(tokens * tokens)::bigint as sumsq, min(tokens) as least, max(tokens) as most, round(avg(tokens), 6) as mean from au where {_WINDOW} group by 1")
def q_usage_store(spark, sf_dir):
    """Two weeks' rollup from stored moments that came in three batches, one of them twice."""
    return usage_store(spark, sf_dir).rollup("2024-01-08", "2024-01-21")


@query(f"with {_AUDIT} select kind, count(*) as n, true as users_close, true as p50_close, true as p95_close, true as top_found from au where {_WINDOW} group by kind")
def q_usage_sketches(spark, sf_dir):
    """Two weeks' merged sketches: whether users are within 3 %, percentiles within 1 % of the ranks, and counts of the top sources exact."""
    found = usage_store(spark, sf_dir).summary("2024-01-08", "2024-01-21")
    a = audit(spark, sf_dir).where(F.to_date("ts").between("2024-01-08", "2024-01-21"))
    rank = lambda c: (F.count_if(F.col("latency_ms") < F.col(c)) / F.count("*"), F.count_if(F.col("latency_ms") <= F.col(c)) / F.count("*"))
    close = lambda c, p: (rank(c)[0] <= p + 0.01) & (rank(c)[1] >= p - 0.01)
    ranks = a.join(small(found.select("kind", "p50", "p95")), "kind").groupBy("kind").agg(close("p50", 0.5).alias("p50_close"), close("p95", 0.95).alias("p95_close"))
    each = a.groupBy("kind", "source").agg(F.count("*").alias("c"))
    users = each.groupBy("kind").agg(F.count("*").alias("exact"), F.max("c").alias("most"))
    out = found.join(users, "kind").join(ranks, "kind")
    return out.select("kind", "n", (F.abs(F.col("users") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.03 * F.col("exact"))).alias("users_close"), "p50_close", "p95_close", (F.col("top")[0]["count"] == F.col("most")).alias("top_found"))


def usage_store(spark, sf_dir) -> UsageStore:
    store, a = UsageStore(spark, f"{shared_dir(spark).rstrip('/')}/usage-{S.uuid.uuid4().hex}"), audit(spark, sf_dir)
    for batch in (0, 1, 1, 2):
        store.write(a.where(F.col("event_id") % 3 == batch), batch)
    return store


@query("with i as (select doc_id, list_filter(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_\\.]+[A-Za-z0-9_])', 1), lambda x: length(x) >= 4) as l from documents) select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], ',') as required from i")
def q_required_substrings(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(S.required_substrings(F.col("text")), ",").alias("required"))


@query("select doc_id, trim(substr(regexp_extract(c, '^(.*?[.!?])(?:\\s|$)|^(.*)$', 0), 1, 160)) as sentence, replace(replace(text, 'the', '<A_REDACTED>'), 'of', '<B_REDACTED>') as redacted, regexp_replace(lang || ':' || source, '[^A-Za-z0-9_.-]', '_', 'g') as session from (select *, trim(regexp_replace(text, '[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) as c from documents)")
def q_text_functions(spark, sf_dir):
    d, t = load(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", S.first_sentence(t).alias("sentence"), S.redacted(t, {"A": "the", "B": " of ", "C": " "}).alias("redacted"), S.session_name(F.concat_ws(":", "lang", "source")).alias("session"))


@query("select sha256(string_agg(doc_id || chr(0) || text || chr(0), '' order by doc_id::varchar)) as digest from documents")
def q_content_digest(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return spark.createDataFrame([(readers.content_digest(d),)], "digest string")


@query(f"with {_bm25()}, b as (select item_id as qid, text from benchmark) select qid, id, rk, 'bm25' as backend from bm")
def q_backend_by_name(spark, sf_dir):
    from memlake.registry import lookup

    p = points(spark, sf_dir).withColumn("vec", F.lit(None).cast("array<double>"))
    return lookup("retrieval", "bm25")(p, asked(spark, sf_dir)).select("qid", "id", "rk", F.lit("bm25").alias("backend"))


