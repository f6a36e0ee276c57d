"""The registered queries: each applies an operator to the driver's tables, with the same query in DuckDB's SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.config import Config
from memlake.functions import predicates
from memlake.functions import scalars as S
from memlake.operators import admin, evaluation, filters, ingest, retrieval, telemetry, turns
from memlake.operators.cells import Cells
from memlake.operators.postings import Postings
from memlake.registry import lookup
from memlake.shared import cut, shared_dir, small, spread
from memlake.sources import readers, sinks
from memlake.streaming import pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
NOW = "2024-01-28 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.strip()
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its times as UTC timestamps."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as points of a collection, with paths, versions and kinds derived from their ids."""
    return as_points(load(spark, sf_dir, "documents"))


def as_points(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("room"), "source", F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("file_path"),
        S.sha256(F.col("text")).alias("content_hash"), F.when(F.col("doc_id") % 3 == 0, "transcript").otherwise("markdown").alias("chunker"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 40 as int))").alias("valid_from"),
        F.expr("case when doc_id % 7 = 0 then timestamp'2024-01-10 00:00:00' + make_dt_interval(cast(doc_id % 30 as int)) end").alias("valid_to"),
    )


P = """points as (select doc_id as id, text, lang as room, source, source || '/' || lang || '/d' || doc_id || '.md' as file_path, sha256(text) as content_hash,
 case when doc_id % 3 = 0 then 'transcript' else 'markdown' end as chunker, timestamp '2024-01-01' + to_days((doc_id % 40)::int) as valid_from,
 case when doc_id % 7 = 0 then timestamp '2024-01-10' + to_days((doc_id % 30)::int) end as valid_to from documents)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as queries; an item's vector is that of the embedding with its id."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text").join(e, "qid", "left")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


_INDEXES: dict[tuple[str, str], Postings] = {}


def sparse_index(spark: SparkSession, sf_dir: str) -> Postings:
    """The stored postings of documents; a session writes them once."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        made = Postings(spark, f"{shared_dir(spark).rstrip('/')}/postings-{uuid.uuid4().hex}")
        made.write(spread(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id"), 0)
        _INDEXES[key] = made
    return _INDEXES[key]


def bm25(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """All items asked at once: one pass over the texts costs less than an index of all their words."""
    return retrieval.bm25_topk(spread(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id"), asked(spark, sf_dir).select("qid", "text"), n)


def _bm25(n: int = 20, where: str = "true", name: str = "bm") -> str:
    return f"""tok as (select doc_id, unnest(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+)', 1)) as term from documents where {where}),
tf as (select doc_id, term, count(*) as tf from tok group by doc_id, term), dl as (select doc_id, sum(tf) as dl from tf group by doc_id),
st as (select count(*) as n, avg(dl) as avgdl from dl), df as (select term, count(*) as df from tf group by term),
qt as (select distinct item_id as qid, unnest(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+)', 1)) as term from benchmark),
sc as (select qid, tf.doc_id as id, round(sum(ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl))), 6) as score
 from qt join tf on qt.term = tf.term join df on df.term = qt.term join dl on dl.doc_id = tf.doc_id cross join st group by qid, tf.doc_id),
{name} as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rk from sc) where rk <= {n})"""


def _dense(queries: str, corpus: str, n: int = 20, name: str = "de") -> str:
    return f"""dq as ({queries}), dc as ({corpus}),
{name} as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rk from (
 select dq.qid, dc.id, round(list_dot_product(dq.v, dc.v) / (sqrt(list_dot_product(dq.v, dq.v)) * sqrt(list_dot_product(dc.v, dc.v))), 6) as score from dq, dc)) where rk <= {n})"""


_EVERY = "select vec_id as id, embedding::double[] as v from embeddings"
_HUNDRED = "select vec_id as qid, embedding::double[] as v from embeddings where vec_id % 100 = 0"
_ASKED = "select item_id as qid, embedding::double[] as v from benchmark join embeddings on vec_id = item_id"


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is a query against all."""
    v = vectors(spark, sf_dir)
    return retrieval.dense_topk(v, v.where("id % 100 = 0").select(F.col("id").alias("qid"), "vec"))


@query(f"with {_dense(_HUNDRED, _EVERY)} select qid, id, score, rk from de")
def q_dense_topk(spark, sf_dir):
    return dense(spark, sf_dir)


@query(f"with {_dense(_HUNDRED, _EVERY)} select qid, id, score, rk from de")
def q_dense_cells(spark, sf_dir):
    """The same from a stored index that took the vectors in two batches."""
    v = vectors(spark, sf_dir)
    index = Cells(spark, f"{shared_dir(spark).rstrip('/')}/cells-{uuid.uuid4().hex}")
    index.make(v, 32)
    for batch in range(2):
        index.write(v.where(F.col("id") % 2 == batch), batch)
    return index.search(v.where("id % 100 = 0").select(F.col("id").alias("qid"), "vec"))


@query(f"with {_bm25()} select qid, id, score, rk from bm")
def q_bm25_topk(spark, sf_dir):
    return bm25(spark, sf_dir)


@query(f"with {_bm25(where='doc_id % 7 <> 5')} select qid, id, score, rk from bm")
def q_postings_update(spark, sf_dir):
    """An index that held drafts of a third of the texts and documents that went, after the batch that mended both."""
    d = spread(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    draft = F.when(F.col("id") % 3 == 0, F.concat_ws(" ", F.lit("draft"), F.substring("text", 1, 99))).otherwise(F.col("text"))
    index = Postings(spark, f"{shared_dir(spark).rstrip('/')}/postings-{uuid.uuid4().hex}")
    index.write(d.withColumn("text", draft), 0)
    index.write(d.where("id % 3 = 0 and id % 7 <> 5"), 1, removed=d.where("id % 7 = 5"))
    return index.search(asked(spark, sf_dir).select("qid", "text"))


_RRF = """fu as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rk from (
 select qid, id, round(sum(1.0::double / (60 + rk)), 9) as score from (select qid, id, rk from de union all select qid, id, rk from bm) group by qid, id)) where rk <= 10)"""


@query(f"with {_bm25()}, {_dense(_ASKED, _EVERY)}, {_RRF} select qid, id, score, rk from fu")
def q_hybrid_rrf(spark, sf_dir):
    q = asked(spark, sf_dir).where("vec is not null").select("qid", "vec")
    return retrieval.rrf([retrieval.dense_topk(vectors(spark, sf_dir), q), bm25(spark, sf_dir)])


_EN = "lang = 'en' and source in ('src0', 'src1', 'src2')"


@query(f"with {_bm25(where=_EN)}, {_dense(_ASKED, _EVERY + ' join documents on doc_id = vec_id where ' + _EN)}, {_RRF} select qid, id, score, rk from fu")
def q_hybrid_filtered(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").where(predicates.predicate({"lang": "en", "source": ["src0", "src1", "src2"]}, load(spark, sf_dir, "documents"), temporal=False))
    kept = docs.select(F.col("doc_id").alias("id"), "text")
    q = asked(spark, sf_dir)
    v = vectors(spark, sf_dir).join(kept.select("id"), "id", "left_semi")
    return retrieval.rrf([retrieval.dense_topk(v, q.where("vec is not null").select("qid", "vec")), retrieval.bm25_topk(kept, q.select("qid", "text"))])


def with_points(spark, sf_dir, hits):
    """A few hits a query with their points' columns; the hits go to the corpus, which is not shuffled."""
    return points(spark, sf_dir).join(small(hits), "id")


def boosted(spark, sf_dir, hits=None):
    hits = with_points(spark, sf_dir, cut(bm25(spark, sf_dir)) if hits is None else hits)
    return retrieval.rescored(hits, S.recency(F.col("valid_from"), now()))


_AGE = f"((epoch_us(timestamp '{NOW}') - epoch_us(valid_from)) / 86400000000.0)"
_BOOST = f"""bo as (select *, row_number() over (partition by qid order by score desc, old) as rk from (select qid, bm.id, round(score * (1 + 0.1 * exp(-greatest({_AGE}, 0) / 30.0)), 9) as score, rk as old, points.* exclude (id) from bm join points on points.id = bm.id))"""


@query(f"with {_bm25()}, {P}, {_BOOST} select qid, id, score, rk from bo")
def q_recency_boost(spark, sf_dir):
    return boosted(spark, sf_dir).select("qid", "id", "score", "rk")


@query(f"with {_bm25()}, {P}, {_BOOST} select qid, id, nscore as score, row_number() over (partition by qid order by nscore desc, rk) as rk from (select *, round(score * case when chunker = 'transcript' then 0.7 + (1 - 0.7) * pow(0.5, greatest({_AGE}, 0) / 14.0) else 1 end, 9) as nscore from bo)")
def q_transcript_decay(spark, sf_dir):
    factor = F.when(F.col("chunker") == "transcript", S.decay(F.col("valid_from"), now())).otherwise(F.lit(1.0))
    return retrieval.rescored(boosted(spark, sf_dir), factor).select("qid", "id", "score", "rk")


@query(f"""with recursive {_dense(_HUNDRED, _EVERY)}, o as (select de.qid, de.id, de.rk, dc.v from de join dc on dc.id = de.id),
g as (select qid, rk, [id] as kept, [v] as kv from o where rk = 1 union all select o.qid, o.rk,
 case when hit then kept else list_append(kept, o.id) end, case when hit then kv else list_append(kv, o.v) end
 from (select g.*, o.id, o.v, o.rk as nrk, len(list_filter(g.kv, lambda k: list_cosine_similarity(k, o.v) >= 0.5)) > 0 as hit from g join o on o.qid = g.qid and o.rk = g.rk + 1) x join o on o.qid = x.qid and o.rk = x.nrk)
select qid, unnest(kept) as id from (select qid, arg_max(kept, rk) as kept from g group by qid)""")
def q_greedy_dedup(spark, sf_dir):
    return retrieval.greedy_dedup(vectors(spark, sf_dir).join(small(cut(dense(spark, sf_dir))), "id"), 0.5).select("qid", "id")


@query(f"with {_bm25()}, {P} select qid, id, rk from (select qid, bm.id, rk, row_number() over (partition by qid, content_hash order by rk) as n from bm join points on points.id = bm.id) where n = 1")
def q_hash_dedup(spark, sf_dir):
    return retrieval.hash_dedup(with_points(spark, sf_dir, cut(bm25(spark, sf_dir)))).select("qid", "id", "rk")


@query(f"with {_bm25()} select qid, id, rk, used_tokens from (select qid, id, rk, sum(greatest(1, length(text) // 4)) over (partition by qid order by rk)::bigint as used_tokens from bm join documents on doc_id = id) where rk = 1 or used_tokens <= 1500")
def q_token_budget(spark, sf_dir):
    hits = with_points(spark, sf_dir, cut(bm25(spark, sf_dir))).withColumn("tokens", S.token_estimate(F.col("text")))
    return retrieval.token_budget(hits).select("qid", "id", "rk", "used_tokens")


def _occ(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, '{part}', ''))) // {len(part)})"


@query(f"""with s as (select item_id as qid, 0.40 * least(1, greatest(1, length(text) // 4) / 64.0) + 0.25 * least(1, ({_occ('text', '?')} + {_occ('lower(text)', ' and ')} + {_occ('lower(text)', ' or ')} + {_occ('text', ';')} + {_occ('text', ':')}) / 3.0)
 + 0.20 * least(1, (len(regexp_extract_all(text, '[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+')) + {_occ('text', '::')} + {_occ('text', '.py')} + {_occ('text', '`')} // 2) / 2.0) as score from benchmark)
select qid, round(score::double, 6) as score, greatest(5, least(20, floor(5 * (1 + 0.5 * score))))::int as k_eff from s""")
def q_adaptive_k(spark, sf_dir):
    q = asked(spark, sf_dir).withColumn("score", S.complexity(F.col("text"), F.lit(False)))
    return q.select("qid", F.round("score", 6).alias("score"), S.effective_k(5, F.col("score"), 0.5, 20).alias("k_eff"))


def page_paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", "")
    return load(spark, sf_dir, "pages").select("page_id", path.alias("path"))


_PATHS = "pp as (select *, list_filter(string_split(path, '/'), lambda x: x <> '' and x <> '.') as parts from (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') as path from pages))"


@query(f"with {_PATHS} select prefix, count(*) as n from (select unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) as prefix from pp) group by prefix")
def q_path_prefix_match(spark, sf_dir):
    return page_paths(spark, sf_dir).select(F.explode(S.path_prefixes(F.col("path"))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


ROOMS = {"german": ["de"], "french": ["fr"], "spanish": ["es"], "english": ["en", "us"]}


@query(f"with {_PATHS} select page_id, case when list_has_any(parts, ['de']) then 'german' when list_has_any(parts, ['fr']) then 'french' when list_has_any(parts, ['es']) then 'spanish' when list_has_any(parts, ['en', 'us']) then 'english' end as room from pp")
def q_room_classifier(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", S.room(F.col("path"), ROOMS).alias("room"))


def versions(spark, sf_dir, until: str = "2100-01-01"):
    """Events as versions of a key: each ends when the next begins."""
    e = load(spark, sf_dir, "events").where(F.col("ts") < F.lit(until).cast("timestamp"))
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(F.col("event_id").alias("id"), F.concat_ws(":", "user_id", "event_type").alias("file_path"), F.col("event_type").alias("room"), F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"), "value")


def _versions(until: str = "2100-01-01") -> str:
    return f"ve as (select event_id as id, user_id || ':' || event_type as file_path, event_type as room, ts as valid_from, lead(ts) over (partition by user_id, event_type order by ts, event_id) as valid_to, value from events where ts < timestamp '{until}')"


@query(f"with {_versions()} select id, file_path from ve where valid_to is null or valid_to > timestamp '{NOW}'")
def q_temporal_live(spark, sf_dir):
    v = versions(spark, sf_dir)
    return v.where(predicates.predicate({}, v, now=NOW)).select("id", "file_path")


@query(f"with {_versions('2024-01-25')}, ch as (select distinct user_id || ':' || event_type as file_path from events where ts >= timestamp '2024-01-25') select id, epoch_us(case when valid_to is null and ch.file_path is not null then timestamp '{NOW}' else valid_to end) as valid_to from ve left join ch on ch.file_path = ve.file_path")
def q_scd2_close(spark, sf_dir):
    changed = load(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp")).select(F.concat_ws(":", "user_id", "event_type").alias("file_path"))
    return ingest.close_old(versions(spark, sf_dir, "2024-01-25"), changed, now()).select("id", F.unix_micros("valid_to").alias("valid_to"))


@query(f"with {_versions()} select id from ve where valid_to is null or epoch_us(timestamp '{NOW}') - epoch_us(valid_to) <= 7 * 86400000000")
def q_gc_sweep(spark, sf_dir):
    return ingest.gc_sweep(versions(spark, sf_dir), now(), 7).select("id")


@query("""with fi as (select doc_id as path, sha256(text) as sha, 'e1' as epoch from documents),
ma as (select doc_id as path, case when doc_id % 5 = 0 then sha256(text || 'x') else sha256(text) end as sha, case when doc_id % 11 = 0 then 'e0' else 'e1' end as epoch from documents)
select path from fi where not exists (select 1 from ma where ma.path = fi.path and ma.sha = fi.sha and ma.epoch = fi.epoch)""")
def q_dirty_check(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    files = d.select(F.col("doc_id").alias("path"), F.lit("prod").alias("target"), S.sha256(F.col("text")).alias("sha"), F.lit("e1").alias("epoch"))
    old = F.when(F.col("doc_id") % 5 == 0, S.sha256(F.concat("text", F.lit("x")))).otherwise(S.sha256(F.col("text")))
    manifest = d.select(F.col("doc_id").alias("path"), F.lit("prod").alias("target"), old.alias("sha"), F.when(F.col("doc_id") % 11 == 0, "e0").otherwise("e1").alias("epoch"))
    return ingest.needs_index(files, manifest).select("path")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def q_upsert_latest(spark, sf_dir):
    return ingest.latest(load(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("select id from (select event_id as id from events where ts >= timestamp '2024-01-25' union select event_id from events where ts < timestamp '2024-01-27')")
def q_upsert(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    return ingest.upsert(e.where(F.col("ts") < F.lit("2024-01-27").cast("timestamp")), e.where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp"))).select("id")


def talk(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.col("role").alias("type"), "text")


_PAIRS = "pa as (select conv_id as session, pair - 1 as turn_index, min(case when role = 'user' then turn end) as user_pos, list_sort(list(turn) filter (role = 'assistant')) as answers from (select *, sum((role = 'user')::int) over (partition by conv_id order by turn rows unbounded preceding) as pair from conversations where role <> 'system') where pair > 0 group by conv_id, pair)"


@query(f"with {_PAIRS} select session, turn_index::bigint as turn_index, user_pos, coalesce(array_to_string(answers, ','), '') as answers from pa")
def q_turn_pairs(spark, sf_dir):
    return turns.turn_pairs(talk(spark, sf_dir)).select("session", "turn_index", "user_pos", F.array_join(F.col("assistant_pos").cast("array<string>"), ",").alias("answers"))


@query("""with t as (select conv_id as session, turn as turn_index, length(text) % 4 as tool_id, length(text) % 2 = 0 as err from conversations),
r as (select session, turn_index, tool_id, bool_or(err) as is_error from t group by all)
select t.session, t.turn_index, t.tool_id, case when is_error then 'error' else 'ok' end as status from (select distinct session, turn_index, tool_id from t) t left join r on r.session = t.session and r.turn_index = t.turn_index + 1 and r.tool_id = t.tool_id""")
def q_tool_status_lead(spark, sf_dir):
    t = talk(spark, sf_dir).select("session", F.col("pos").alias("turn_index"), (F.length("text") % 4).cast("long").alias("tool_id"), (F.length("text") % 2 == 0).alias("e"))
    return turns.tool_statuses(t.select("session", "turn_index", "tool_id").distinct(), t.groupBy("session", "turn_index", "tool_id").agg(F.bool_or("e").alias("is_error"))).select("session", "turn_index", "tool_id", "status")


@query("select user_id as session, coalesce(max(event_id) filter (event_type = 'view') > coalesce(max(event_id) filter (event_type = 'click'), -1), false) as allowed from events group by user_id")
def q_gate_recent_search(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), (F.col("event_type") == "view").alias("is_search"), (F.col("event_type") == "click").alias("is_user"))
    return turns.recent_search(e)


@query("select conv_id as session, substr(arg_max(text, turn), 1, 400) as task from conversations where role = 'user' and trim(text) <> '' group by conv_id")
def q_last_user_text(spark, sf_dir):
    return turns.last_user_text(talk(spark, sf_dir))


def audit(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("source"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("latency_ms"))


_AUDIT = "au as (select event_id, ts, event_type as kind, user_id::varchar as source, json_extract_string(props, '$.k')::bigint as tokens, value as latency_ms from events)"


@query(f"with {_AUDIT} select kind || ':' || source as key, count(*) as n, sum(tokens)::bigint as tokens, sum(tokens * tokens)::bigint as sumsq, min(tokens) as least, max(tokens) as most, round(avg(tokens), 6) as mean from au group by 1")
def q_usage_rollup(spark, sf_dir):
    return telemetry.usage_rollup(audit(spark, sf_dir))


@query(f"""with {_AUDIT}, s as (select kind, list_sort(list(latency_ms)) as v, count(*) as n, round(quantile_cont(latency_ms, 0.5), 6) as p50_linear, round(quantile_cont(latency_ms, 0.95), 6) as p95_linear, round(median(latency_ms), 6) as median, quantile_disc(latency_ms, 0.95) as p95_rank from au group by kind)
select kind, v[round_even(0.5 * (n - 1), 0)::int + 1] as p50_indexed, v[round_even(0.95 * (n - 1), 0)::int + 1] as p95_indexed, p50_linear, p95_linear, median, p95_rank, v[n // 2 + 1] as p50_cut, v[floor(0.9 * n)::int + 1] as p90_cut from s""")
def q_usage_percentiles(spark, sf_dir):
    return telemetry.usage_percentiles(audit(spark, sf_dir), "kind", "latency_ms")


@query(f"""with {_AUDIT}, t as (select kind, latency_ms, row_number() over (partition by kind order by ts desc, event_id desc) as rn from au), s as (select kind, count(*) as n, list_sort(list(latency_ms)) as v from t where rn <= 100 group by kind),
p as (select *, 0.95::double * (n + 1) as pos from s), l as (select *, greatest(1, least(floor(pos)::int, n - 1)) as lo from p)
select kind, n, round(list_median(v), 6) as p50, round(case when n < 20 then v[n] else v[lo] + (pos - lo) * (v[lo + 1] - v[lo]) end, 6) as p95 from (select *, list_aggregate(v, 'median') as m from l)""".replace("list_median(v)", "m"))
def q_latency_tail(spark, sf_dir):
    return telemetry.latency_tail(audit(spark, sf_dir), "kind", "latency_ms", ["ts", "event_id"])


@query(f"with {_AUDIT} select w as show, kind, count(*) as n, sum(tokens)::bigint as tokens from au join (values ('today'), ('week'), ('all')) t(w) on w = 'all' or (w = 'today' and ts::date = date '2024-01-20') or (w = 'week' and ts::date >= date '2024-01-13') group by all")
def q_usage_window(spark, sf_dir):
    a, day = audit(spark, sf_dir), F.lit("2024-01-20").cast("date")
    shows = F.array(*(F.when(telemetry.window_filter(F.col("ts"), s, day), s) for s in ("today", "week", "all")))
    return a.withColumn("show", F.explode(F.array_compact(shows))).groupBy("show", "kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def journal_chunks(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("m", F.get_json_object("props", "$.k").cast("int") % 20)
    chunks = e.where("event_type = 'purchase'").select(F.col("user_id").alias("session"), "ts", F.format_string("src/m%d.py", "m").alias("source"))
    seen = e.where("event_type in ('view', 'click')").select(F.col("user_id").alias("session"), "ts", F.when(F.col("event_type") == "view", F.format_string("/repo/src/m%d.py", "m")).alias("path"), F.when(F.col("event_type") == "click", F.format_string("look at m%d.py, now", "m")).alias("text"))
    return chunks, seen


@query("""with e as (select *, json_extract_string(props, '$.k')::int % 20 as m from events)
select distinct c.user_id as session, epoch_us(c.ts) as ts, 'src/m' || c.m || '.py' as source from e c where event_type = 'purchase' and exists (select 1 from e v where v.user_id = c.user_id and v.m = c.m and v.ts > c.ts and v.event_type in ('view', 'click'))""")
def q_later_use_semi(spark, sf_dir):
    return telemetry.used_later(*journal_chunks(spark, sf_dir)).select("session", F.unix_micros("ts").alias("ts"), "source")


@query("""with r as (select event_id, json_extract_string(props, '$.k')::int as k, value from events), f as (select *, k % 3 > 0 as filled, k % 2 as dd, case when k % 7 = 0 then 1 else 0 end as st, k % 4 > 0 as ex, k % 5 = 0 as ru, k % 6 < 3 as code, k % 8 = 0 as sh, value > 20 as used, value > 30 as su from r),
a as (select count(*) as n, count(*) filter (filled) as ne, count(*) filter (filled or dd > 0 or st > 0) as ca, count(*) filter (filled and used) as u, count(*) filter (sh) as shn, count(*) filter (filled and dd > 0) as rp, count(*) filter (filled and not ex) as sl, count(*) filter (filled and code and ru) as lm, count(*) filter (dd > 0) as ds, count(*) filter (st > 0) as sd, count(*) filter (su) as su from f)
select n as rows, ne as non_empty, ca as candidates, round(ne / n, 4) as injection_rate, round(u / ne, 4) as use_rate, round(100 * u / n, 2) as useful_per_100_edits, round(rp / ne, 4) as repeat_rate, round(sl / ne, 4) as stale_rate, round(lm / ne, 4) as lang_mismatch_rate, round(ds / ca, 4) as dedup_suppressed_rate, round(sd / ca, 4) as stale_dropped_rate, round(su / shn, 4) as shadow_use_rate, u as used_events, shn as shadow_rows from a""")
def q_hook_rates(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    chunk = F.struct(F.lit("s").alias("source"), F.lit(1.0).alias("score"), (F.col("k") % 4 > 0).alias("exists"), F.when(F.col("k") % 5 == 0, "ru").otherwise("en").alias("lang"))
    none = F.array().cast("array<struct<source:string,score:double,exists:boolean,lang:string>>")
    rows = e.select(F.col("event_id").alias("row_id"), F.when(F.col("k") % 3 > 0, F.array(chunk)).otherwise(none).alias("chunks"), (F.col("k") % 2).alias("deduped"), F.when(F.col("k") % 7 == 0, 1).alias("stale"), (F.col("k") % 6 < 3).alias("target_is_code"), F.when(F.col("k") % 8 == 0, F.array(chunk)).otherwise(none).alias("shadow_chunks"))
    ids = lambda c: e.where(c).select(F.col("event_id").alias("row_id"))
    return telemetry.hook_stats(rows, ids("value > 20"), ids("value > 30"))


@query("""with c as (select *, json_extract_string(props, '$.k')::int as k from events), t as (select *, case when event_type = 'error' then 'foreign' when value / 50 < 0.1 and event_type <> 'signup' then 'floor' when k % 9 = 0 then 'stale' end as early from c),
u as (select *, row_number() over (partition by user_id, k, early is null order by ts, event_id) as again from t)
select coalesce(early, case when k = 5 or again > 1 then 'deduped' end, 'kept') as drop_reason, count(*) as n from u group by 1""")
def q_hook_filter_counts(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("pos"), F.get_json_object("props", "$.k").cast("int").alias("key"), "event_type", F.when(F.col("event_type") != "signup", F.col("value") / 50).alias("rerank_score"))
    seen = e.where("key = 5").select("session", "key")
    tagged = telemetry.tag_drops(e, F.col("event_type") != "error", 0.1, F.col("key") % 9 != 0, seen)
    return tagged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


@query("""with r as (select *, sum(case when prev is null or epoch_us(ts) - epoch_us(prev) > 86400000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events))
select session, run::bigint as run, key, id from (select user_id as session, run, event_type as key, event_id as id, row_number() over (partition by user_id, run, event_type order by ts, event_id) as n from r) where n = 1""")
def q_session_dedup(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("key"), "ts", F.col("event_id").alias("id"))
    return telemetry.session_dedup(e).select("session", "run", "key", "id")


def judged(spark, sf_dir):
    """(qrels, run): of an item's 50 best documents those labelled good; the run is the boosted ranking of the 20 best."""
    good = load(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    best = cut(bm25(spark, sf_dir, 50))
    gold = best.join(good, "id", "left_semi").select("qid", F.col("id").alias("docid"), F.lit(1).alias("rel"))
    return gold, boosted(spark, sf_dir, best.where("rk <= 20")).select("qid", F.col("id").alias("docid"), "score")


_BM20 = "bm as (select * from b50 where rk <= 20)"
_JUDGED = f"{_bm25(50, name='b50')}, {_BM20}, {P}, {_BOOST}, qr as (select qid, id as docid from b50 where exists (select 1 from labels where doc_id = id and quality = 1)), ra as (select qid, id as docid, row_number() over (partition by qid order by score desc, id desc) as rank from bo)"
_METRICS = """pq as (select qid, count(*) as n, count(*) filter (rank <= 1) as r1, count(*) filter (rank <= 5) as r5, count(*) filter (rank <= 10) as r10, count(*) filter (rank <= 20) as r20, min(rank) as best, sum(case when rank <= 10 then 1 / log2(rank + 1) else 0 end) as dcg from qr left join ra using (qid, docid) group by qid),
me as (select count(*) as queries, round(avg(r1 / n), 6) as recall_at_1, round(avg(r5 / n), 6) as recall_at_5, round(avg(r10 / n), 6) as recall_at_10, round(avg(r20 / n), 6) as recall_at_20, round(avg(coalesce(1 / best, 0)), 6) as mrr, round(avg(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1)))), 6) as ndcg_at_10 from pq)"""


@query(f"with {_JUDGED}, {_METRICS} select * from me")
def q_ir_metrics(spark, sf_dir):
    return evaluation.ir_metrics(*judged(spark, sf_dir))


@query(f"with {_bm25()} select qid, source as docid, arg_max(score, rk) as score from bm join documents on doc_id = id group by qid, source")
def q_doc_run_last_wins(spark, sf_dir):
    return evaluation.doc_run(with_points(spark, sf_dir, cut(bm25(spark, sf_dir))).withColumnRenamed("source", "docid"))


@query(f"with {_JUDGED} select qid, round(count(rank) filter (rank <= 5) / count(*), 6) as recall from qr left join ra using (qid, docid) group by qid")
def q_chunk_recall(spark, sf_dir):
    gold, run = judged(spark, sf_dir)
    # ranks of ties by falling id, as in the metric's definition
    rk = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("docid")))
    return evaluation.chunk_recall(gold.groupBy("qid").agg(F.collect_list("docid").alias("gold")), run.select("qid", F.col("docid").alias("id"), rk.alias("rk")), 5)


def blobs(spark, sf_dir):
    top = evaluation.joined_top(with_points(spark, sf_dir, cut(bm25(spark, sf_dir, 5))))
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("answer")).join(top, "qid", "left").withColumn("blob", F.coalesce("blob", F.lit("")))


_BLOB = f"{_bm25(5)}, tb as (select qid, string_agg(text, ' ' order by rk) as blob from bm join documents on doc_id = id group by qid), bl as (select item_id as qid, text as answer, coalesce(blob, '') as blob from benchmark left join tb on qid = item_id)"
_WHITE = r"\s+"


@query(f"with {_BLOB}, r as (select *, list_filter(regexp_split_to_array(answer, '{_WHITE}'), lambda x: length(x) >= 6)[1:3] as req from bl) select qid, round(case when len(req) > 0 then len(list_filter(req, lambda s: contains(blob, s))) / len(req) else 0 end, 6) as recall from r")
def q_substring_recall(spark, sf_dir):
    req = F.slice(F.filter(F.split("answer", _WHITE), lambda x: F.length(x) >= 6), 1, 3)
    return blobs(spark, sf_dir).withColumn("req", req).select("qid", F.round(evaluation.substring_recall(F.col("req"), F.col("blob")), 6).alias("recall"))


_HEUR = f"he as (select qid, blob, answer, list_filter(regexp_split_to_array(lower(answer), '{_WHITE}'), lambda x: length(x) >= 4) as tk from bl), hr as (select qid, greatest(1, length(blob) // 4) as tokens, case when len(tk) > 0 then len(list_filter(tk, lambda t: contains(lower(blob), t))) / len(tk) else contains(lower(blob), lower(answer))::int::double end as recall from he)"


@query(f"with {_BLOB}, {_HEUR} select qid, round(recall, 6) as recall from hr")
def q_heuristic_recall(spark, sf_dir):
    return blobs(spark, sf_dir).select("qid", F.round(evaluation.heuristic_recall(F.col("answer"), F.col("blob")), 6).alias("recall"))


@query(f"with {_BLOB}, {_HEUR} select qid, tokens, round(case when recall > 0 then tokens / recall else tokens end, 6) as tokens_per_correct from hr")
def q_tokens_per_correct(spark, sf_dir):
    recall = evaluation.heuristic_recall(F.col("answer"), F.col("blob"))
    return blobs(spark, sf_dir).withColumn("tokens", S.token_estimate(F.col("blob"))).select("qid", "tokens", F.round(evaluation.tokens_per_correct(F.col("tokens"), recall), 6).alias("tokens_per_correct"))


@query("select lang, count(*) as n, round(coalesce(avg(quality), 0), 6) as quality, round(coalesce(avg(toxic), 0), 6) as toxic from documents left join labels using (doc_id) group by lang")
def q_axis_means(spark, sf_dir):
    df = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluation.axis_means(df, ["lang"], ["quality", "toxic"])


FLOORS = [("recall_at_5", 0.05), ("recall_at_20", 0.9), ("mrr", 0.5), ("ndcg_at_10", 0.6), ("unknown", 1.0)]
_LONG = "lo as (unpivot (select recall_at_5, recall_at_20, mrr, ndcg_at_10 from me) on columns(*) into name metric value value)"
_FLOORS = ", ".join(f"('{m}', {b})" for m, b in FLOORS)


def long_metrics(spark, sf_dir):
    m = evaluation.ir_metrics(*judged(spark, sf_dir))
    return m.select(F.explode(F.create_map(*(x for k in ("recall_at_5", "recall_at_20", "mrr", "ndcg_at_10") for x in (F.lit(k), F.col(k))))).alias("metric", "value"))


@query(f"with {_JUDGED}, {_METRICS}, {_LONG} select metric, value, bound::double as bound, value >= bound as ok from lo join (values {_FLOORS}) f(metric, bound) using (metric)")
def q_gate_floors(spark, sf_dir):
    return evaluation.gate(long_metrics(spark, sf_dir), spark.createDataFrame(FLOORS, "metric string, bound double")).select("metric", "value", "bound", "ok")


@query(f"with {_JUDGED}, {_METRICS}, {_LONG} select metric, round(value - bound, 6) as delta from lo join (values {_FLOORS}) f(metric, bound) using (metric)")
def q_baseline_delta(spark, sf_dir):
    old = spark.createDataFrame([(m, str(b)) for m, b in FLOORS] + [("mrr_note", "n/a")], "metric string, value string")
    return evaluation.baseline_delta(long_metrics(spark, sf_dir), old)


@query("with n as (select lang, source, count(*) as n from documents group by all), t as (select sum(n) as total from n) select lang, source, n, least(n, greatest(1, round_even(100.0 * n / total, 0)))::bigint as quota from n, t")
def q_stratified_quota(spark, sf_dir):
    return evaluation.stratified_quota(load(spark, sf_dir, "documents"), ["lang", "source"], 100)


_QUOTA = "n as (select lang, source, count(*) as n from documents group by all), t as (select sum(n) as total from n), qu as (select lang, source, least(n, greatest(1, round_even(100.0 * n / total, 0)))::bigint as quota from n, t)"
_ORDER = "md5('{}:' || doc_id)"


@query(f"with {_QUOTA}, rn as (select d.doc_id, lang, source, n_chars, {_ORDER.format(42)} as h, row_number() over (partition by lang, source order by {_ORDER.format(42)}, doc_id) as rn from documents d) select doc_id, lang, source, n_chars from (select rn.*, quota from rn join qu using (lang, source) order by (rn > quota)::int, rn, h, doc_id limit 100)")
def q_stratified_sample(spark, sf_dir):
    return evaluation.stratified(load(spark, sf_dir, "documents").drop("text"), ["lang", "source"], 100, "doc_id")


@query(f"with {P} select r.room, count(points.id) as n from (values ('en'), ('de'), ('fr'), ('es'), ('it'), (null)) r(room) left join points on points.room is not distinct from r.room group by r.room")
def q_room_histogram(spark, sf_dir):
    return admin.room_histogram(points(spark, sf_dir), ["en", "de", "fr", "es", "it"])


@query(f"""with {P} select count(*) filter (valid_to is null or valid_to > timestamp '{NOW}') as live, count(*) filter (valid_to <= timestamp '{NOW}') as superseded, count(*) filter (valid_from > timestamp '{NOW}') as future,
count(*) filter (valid_to <= timestamp '{NOW}' and epoch_us(timestamp '{NOW}') - epoch_us(valid_to) > 3 * 86400000000) as awaiting_gc, epoch_us(min(valid_from)) as oldest, epoch_us(max(valid_from)) as newest, round((epoch_us(timestamp '{NOW}') - epoch_us(max(valid_from))) / 86400000000.0, 6) as age_days, epoch_us(timestamp '{NOW}') - epoch_us(max(valid_from)) > 7 * 86400000000 as stale from points""")
def q_temporal_panel(spark, sf_dir):
    return admin.temporal_panel(points(spark, sf_dir), now(), 3).withColumns({c: F.unix_micros(c) for c in ("oldest", "newest")})


@query("select chunker, count(*) as n from (select case when doc_id % 3 = 0 then 'transcript' else 'markdown' end as chunker from documents) group by chunker")
def q_chunker_counts(spark, sf_dir):
    return points(spark, sf_dir).groupBy("chunker").agg(F.count("*").alias("n"))


@query(f"with {_JUDGED} select qid as query_id, docid as corpus_id, 1 as score from qr")
def q_qrels_export(spark, sf_dir):
    gold, _ = judged(spark, sf_dir)
    return sinks.qrels(gold.groupBy(F.col("qid").alias("id")).agg(F.collect_list("docid").alias("gold")))


@query("""with i as (select doc_id, sha256(text) as content_hash, substr(sha256(source || '|' || text), 1, 16) as key, 'd' || doc_id || '#' || substr(sha1(text), 1, 12) as chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '#chunk=0#hash=' || sha256(text))) as h from documents)
select doc_id, content_hash, key, chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::int % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id from i""")
def q_chunk_ids(spark, sf_dir):
    d, t = load(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", S.sha256(t).alias("content_hash"), S.chunk_key(F.col("source"), t).alias("key"), S.bench_chunk_id(F.concat(F.lit("d"), F.col("doc_id").cast("string")), t).alias("chunk_id"), S.point_id(F.col("source"), F.lit(0), S.sha256(t)).alias("point_id"))


#: Path bonuses of this query's table; admin.SNAPSHOT_BONUSES are the production ones.
BONUSES = [("src1/", 0.30), ("/de/", 0.15), ("/en/", 0.05)]


@query(f"""with {P}, l as (select * from points where valid_to is null or valid_to > timestamp '{NOW}' order by id limit 512)
select id, round(exp(-greatest({_AGE}, 0) / 30.0) + case when contains(file_path, 'src1/') then 0.30 when contains(file_path, '/de/') then 0.15 when contains(file_path, '/en/') then 0.05 else 0 end, 9) as score from l order by score desc, id limit 80""")
def q_snapshot_rank(spark, sf_dir):
    return admin.snapshot_rank(points(spark, sf_dir).withColumn("updated_at", F.lit(None).cast("timestamp")), now(), BONUSES).select("id", "score")


@query("select doc_id, case when length(text) > 200 then substr(text, 1, 199) || '…' else text end as preview from documents")
def q_preview(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", S.preview(F.col("text"), 200).alias("preview"))


@query(f"with {_bm25()}, {P} select qid, rk, bm.id, score, case when length(text) > 200 then substr(text, 1, 199) || '…' else text end as preview, greatest(1, length(text) // 4) as tokens, source, file_path, 5 as clamped_to from bm join points on points.id = bm.id where rk <= 5 and trim(text) <> ''")
def q_search_response(spark, sf_dir):
    return retrieval.search_response(with_points(spark, sf_dir, cut(bm25(spark, sf_dir))), 50, cap=5)


_CYRILLIC = [(-1, "привет, мир"), (-2, "mostly latin да"), (-3, "да нет ok"), (-4, "12 !"), (-5, "")]


@query("with documents as (select doc_id, text from main.documents union all select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in _CYRILLIC) + ")) " + r"select doc_id, case when length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0 and length(regexp_replace(text, '[^\p{Cyrillic}]', '', 'g')) > 0.3 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) then 'ru' else 'en' end as lang from documents")
def q_lang_detect(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(_CYRILLIC, "doc_id long, text string"))
    return rows.select("doc_id", S.cyrillic(F.col("text")).alias("lang"))


@query("select conv_id::varchar as session_id, (row_number() over (partition by conv_id order by turn) - 1)::int as turn, role || ': ' || text as document from conversations qualify trim(text) <> ''")
def q_haystack_flatten(spark, sf_dir):
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    rec = c.select(F.lit("q").alias("question_id"), F.array(F.col("conv_id").cast("string")).alias("haystack_session_ids"), F.array(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("haystack_sessions"))
    return readers.haystack(rec).select("session_id", "turn", "document")


@query(f"""with {_PATHS}, sp as (select *, string_split(path, '/') as every from pp) select page_id, path, (regexp_matches(path, '(\\.py|\\.ts|\\.md)$') or path in ('README.md', 'CHANGELOG.md', 'AGENTS.md', 'llms.txt'))
 and every[1] not in ('tests', 'dist', 'build', '.planning', '.gsd') and not list_contains(every[1:-2], 'tests') and not list_contains(every, '__pycache__') and not regexp_matches(every[-1], '^test_.*\\.py$|_test\\.py$|\\.lock$|\\.generated\\.') as taken from sp""")
def q_corpus_filter(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", "path", readers.corpus_path(F.col("path")).alias("taken"))


@query("""with g as (select *, sum(case when prev is null or epoch_us(ts) - epoch_us(prev) > 1800000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events))
select user_id as session, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) + 1800000000 as end_us, count(*) as n from g group by user_id, s""")
def q_session_windows(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts")
    return pipelines.session_usage(e).select("session", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("select time_bucket(interval 1 day, ts)::date::varchar as day, event_type as kind, count(*) as n, sum(json_extract_string(props, '$.k')::bigint)::bigint as tokens from events group by all")
def q_windowed_usage(spark, sf_dir):
    return pipelines.windowed_usage(audit(spark, sf_dir)).select(F.to_date("start").cast("string").alias("day"), "kind", "n", "tokens")


@query(f"with {P} select id, room, old <> room as changed from (select id, case when source = 'src1' then 'one' when room in ('de', 'fr') then 'europe' end as room, room as old from points)".replace("old <> room as changed", "old is distinct from room as changed"))
def q_reclassify(spark, sf_dir):
    return ingest.reclassify(points(spark, sf_dir), {"one": ["src1"], "europe": ["de", "fr"]}).select("id", "room", F.col("room_changed").alias("changed"))


@query("select doc_id, case when s = '' then 'untitled' else s end as slug from (select doc_id, substr(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) as s from documents)")
def q_slugs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", S.slug(F.col("text")).alias("slug"))


def _search(where: str, filtered: int, expanded: str = "text") -> str:
    """The whole search in SQL: filter, arms, fusion, recency, decay, hash and greedy deduplication, budget, k."""
    return f"""with recursive {P}, documents as (select d.* from main.documents d join points p on p.id = d.doc_id where {where}), benchmark as (select item_id, {expanded} as text, text as said from main.benchmark), {_bm25()},
{_dense(_ASKED, _EVERY + ' join documents on doc_id = vec_id')},
sc2 as (select item_id as qid, 0.40 * least(1, greatest(1, length(said) // 4) / 64.0) + 0.25 * least(1, ({_occ('said', '?')} + {_occ('lower(said)', ' and ')} + {_occ('lower(said)', ' or ')} + {_occ('said', ';')} + {_occ('said', ':')}) / 3.0)
 + 0.15 * {filtered} + 0.20 * least(1, (len(regexp_extract_all(said, '[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+')) + {_occ('said', '::')} + {_occ('said', '.py')} + {_occ('said', '`')} // 2) / 2.0) as c from benchmark),
ke as (select qid, greatest(5, least(20, floor(5 * (1 + 0.5 * c))))::int as k_eff from sc2),
fu as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rk from (select qid, id, round(sum(1.0::double / (60 + rk)), 9) as score from (select qid, id, rk from de union all select qid, id, rk from bm) group by qid, id)) join ke using (qid) where rk <= greatest(2 * k_eff, 10)),
b1 as (select fu.qid, fu.id, k_eff, rk as r0, round(score * (1 + 0.1 * exp(-greatest({_AGE}, 0) / 30.0)), 9) as score, chunker, valid_from, content_hash, text from fu join points on points.id = fu.id),
b2 as (select *, row_number() over (partition by qid order by score desc, r0) as r1 from b1),
b3 as (select * exclude (score), round(score * case when chunker = 'transcript' then 0.7 + (1 - 0.7) * pow(0.5, greatest({_AGE}, 0) / 14.0) else 1 end, 9) as score from b2),
b4 as (select *, row_number() over (partition by qid order by score desc, r1) as rk from b3),
b5 as (select * from (select *, row_number() over (partition by qid, content_hash order by rk) as same from b4) where same = 1),
o as (select b5.*, v.embedding::double[] as v, row_number() over (partition by qid order by rk) as i from b5 left join embeddings v on v.vec_id = b5.id),
g as (select qid, i, [id] as kept, case when v is null then [] else [v] end as kv from o where i = 1 union all
 select x.qid, x.i, case when hit then kept else list_append(kept, x.id) end, case when hit or x.v is null then kv else list_append(kv, x.v) end
 from (select g.qid, o.i, g.kept, g.kv, o.id, o.v, o.v is not null and len(list_filter(g.kv, lambda k: list_cosine_similarity(k, o.v) >= 0.97)) > 0 as hit from g join o on o.qid = g.qid and o.i = g.i + 1) x),
gk as (select qid, unnest(kept) as id from (select qid, arg_max(kept, i) as kept from g group by qid)),
b6 as (select b4.*, sum(greatest(1, length(text) // 4)) over (partition by qid order by rk)::bigint as used_tokens, row_number() over (partition by qid order by rk) as n from b4 join gk using (qid, id)),
b7 as (select *, row_number() over (partition by qid order by rk) as place from b6 where n = 1 or used_tokens <= 1500)
select qid, place, id, score, used_tokens from b7 where place <= k_eff"""


def searchable(spark, sf_dir):
    return as_points(spread(load(spark, sf_dir, "documents"), "doc_id")).withColumn("updated_at", F.lit(None).cast("timestamp")).join(vectors(spark, sf_dir), "id", "left")


_WHOLE = Config(decay_enabled=True, content_dedup=True)


@query(_search(f"room in ('en', 'de') and (valid_to is null or valid_to > timestamp '{NOW}')", 1))
def q_search(spark, sf_dir):
    p = searchable(spark, sf_dir)
    where = predicates.predicate({"room": ["en", "de"]}, p, now=NOW)
    hits = lookup("retrieval", "tuned_hybrid")(p, asked(spark, sf_dir), where=where, now=NOW, config=_WHOLE)
    return hits.select("qid", "place", "id", "score", "used_tokens")


_LATER = "2024-01-20 00:00:00"
#: A filter and a moment for each remainder of the item's number: the map, the moment, the same in SQL.
_RULES = [
    ({"room": ["en", "de"], "valid_to": ["now"]}, NOW, "room in ('en', 'de')"),
    ({"source": ["src0", "src1", "src2", "src3", "src4"]}, _LATER, "p.source in ('src0', 'src1', 'src2', 'src3', 'src4')"),
    ({}, NOW, "true"),
    ({"path_prefix": ["src1/en", "src2/en", "src3/fr", "src4/de"], "chunker": ["markdown"], "absent": []}, _LATER, "false"),
    ({"path_prefix": ["src1/en", "src2/en", "src3/fr", "src0/de"], "chunker": ["markdown"]}, _LATER, "p.source || '/' || room in ('src1/en', 'src2/en', 'src3/fr', 'src0/de') and chunker = 'markdown'"),
]


def _per_query_sql() -> str:
    parts = [_search(f"({sql}) and (valid_to is null or valid_to > timestamp '{NOW}')", int(len(set(where) - {"valid_to"}) > 0)).replace(NOW, at) for where, at, sql in _RULES]
    return " union all ".join(f"select * from ({p}) where qid % {len(_RULES)} = {i}" for i, p in enumerate(parts))


@query(_per_query_sql())
def q_search_per_query(spark, sf_dir):
    """Every item with a filter and a moment of its own: five rules in one batch, one of which admits nothing."""
    k = F.col("qid") % len(_RULES)
    pick = lambda f: F.coalesce(*(F.when(k == i, f(r)) for i, r in enumerate(_RULES)))
    where = pick(lambda r: F.from_json(F.lit(json.dumps(r[0])), filters.WHERE))
    q = asked(spark, sf_dir).withColumn("where", where).withColumn("now", pick(lambda r: F.lit(r[1])))
    return retrieval.search(searchable(spark, sf_dir), q, now=NOW, config=_WHOLE).select("qid", "place", "id", "score", "used_tokens")


@query(_search("true", 0, "'report ' || text"))
def q_search_expanded(spark, sf_dir):
    q = asked(spark, sf_dir).withColumn("expanded_text", F.concat(F.lit("report "), "text"))
    return lookup("retrieval", "tuned_hybrid_hyde")(searchable(spark, sf_dir), q, now=NOW, config=_WHOLE).select("qid", "place", "id", "score", "used_tokens")


@query(f"""with recursive {P}, benchmark as (select item_id, text, text as said from main.benchmark), {_bm25(50)}, {_dense(_ASKED, _EVERY, 50)},
fu as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rk from (select qid, id, round(sum(1.0::double / (60 + rk)), 9) as score from (select qid, id, rk from de union all select qid, id, rk from bm) group by qid, id)) where rk <= 50),
wd as (select fu.qid, fu.id, rk, list_filter(list_distinct(string_split_regex(lower(trim(b.said)), '\\s+')), lambda x: x <> '') as want, list_distinct(string_split_regex(lower(d.text), '\\s+')) as have from fu join benchmark b on b.item_id = fu.qid join main.documents d on d.doc_id = fu.id)
select qid, id, round(len(list_intersect(want, have)) / greatest(1, len(want)), 6) as rerank_score, row_number() over (partition by qid order by len(list_intersect(want, have)) / greatest(1, len(want)) desc, rk) as rk from wd""")
def q_rerank(spark, sf_dir):
    q = asked(spark, sf_dir)
    fused = retrieval.rrf([retrieval.dense_topk(vectors(spark, sf_dir), q.where("vec is not null").select("qid", "vec"), 50), bm25(spark, sf_dir, 50)], n=50)
    hits = with_points(spark, sf_dir, cut(fused)).join(q.select("qid", F.col("text").alias("query")), "qid")
    return retrieval.rerank(hits, lookup("reranker", "lexical"), 50).select("qid", "id", F.round("rerank_score", 6).alias("rerank_score"), "rk")


_DRAWN = f"""dd as (select avg(a - b) as delta from ab), dw as (select r.range as id, a - b as d, len(list_filter([{', '.join(map(repr, evaluation.POISSON))}], lambda c: ('0x' || substr(md5('42:' || r.range || ':' || qid), 1, 8))::bigint / 4294967296.0::double >= c)) as w from ab, range(1000) r),
dr as (select id, sum(w * d) / nullif(sum(w), 0) as m from dw group by id), ci as (select quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from dr)"""


@query(f"""with {_BLOB}, {_HEUR}, ab as (select he.qid, hr.recall as a, case when len(w) > 0 then len(list_filter(w, lambda s: contains(he.blob, s))) / len(w) else 0 end as b from (select *, regexp_split_to_array(answer, '{_WHITE}') as w from he) he join hr using (qid)), {_DRAWN}
select round(delta, 6) as delta, round(lo, 6) as ci_lower, round(hi, 6) as ci_upper, case when lo > 0 then 'win' when hi < 0 then 'loss' else 'tie' end as verdict from dd, ci""")
def q_paired_bootstrap(spark, sf_dir):
    b = blobs(spark, sf_dir).select("qid", evaluation.heuristic_recall(F.col("answer"), F.col("blob")).alias("a"), evaluation.substring_recall(F.split("answer", _WHITE), F.col("blob")).alias("b"))
    return evaluation.paired_bootstrap(cut(b), 1000).withColumns({c: F.round(c, 6) for c in ("delta", "ci_lower", "ci_upper")})


_CELLS = {"decision_rationale.own.recall_at_1": ("recall_at_1", 1.1), "decision_rationale.own.recall_at_5": ("recall_at_5", 0.0), "code_fact.combined.ndcg_at_10": ("ndcg_at_10", 1.1), "code_fact.combined.latency_ms_p95": ("queries", 1e9), "code_fact.combined.recall_at_20": ("recall_at_20", 1.1), "code_fact.combined.recall_at_5": ("recall_at_5", 0.0)}


@query(f"with {_JUDGED}, {_METRICS}, c as (" + " union all ".join(f"select '{m}' as metric, {v} as value, {b} as bound from me" for m, (v, b) in _CELLS.items()) + """), x as (select metric, value < bound as below, value >= bound as holds from c),
p as (select max(below::int) filter (metric like '%own.recall_at_1') as r1, max(holds::int) filter (metric like '%own.recall_at_5') as r5, max(below::int) filter (metric like '%ndcg_at_10') as nd, max(below::int) filter (metric like '%latency_ms_p95') as fast, max(below::int) filter (metric like '%recall_at_20') as r20, max(holds::int) filter (metric like '%combined.recall_at_5') as r5c from x)
select 'arm_n' as field, '60' as value from p where r1 * r5 = 1 union all select 'adaptive', 'true' from p where nd * fast = 1 union all select 'adaptive_delta', '0.25' from p where nd * fast = 1 union all select 'rerank_n', '40' from p where fast = 0 union all select 'content_dedup', 'true' from p where r20 * r5c = 1""")
def q_diagnose(spark, sf_dir):
    m = cut(evaluation.ir_metrics(*judged(spark, sf_dir)))
    cells = [m.select(F.lit(metric).alias("metric"), F.col(v).cast("double").alias("value"), F.lit(b).alias("bound")) for metric, (v, b) in _CELLS.items()]
    out = cells[0]
    for c in cells[1:]:
        out = out.unionByName(c)
    return evaluation.diagnose(out)


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: a hybrid search of all benchmark items."""
    return q_search(spark, "/root/testdata/sf0.001")


def _more() -> None:
    """The queries of the other modules register themselves here."""
    from memlake.plans import derived, streams, tables  # noqa: F401


_more()
