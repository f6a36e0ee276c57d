"""The jobs as registered queries: each runs twice over the whole tables into one new folder, and gives the output as it then stands."""

from __future__ import annotations

import uuid

from memlake.shared import shared_dir
from pyspark.sql import DataFrame, SparkSession

from jobs import daily_usage, document_memory


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_document_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "document-memory")
    for _ in range(2):
        # as a pattern: a stream takes one that matches a file or a folder, but by its name only a folder
        document_memory.run(spark, f"{sf_dir}/documents.parque[t]", f"{root}/memory", f"{root}/checkpoint")
    return document_memory.current_chunks(spark, f"{root}/memory").drop("batch")


def job2_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "daily-usage")
    for _ in range(2):
        daily_usage.run(spark, f"{sf_dir}/events.parquet", f"{root}/report")
    return daily_usage.read_report(spark, f"{root}/report")


QUERIES = {f.__name__: f for f in (job1_document_memory, job2_daily_usage)}

ORACLE = {
    "job1_document_memory": """
with d as (select doc_id, lang, source, sha256(coalesce(text, '')) as content_hash, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from documents where doc_id is not null),
p as (select *, unnest(range(0, greatest(len(w) - 16, 1), 112)) as i from d where len(w) > 0),
c as (select doc_id, (i // 112)::int as chunk_idx, array_to_string(w[i + 1 : i + 128], ' ') as document, content_hash, source, lang from p),
k as (select *, sha256(document) as chunk_hash, greatest(1, length(document) // 4) as tokens from c)
select doc_id, chunk_idx, document, chunk_hash, content_hash, tokens, source, lang
from (select *, row_number() over (partition by doc_id, chunk_hash order by chunk_idx) as again from k where tokens >= 20) where again = 1""",
    "job2_daily_usage": """
with e as (select ts::date as day, coalesce(event_type, '?') as kind, coalesce(json_extract_string(props, '$.k')::bigint, 0) as t, value, user_id from events where ts is not null)
select kind, count(*) as calls, sum(t)::bigint as tokens, round(avg(t), 6) as mean_tokens, max(t) as most_tokens, count(distinct user_id) as users,
 round(quantile_cont(value, 0.5), 6) as p50_ms, round(quantile_cont(value, 0.95), 6) as p95_ms, day from e group by day, kind""",
}
