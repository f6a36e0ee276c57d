"""The registered queries of the corpus operators and their SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_gru, mixing, orc_tokens, packing, parity_join, pii, pu_quality, site_tree, vector_graph, whitening
from .common import held_out, table

#: Rows that models may learn from.
LEARN = "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pu_quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=LEARN)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


#: The mixture's tree: domains by source, languages in each domain; sources of a language share evenly.
DOMAINS = {"web": 0.5, "reference": 0.3, "forum": 0.2}
LANGS = {
    "web": {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1},
    "reference": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "forum": {"en": 0.7, "de": 0.1, "fr": 0.1, "es": 0.1},
}


def domain_of(source: Column) -> Column:
    """src0 to src9 are web, src10 to src14 reference, all others forum."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "^src([0-9]{1,9})$", 1)
    number = F.when(n != "", n).cast("int")
    return F.when(number < 10, "web").when(number < 15, "reference").otherwise("forum")


def op3_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, domain_of(F.col("source")), DOMAINS, LANGS, share=0.75, epochs=2, seed=3)
    return mixed.select("doc_id", F.col("mix_.epoch").alias("epoch"), F.col("mix_.domain").alias("domain"), "lang", "source", F.col("mix_.tokens").alias("n_tokens"), F.col("mix_.take").alias("take_tokens"))


def op4_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_gru.score_language(docs, language_gru.fit_language(docs, learn=LEARN))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op6_parity_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.parity_join(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.encode_to_orc(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract_pages(table(spark, sf_dir, "pages"))


def op11_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, most=2048)


def op12_compensated_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=32)


QUERIES = {f.__name__: f for f in (op1_pu_quality, op2_vector_graph, op3_hierarchical_mix, op4_language_gru, op5_pii, op6_parity_jaccard_join, op7_exact_dedup, op8_orc_token_ids, op9_byte_bpe, op10_site_style_tree, op11_binary_packing, op12_compensated_whitening)}

ORACLE = {
    "op2_vector_graph": """
with recursive v as (select vec_id, label, cast(embedding as double[]) as x from embeddings),
u as (select * from v where label is not null and x is not null and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
links as (select p.vec_id as a, q.vec_id as b from u p join u q on p.label = q.label and len(p.x) = len(q.x) and p.vec_id <> q.vec_id where list_cosine_similarity(p.x, q.x) >= 0.93),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
k as (select a, min(b) as component_id from reach group by a), m as (select a, count(*) as n from links group by a),
w as (select case when count(*) > 0 then cast(1 as double) end as audit_recall from links)
select v.vec_id, coalesce(m.n, 0) as n_links, k.component_id, v.vec_id = k.component_id as kept, w.audit_recall from v left join m on v.vec_id = m.a join k on v.vec_id = k.a cross join w""",
    "op5_pii": pii.oracle(),
    "op6_parity_jaccard_join": """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
z as (select s.doc_id, s.g, n.n from s join n on s.doc_id = n.doc_id),
links as (select x.doc_id as a, y.doc_id as b from z x join z y on x.g = y.g and x.doc_id <> y.doc_id and 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
    group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a),
k as (select a, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, k.component_id from documents d left join n on d.doc_id = n.doc_id join k on d.doc_id = k.a""",
    "op7_exact_dedup": """
with d as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm from documents),
k as (select norm, arg_min(doc_id, (-length(text), doc_id)) as keep_id, count(*) as group_size from d group by norm)
select d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id as kept, sha256(d.norm) as text_sha256 from d join k on d.norm = k.norm""",
}
