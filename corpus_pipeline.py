"""The corpus pipeline: language, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet
in the shared folder and reads it again as the next stage's docs. All stages but the last
return the columns of documents. A language model cannot be written as SQL, so the
pipeline has no ORACLE_SQL; the tests hold it against a version without Spark.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import bpe, exact_dedup, language_gru, mixing, parity_join
from memlake.llm.common import WHITE, cut, discard, free_name, release, scratch_path, table
from memlake.llm.queries import DOMAINS, LANGS, LEARN, domain_of

#: A document goes if it has no letter, or if no language reaches this probability.
LEAST_LANGUAGE_SCORE = 0.4
#: Repeated ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the language model recognises.

    Null and empty texts and texts without a letter go. Repeated rows and ids, and null
    ids, languages and sources, are kept as they are. An empty table stays empty.
    """
    model = language_gru.fit_language(docs, learn=LEARN)
    return language_gru.keep_recognised(docs, model, least=LEAST_LANGUAGE_SCORE)


def packed(docs: DataFrame) -> Column:
    """A row as one struct, so that no column of a table clashes with a stage's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that is identical without white space, also where ids repeat or are missing.

    Null and empty texts are copies of each other. An empty table stays empty.
    """
    kept = exact_dedup.exact_dedup(docs).where("kept")
    release(spark)  # what the groups shuffled, before the rows are
    # a winner is found by its id and digest; the copies that share both are combined before the join, so no key is hot
    ident = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")]
    kept = kept.select(*ident, F.col("text_sha256").alias("sha")).distinct()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(packed(docs), *ident, F.sha2(F.translate(text, WHITE, ""), 256).alias("sha"), F.length(text).alias("n"))
    best = rows.groupBy("id", "no_id", "sha").agg(F.max_by("row", F.struct("n", F.xxhash64("row"))).alias("row"))
    return best.join(kept, ["id", "no_id", "sha"], "left_semi").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles.

    Null and empty texts link with nothing and stay, as does one row of each null or
    repeated id and text. An empty table stays empty.
    """
    keyed = keyed_rows(docs)
    return parity_join.keep_one(keyed, parity_join.parity_join(keyed, width=5, num=80, den=100)).select("row.*")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text), doc_id the key of one text: the id, or where it is missing or repeats a number of at least 2^62 from id and text."""
    twice = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select(F.col("doc_id").alias("id")))
    n = twice.count()
    rows = docs.select(packed(docs), F.col("doc_id").alias("id"), "text")
    if n:
        rows = rows.join((F.broadcast(twice) if n <= BROADCAST_IDS else twice).withColumn("repeats", F.lit(True)), "id", "left")
    own = F.col("id").isNotNull() & (~F.coalesce("repeats", F.lit(False)) if n else F.lit(True))
    made = F.shiftrightunsigned(F.xxhash64("id", "text"), 2) + F.lit(1 << 62)
    return rows.select("row", F.when(own, F.col("id")).otherwise(made).alias("doc_id"), "text")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows; a document of a second epoch comes twice.

    Null languages and sources are leaves of their own, which the weights leave empty;
    documents without tokens come or go with their place in the order. An empty table stays empty.
    """
    info = free_name(docs.columns, "mix_")
    return mixing.mix(docs, domain_of(F.col("source")), DOMAINS, LANGS, share=0.75, epochs=2, seed=3, info_col=info).drop(info)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row; null and empty texts have no tokens."""
    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", by_language), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mixture", mixed), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. What a stage wrote goes when its successor is written, what it shuffled when it ends."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            discard(spark, last)
        release(spark)
        docs, last = spark.read.parquet(path), path
    return docs
