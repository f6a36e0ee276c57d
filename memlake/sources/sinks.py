"""Sinks: reports, BEIR layout, logs, markdown memories."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import scalars as S

# What a memory may hold, in code points and tags.
MAX_TOPIC, MAX_CONTENT, MAX_DESCRIPTION, MAX_TAGS, MAX_TAG = 120, 64_000, 300, 10, 32


def qrels(questions: DataFrame) -> DataFrame:
    """(query-id, corpus-id, score): one row a gold document, score 1."""
    return questions.select(F.col("id").alias("query_id"), F.explode("gold").alias("corpus_id")).withColumn("score", F.lit(1))


def write_beir(questions: DataFrame, corpus: DataFrame, root: str) -> None:
    corpus.write.mode("overwrite").parquet(f"{root}/corpus")
    questions.select("id", "text").write.mode("overwrite").parquet(f"{root}/queries")
    qrels(questions).write.mode("overwrite").parquet(f"{root}/qrels")


def write_report(report: DataFrame, root: str, stamp: str) -> str:
    """A small report as one JSON file of its own name."""
    path = f"{root}/report-{stamp}"
    report.coalesce(1).write.json(path)
    return path


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def memory_markdown(topic: str, content: str, description: str, tags: list[str]) -> str:
    for what, text, most in (("topic", topic, MAX_TOPIC), ("content", content, MAX_CONTENT), ("description", description, MAX_DESCRIPTION)):
        if len(text) > most or what != "description" and not text.strip():
            raise ValueError(f"{what} is empty or too long")
    if len(tags) > MAX_TAGS or any(len(t) > MAX_TAG for t in tags):
        raise ValueError("too many tags, or one too long")
    head = "\n".join(["---", f"topic: {topic.strip()}", f"description: {description.strip()}", f"tags: [{', '.join(tags)}]", "---"])
    return f"{head}\n\n{content.strip()}\n"


def write_memory(spark, root: str, *, topic: str, content: str, description: str = "", tags: list[str] | None = None) -> tuple[str, DataFrame]:
    """Write a memory's file by an atomic replacement; returns its path and its one row for ingestion."""
    text = memory_markdown(topic, content, description, tags or [])
    row = spark.createDataFrame([(topic, text)], "topic string, document string").withColumn("slug", S.slug(F.col("topic")))
    name = row.first()["slug"]
    os.makedirs(root, exist_ok=True)
    path = os.path.join(root, f"{name}.md")
    with tempfile.NamedTemporaryFile("w", dir=root, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)
    return path, row.select(S.uuid5(F.col("slug")).alias("id"), F.lit(path).alias("file_path"), F.lit(0).alias("chunk_idx"), S.sha256(F.col("document")).alias("content_hash"), "document", F.lit("memory").alias("type"))


def remember(spark, root: str, points: str, *, topic: str, content: str, description: str = "", tags: list[str] | None = None, now=None) -> tuple[str, int]:
    """write_memory, and its point in a collection: an earlier text of the topic is replaced. Returns the path and the collection's version.

    The file is written first and stays if the collection cannot be written.
    """
    from memlake.operators import indexing, ingest

    path, row = write_memory(spark, root, topic=topic, content=content, description=description, tags=tags)
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    none = F.lit(None)
    point = row.select(
        "id", "file_path", "chunk_idx", F.col("document").alias("text"), "content_hash", F.col("content_hash").alias("chunk_hash"), F.col("type").alias("chunker"), none.cast("string").alias("room"), S.path_prefixes(F.col("file_path")).alias("path_prefixes"),
        F.col("file_path").alias("source"), none.cast("string").alias("session"), none.cast("string").alias("message"), at.alias("valid_from"), none.cast("timestamp").alias("valid_to"), at.alias("updated_at"), none.cast("array<double>").alias("vec"),
    )
    ingest.ensure(spark, points, indexing.POINT)
    return path, ingest.commit(spark, points, point, by="file_path")
