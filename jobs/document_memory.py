"""Keep a memory of chunks up to date with a growing folder of documents.

    spark-submit --py-files ... jobs/document_memory.py --documents IN --output OUT --checkpoint STATE [--config jobs/document_memory.json]

Documents (doc_id, text, lang, source) arrive as Parquet files; a later file may bring a
new version of a document. A file stream takes the files that its checkpoint does not
know, in batches, and ends when there are none left. Of each batch only documents whose
content changed are cut into chunks.

OUT/chunks/batch=N/lang=L/   chunks of the versions that batch N brought
OUT/versions/batch=N/        (doc_id, content_hash): the versions themselves, written last

A version is current until a later batch has one of the same document: current_chunks
reads them, and older ones stay for readers of the past. A batch that is run again after a
failure replaces its own folders and looks only at batches before it, so it writes the
same rows again. Half a batch is never read, as its versions are not there.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from memlake.functions import scalars as S
from memlake.operators import chunkers, ingest
from memlake.shared import cut
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import read_settings

log = logging.getLogger("jobs.document_memory")
DOCUMENT = "doc_id long, text string, lang string, source string"
VERSION = "doc_id long, content_hash string, batch long"
CHUNK = "doc_id long, chunk_idx int, document string, chunk_hash string, content_hash string, tokens long, source string, batch long, lang string"


@dataclass(frozen=True)
class Settings:
    words: int = 128
    overlap: int = 16
    min_tokens: int = 20
    files_per_batch: int = 1000


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that earlier batches wrote; empty where none did."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def versions(spark: SparkSession, output: str, before: int | None = None) -> DataFrame:
    """(doc_id, content_hash, batch): the newest version of each document, of batches before the given one."""
    rows = stored(spark, f"{output}/versions", VERSION)
    return ingest.latest(rows if before is None else rows.where(F.col("batch") < before), ["doc_id"], ["batch"])


def current_chunks(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of every document's newest version."""
    newest = versions(spark, output).select("doc_id", "batch")
    return stored(spark, f"{output}/chunks", CHUNK).join(newest, ["doc_id", "batch"], "left_semi")


def write_batch(rows: DataFrame, batch: int, output: str, settings: Settings) -> None:
    """Chunk the documents of a batch that differ from their stored version, and write them as this batch's folders.

    Of rows that repeat an id the one of the youngest file counts; rows without an id are
    left out. A text without words is a version without chunks. Chunks without a language,
    or with an empty one, read back with a null.
    """
    spark = rows.sparkSession
    hashed = rows.where("doc_id is not null").withColumn("content_hash", S.sha256(F.coalesce("text", F.lit(""))))
    given = ingest.latest(hashed, ["doc_id"], ["arrived", "file", "content_hash"]).drop("arrived", "file")
    changed = cut(ingest.needs_index(given, versions(spark, output, batch), ["doc_id"], ["content_hash"]))
    pieces = chunkers.window_chunks(changed, settings.words, settings.overlap)
    pieces = pieces.withColumns({"chunk_hash": S.sha256(F.col("document")), "tokens": S.token_estimate(F.col("document"))}).where(F.col("tokens") >= settings.min_tokens)
    kept = ingest.distinct_chunks(pieces, ["doc_id", "chunk_hash"])
    kept = kept.select("doc_id", "chunk_idx", "document", "chunk_hash", "content_hash", "tokens", "source", "lang")
    # equal languages lie together, and a frequent one in as many files as its size asks for
    kept.hint("rebalance", F.col("lang")).write.mode("overwrite").partitionBy("lang").parquet(f"{output}/chunks/batch={batch}")
    changed.select("doc_id", "content_hash").write.mode("overwrite").parquet(f"{output}/versions/batch={batch}")
    written = stored(spark, f"{output}/chunks", CHUNK).where(F.col("batch") == batch).count()
    log.info("batch %d: %d rows read, %d documents new or changed, %d chunks written", batch, rows.count(), changed.count(), written)


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: Settings | None = None) -> int:
    """Take all files of the folder or pattern `documents` that the checkpoint does not know; the number of batches that were run."""
    s = settings or Settings()
    output, batches = output.rstrip("/"), []

    def sink(rows: DataFrame, batch: int) -> None:
        write_batch(rows, batch, output, s)
        batches.append(batch)

    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", s.files_per_batch).parquet(documents)
    stream = stream.select("doc_id", "text", "lang", "source", F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("file"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("%d batches from %s into %s", len(batches), documents, output)
    return len(batches)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("document_memory").getOrCreate()
    try:
        run(spark, given.documents, given.output, given.checkpoint, read_settings(spark, given.config, Settings))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
