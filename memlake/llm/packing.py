"""Packing by powers of two: every document falls into pieces of binary lengths, and equal lengths lie together."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.shared import small

from .common import arrow_batches, cut, discard, scratch_path
from .orc_tokens import _encoder

#: Files (name and first sequence) that may be broadcast to the pieces; more are joined by a shuffle.
BROADCAST_FILES = 200_000
PIECE = "doc_id long, start long, doc_tokens long, bucket int, ids binary"


def binary_lengths(n: int, most: int = 2048) -> list[int]:
    """The pieces of n tokens, the longest first: as many of `most` as fit, then one for each bit of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _cut_batches(path: str, end_id: int, most: int, special_as_text: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, special_as_text)
        width = 2 if max(encode.tok.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        for b in batches:
            ids = [np.frombuffer(encode(t or "") + end, "<u4").astype(f"<u{width}") for t in b.column("text").to_pylist()]
            tokens = np.array([len(x) for x in ids], np.int64)
            pieces = [binary_lengths(int(n), most) for n in tokens]
            row = np.repeat(np.arange(len(ids)), [len(p) for p in pieces])
            length = np.array([x for p in pieces for x in p], np.int64)
            stop = np.concatenate([[0], np.cumsum(length)])
            before = np.cumsum(tokens) - tokens  # of the batch's tokens, those before each document
            offsets, flat = pa.array(stop * width, pa.int64()), b"".join(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), pa.array(stop[:-1] - before[row]), pa.array(tokens[row]), pa.array(np.log2(length).astype(np.int32)),
                 pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, offsets.buffers()[1], pa.py_buffer(flat)]).cast(pa.binary())],
                ["doc_id", "start", "doc_tokens", "bucket", "ids"],
            )

    return run


def write_pieces(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, most: int = 2048, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> str:
    """Encode every whole text, cut it into pieces of 1, 2, 4, ... up to `most` tokens, and write them as Parquet under path, a folder a length.

    Rows (doc_id, start, doc_tokens, ids) of one length, 2^bucket, lie together, so that a
    trainer forms batches of equal lengths without padding. ids are little-endian unsigned
    integers of 16 bits where the vocabulary allows, else of 32; bytes over length tell which. The shuffle that brings a
    length together splits the long ones, which hold most tokens, into partitions of the
    advisory size; so the number of files follows the bytes, not tasks times lengths.

    Null text counts as empty, and every document ends with end_id, so each has a piece. A
    very long text is encoded whole in one task. Null and repeated ids are written like
    any other; columns but the two are ignored, whatever their names. An empty table
    writes nothing.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the greatest length must be a power of two")
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(_cut_batches(tokenizer, end_id, most, special_as_text), PIECE)
    pieces.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return path


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, doc_tokens, bucket, ids, sequence_id, offset) of written pieces; each piece is a sequence of its own.

    Sequences are numbered from 0 without gaps, short lengths first: by the place of a
    piece in its file and the pieces of all files before it. One row a file meets in one task.
    """
    rows = spark.read.schema(PIECE).parquet(path)
    name = F.col("_metadata.file_name").alias("file")
    per_file = rows.select("bucket", name).groupBy("bucket", "file").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket", "file").rowsBetween(Window.unboundedPreceding, -1)
    base = per_file.select("bucket", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = rows.select("doc_id", "start", "doc_tokens", "bucket", "ids", name, F.col("_metadata.row_index").alias("place"))
    joined = placed.join(small(base, BROADCAST_FILES), ["bucket", "file"])
    return joined.select("doc_id", "start", "doc_tokens", "bucket", "ids", (F.col("base") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def token_ids(piece: bytes, length: int) -> np.ndarray:
    """The ids of a written piece as unsigned 32-bit integers."""
    return np.frombuffer(piece, f"<u{len(piece) // length}").astype("<u4")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        length = 1 << b.column("bucket").to_numpy().astype(np.int64)
        crc = [zlib.crc32(token_ids(x, n)) for x, n in zip(b.column("ids").to_pylist(), length.tolist(), strict=True)]
        kept = [b.column(c) for c in ("doc_id", "start", "doc_tokens", "sequence_id", "offset")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "start", "doc_tokens", "sequence_id", "offset", "length", "ids_crc32"])


def piece_index(sequences: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of sequences, digests taken from their ids."""
    kinds = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, length long, ids_crc32 long"
    found = sequences.select("doc_id", "start", "doc_tokens", "sequence_id", "offset", "bucket", "ids").mapInArrow(_digest, kinds)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, path: str | None = None, **how) -> DataFrame:
    """Write the packed sequences of all documents and return the index of what is read back.

    Without a path the files are scratch: they go when they are read, and their index
    stays. See write_pieces for nulls, long texts, repeated ids, other columns and empty
    tables; rows that repeat an id and text give the same pieces each, under numbers of
    their own.
    """
    spark = docs.sparkSession
    if path:
        return piece_index(read_sequences(spark, write_pieces(docs, path, tokenizer, **how)))
    path = write_pieces(docs, scratch_path(spark, "packed"), tokenizer, **how)
    found = cut(piece_index(read_sequences(spark, path)))
    discard(spark, path)
    return found
