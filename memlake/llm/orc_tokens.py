"""Token ids as ORC files: stripes, integer run-length encoding, row indexes, Bloom filters."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut, discard, scratch_path

#: A space before a letter, digit or printable ASCII character always starts a new pre-token,
#: so texts may be cut there and the units between encoded one by one.
UNIT = re.compile(r" (?=[!-~\w])")
OTHER = re.compile(r" (?![!-~\w])")
#: Latin letters at the start of a unit are a pre-token of their own, unless more letters follow; the rest starts a new one.
WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([^\w].*)?\Z", re.S)
#: Units whose ids a worker remembers.
CACHE_UNITS = 1_200_000
_encoders: dict[tuple[str, bool], Encoder] = {}


def splits_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE, whose pre-tokens the unit patterns above know."""
    pre, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not settings.get("normalizer") and not settings.get("truncation") and not settings.get("padding")
    return plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, by the tokenizers library.

    Frequent units are encoded once a worker. New ones go to the library: Latin words
    straight to its model, in the byte-level alphabet, all else through its whole pipeline.
    Texts that hold an added token (which the library looks for before it splits), and all
    texts where the file is no plain byte-level BPE, go through the library whole.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.plain = splits_at_spaces(settings)
        self.added = [t["content"] for t in settings.get("added_tokens") or [] if not (special_as_text and t.get("special"))]
        self.first: dict[str, bytes] = {}  # units that start a text or follow a word
        self.later: dict[str, bytes] = {}  # units after a space, without it
        # the byte-level alphabet: printable bytes stand for themselves, the others follow each other from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [x for x in range(256) if x not in shown]
        self.alphabet = {x: 256 + i for i, x in enumerate(hidden)}

    def _whole(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        found = self.later.get(word)
        if found is None:
            shown = "\u0120" + word if word.isascii() else (" " + word).encode().decode("latin-1").translate(self.alphabet)
            found = array("I", [t.id for t in self.tok.model.tokenize(shown)]).tobytes()
            if len(self.later) < CACHE_UNITS:
                self.later[word] = found
        return found

    def _start(self, unit: str) -> bytes:
        found = self.first.get(unit)
        if found is None:
            found = self._whole([unit])[0]
            if len(self.first) < CACHE_UNITS // 4:
                self.first[unit] = found
        return found

    def _later(self, unit: str) -> bytes:
        if m := WORD.match(unit):
            word, rest = m.groups()
            found = self._word(word) + (self._start(rest) if rest else b"")
        else:
            found = self._whole([" " + unit])[0]
        if len(self.later) < CACHE_UNITS and len(unit) < 40:
            self.later[unit] = found
        return found

    def __call__(self, text: str) -> bytes:
        if not self.plain or any(a in text for a in self.added):
            return self._whole([text])[0]
        units = UNIT.split(text) if OTHER.search(text) else text.split(" ")
        out = list(map(self.later.get, units))
        out[0] = self._start(units[0]) if len(units[0]) < 40 else self._whole([units[0]])[0]
        if None in out:
            out = [x if x is not None else self._later(u) for x, u in zip(out, units, strict=True)]
        return b"".join(out)


def _encoder(path: str, special_as_text: bool) -> Encoder:
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = Encoder(path, special_as_text)
    return _encoders[path, special_as_text]


def _encode_batches(path: str, end_id: int, special_as_text: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start = _encoder(path, special_as_text), 0
        for b in batches:
            ids = [encode(t or "") + end for t in b.column("text").to_pylist()]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            flat = np.frombuffer(b"".join(ids), "<i4")
            stop = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(start + stop[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(flat, pa.int32()))],
                ["doc_id", "offset", "n_tokens", "ids"],
            )
            start += int(stop[-1])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = b.column("ids")
        at, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("doc_id"), b.column("offset"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["file", "doc_id", "offset", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", stripe_mb: int = 64, stride: int = 10_000, special_as_text: bool = False) -> str:
    """Encode every whole text and write (doc_id, offset, n_tokens, ids) as ORC under path.

    Rows are dealt by ranges of the id and sorted within each, so the files follow each
    other in ascending id order; `offset` counts the ids before a document in its file.
    Integer columns use ORC's run-length encoding (version 2), a row index entry covers
    `stride` rows, and a Bloom filter per entry lets a reader look ids up without
    decoding stripes. A range that one id fills (repeated ids) stays one file.

    Strings of special tokens in a text become their ids, which is the library's default;
    with special_as_text they are encoded like any other text.

    Null text counts as empty; a null id sorts first; rows that repeat an id are all
    written, those of equal id in no set order. An empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (rows.mapInArrow(_encode_batches(tokenizer, end_id, special_as_text), "doc_id long, offset long, n_tokens long, ids array<int>")
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.stripe.size", str(stripe_mb << 20))
     .option("orc.row.index.stride", str(stride)).option("orc.create.index", "true").option("compression", "zstd").orc(path))
    return path


def read_tokens(spark, path: str, ids: list[int] | None = None) -> DataFrame:
    """The written rows; with ids, only those documents (pushed to the Bloom filters and row indexes)."""
    df = spark.read.orc(path)
    return df if ids is None else df.where(F.col("doc_id").isin(ids))


def token_index(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of written files; start counts all ids before the document.

    The base of each file is a running sum over one row per file, so what meets in one
    task is bounded by the number of files, not of documents.
    """
    rows = spark.read.orc(path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "offset", "n_tokens", "ids")
    per_file = spark.read.orc(path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "n_tokens").groupBy("file").agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("n"))
    base = per_file.withColumn("base", F.sum("n").over(Window.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1))).select("file", F.coalesce("base", F.lit(0)).alias("base"))
    found = rows.mapInArrow(_digest, "file string, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return found.join(base, "file").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_orc(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the tokens of all documents and return what token_index reads back.

    Without a path the files are scratch: they go when they are read, and their index stays.
    """
    spark = docs.sparkSession
    if path:
        return token_index(spark, write_tokens(docs, path, tokenizer, end_id))
    path = write_tokens(docs, scratch_path(spark, "orc"), tokenizer, end_id)
    found = cut(token_index(spark, path))
    discard(spark, path)
    return found
