"""Byte-level BPE: overlapping chunks, resynchronised pre-tokens, and decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut

#: Code points of a chunk, and by how many it reaches into the next one. Texts that fit into one are a piece of their own.
CHUNK, OVERLAP = 32_768, 1_024


@functools.lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Where pre-tokens end in a text."""
    return [m.end() for m in regex.finditer(pattern, text)]


def _chunks(chunk: int, overlap: int):
    """Texts as overlapping chunks, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                starts = range(0, len(t), chunk)
                for i in range(0, len(starts), 64):
                    part = starts[i : i + 64]
                    cols = [pa.array([key] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array([len(t)] * len(part), pa.int64()), pa.array([t[s : s + chunk + overlap] for s in part], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "start", "n", "text"])

    return run


def _ends(pattern: str, chunk: int, overlap: int):
    """Of each chunk, pre-tokenised on its own: the ends in what it shares with the chunk before (heads) and with the one after (tails).

    Ends that the chunk's own end may have caused are not trusted: its last pre-token, and
    the one before that. White space is split by what follows it, so no head lies behind any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for start, n, t in zip(*(b.column(c).to_pylist() for c in ("start", "n", "text")), strict=True):
                ends = boundaries(t, pattern)
                heads.append([start + e for e in ends if e < overlap and start + e < n and not t[e - 1].isspace()] if start else [])
                trusted = ends if start + len(t) == n else ends[:-2]
                tails.append([start + e for e in trusted if chunk < e < chunk + overlap and start + e < n])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("start"), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["key", "start", "heads", "tails"])

    return run


def cut_places(texts: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, cuts): where each of texts (key, text) may be cut so that its pieces split as the whole does.

    Chunks are dealt out over all tasks and pre-tokenised there; only the ends in their
    overlaps meet again. Where two neighbours both end a pre-token at one place they are
    resynchronised: the pattern looks nowhere back, so both go on alike from there, and
    what the right one ends later is true as well. The first pair without a common place
    (a pre-token longer than the overlap) ends the chain, and the rest of the text is one piece.
    """
    if overlap >= chunk:
        raise ValueError("chunks must be longer than what they share")
    dealt = texts.select("key", "text").mapInArrow(_chunks(chunk, overlap), "key long, start long, n long, text string").repartition("key", "start")
    ends = dealt.mapInArrow(_ends(pattern, chunk, overlap), "key long, start long, heads array<long>, tails array<long>")
    order = Window.partitionBy("key").orderBy("start")
    common = F.try_element_at(F.array_intersect("heads", F.lag("tails").over(order)), F.lit(1))
    seams = ends.select("key", "start", common.alias("at")).where("start > 0")
    broken = F.sum(F.col("at").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return seams.withColumn("broken", broken).where("broken = 0").groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("cuts"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cut at their places, a row each piece."""
    for b in batches:
        for i, (key, t, cuts) in enumerate(zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True)):
            at = [0, *(cuts or [])]
            texts = [t[a:z] for a, z in zip(at, [*at[1:], len(t)], strict=True)]
            for j in range(0, len(at), 64):
                part = at[j : j + 64]
                own = b.column("doc_id").take(pa.array([i] * len(part)))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.int64()), own, pa.array(part, pa.int64()), pa.array(texts[j : j + 64], pa.string())], ["key", "doc_id", "at", "text"])


def _encode_pieces(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.array(_encoding(path, pattern).encode_ordinary(t), "<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), b.column("at"), pa.array(ids, pa.binary())], ["key", "doc_id", "at", "ids"])

    return run


def _joined(path: str, pattern: str, keep: bool):
    """From rows in order of key and place: a row a text, its pieces' ids and raw bytes one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc, count, coded, decoded, kept = None, None, 0, None, None, []

        def row() -> pa.RecordBatch:
            cols, names = [doc, pa.array([count], pa.int64()), pa.array([coded.hexdigest()]), pa.array([decoded.hexdigest()])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                cols.append(pa.array([np.concatenate(kept).astype(np.int32)], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            for i, (key, ids) in enumerate(zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True)):
                if key != now:
                    if now is not None:
                        yield row()
                    now, doc, count, coded, decoded, kept = key, b.column("doc_id").slice(i, 1), 0, hashlib.sha256(), hashlib.sha256(), []
                flat = np.frombuffer(ids, "<u4")
                count += len(flat)
                coded.update(ids)
                decoded.update(decode(flat.tolist(), path, pattern))
                if keep:
                    kept.append(flat)
        if now is not None:
            yield row()

    return run


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """The raw bytes of each id, one after another."""
    return _encoding(path, pattern).decode_bytes(ids)


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def _digests(path: str, pattern: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, coded, decoded, kept = [], [], [], []
            for t in b.column("text").to_pylist():
                ids = _encoding(path, pattern).encode_ordinary(t or "")
                counts.append(len(ids))
                coded.append(_sha(np.array(ids, "<u4").tobytes()))
                decoded.append(_sha(decode(ids, path, pattern)))
                if keep:
                    kept.append(np.array(ids, np.int32))
            cols, names = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text by the ranks at path and decode the ids again.

    Returns (id_col, n_tokens, ids_sha256, decoded_sha256), with keep_ids also ids. A text
    that fits into one chunk is encoded where it is read. Longer ones, however long, are
    cut into overlapping chunks that all tasks pre-tokenise, stitched where neighbours
    agree, and encoded piece by piece, again by all tasks; ids and decoded bytes are then
    put together in order, a piece at a time.

    Null text counts as empty and has no ids. Ids keep their type; null and repeated ids
    are kept, one row each. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk + overlap
    short = rows.where(~long).mapInArrow(_digests(path, pattern, keep_ids), schema)
    # numbered once and kept, as ids may be missing or repeat
    texts = cut(rows.where(long).withColumn("key", F.monotonically_increasing_id()))
    placed = texts.join(cut_places(texts, pattern, chunk, overlap), "key", "left").select("key", "doc_id", "text", "cuts")
    pieces = placed.mapInArrow(_pieces, f"key long, doc_id {kind}, at long, text string").repartition("key", "at")
    coded = pieces.mapInArrow(_encode_pieces(path, pattern), f"key long, doc_id {kind}, at long, ids binary")
    whole = coded.repartition("key").sortWithinPartitions("key", "at").mapInArrow(_joined(path, pattern, keep_ids), schema)
    return short.unionByName(whole).withColumnRenamed("doc_id", id_col)
