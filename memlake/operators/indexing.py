"""The ingestion job: files and transcripts into a versioned collection, in a fixed order, with the manifest written last."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import scalars as S
from memlake.functions.predicates import live
from memlake.operators import chunkers, ingest, turns
from memlake.registry import lookup
from memlake.shared import cut, shared_dir, small, spread
from memlake.sources import readers

POINT = "id string, file_path string, chunk_idx int, text string, content_hash string, chunk_hash string, chunker string, room string, path_prefixes array<string>, source string, session string, message string, valid_from timestamp, valid_to timestamp, updated_at timestamp, vec array<double>"
#: A manifest row is a file of a target, a message of a session, or a setting.
ENTRY = "kind string, path string, target string, sha string, epoch string"
ROOMS = "__rooms_hash__"


@dataclass(frozen=True)
class Report:
    """What a run did. fallback counts points whose time is the run's, as neither message nor file had one."""

    files: int
    failed: int
    changed: int
    written: int
    pruned: int
    reclassified: int
    fallback: int


def transcript_pairs(lines: DataFrame) -> DataFrame:
    """(path, session, message, ts, turn_index, user_json, assistant_json) of parsed lines (path, pos, type, event).

    A pair without a session or message id is an error of the transcript, and raises.
    """
    text = lambda at: F.try_variant_get("event", at, "string")
    e = lines.where(~F.col("type").isin(*turns.SKIPPED)).withColumn("side", F.coalesce(F.try_variant_get("event", "$.isSidechain", "boolean"), F.lit(False))).where("not side")
    content = F.coalesce(F.to_json(F.try_variant_get("event", "$.message.content", "variant")), F.lit('""'))
    e = e.select("path", "pos", "type", text("$.sessionId").alias("session"), text("$.uuid").alias("message"), text("$.timestamp").alias("ts"), content.alias("json"))
    upto = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    user = F.col("type") == "user"
    pair = e.withColumn("pair", F.sum(user.cast("int")).over(upto)).where("pair > 0")
    first = lambda c: F.max(F.when(user, F.col(c))).alias(c)
    answers = F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "assistant", F.struct("pos", "json")))), lambda x: x["json"])
    out = pair.groupBy("path", "pair").agg(first("session"), first("message"), first("ts"), F.max(F.when(user, F.col("json"))).alias("user_json"), answers.alias("assistant_json"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    known = F.when(blank("session") | blank("message"), F.raise_error(F.concat(F.lit("a pair without session or message id in "), F.col("path"))).cast("string"))
    return out.select("path", F.coalesce(known, F.col("session")).alias("session"), "message", "ts", (F.col("pair") - 1).cast("int").alias("turn_index"), "user_json", "assistant_json")


def embedded(points: DataFrame, embedder: str | None) -> DataFrame:
    """Points with the vectors that a registered embedder gives their texts; without one, with null vectors."""
    if embedder is None:
        return points.withColumn("vec", F.lit(None).cast("array<double>"))
    model = lookup("embedder", embedder)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model(list(texts)))

    return points.withColumn("vec", run("text"))


def file_points(files: DataFrame, rooms: Mapping[str, Sequence[str]], now: Column, dedup: bool, min_tokens: int) -> DataFrame:
    """Points of markdown files (path, mtime, text, sha), without vectors."""
    chunks = chunkers.chunk_documents(files, min_tokens=min_tokens, keep=("mtime", "sha")).withColumn("chunk_hash", S.sha256(F.col("document")))
    if dedup:
        chunks = ingest.distinct_chunks(chunks.withColumnRenamed("path", "file_path")).withColumnRenamed("file_path", "path")
    return _points(chunks, F.col("sha"), S.point_id(F.col("path"), F.col("chunk_idx"), F.col("sha")), F.lit("markdown"), F.lit(None).cast("string"), rooms, now)


def message_points(pieces: DataFrame, rooms: Mapping[str, Sequence[str]], now: Column) -> DataFrame:
    """Points of transcript pieces (path, mtime, session, message, ts, turn_index, piece, document), without vectors."""
    rows = pieces.withColumn("chunk_hash", S.sha256(F.col("document"))).withColumn("chunk_idx", F.col("turn_index") * 1000 + F.col("piece"))
    return _points(rows, F.col("chunk_hash"), S.message_point_id(F.col("session"), F.col("message"), F.col("chunk_idx")), F.lit("transcript"), F.col("ts"), rooms, now)


def _points(rows: DataFrame, content: Column, ident: Column, chunker: Column, ts: Column, rooms: Mapping[str, Sequence[str]], now: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    own = {c: F.col(c) if c in rows.columns else none for c in ("session", "message")}
    return rows.select(
        ident.alias("id"), F.col("path").alias("file_path"), F.col("chunk_idx").cast("int").alias("chunk_idx"), F.col("document").alias("text"), content.alias("content_hash"), "chunk_hash", chunker.alias("chunker"),
        S.room(F.col("path"), rooms).alias("room"), S.path_prefixes(F.col("path")).alias("path_prefixes"), F.col("path").alias("source"), own["session"].alias("session"), own["message"].alias("message"),
        ingest.valid_from(ts, F.col("mtime"), now).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), now.alias("updated_at"),
        (S.parse_time(F.nullif(F.trim(ts), F.lit(""))).isNull() & F.col("mtime").isNull()).alias("fallback_"),
    )


def index(spark: SparkSession, sources: str | Sequence[str], root: str, *, exclude: Sequence[str] = (), modified: str = "0", now: datetime | None = None, **how) -> Report:
    """index_files over the files of the sources; what a listing without age limit and excludes lacks is gone."""
    moment = now or datetime.now()
    files = cut(readers.read_files(spark, sources, exclude, modified, moment))
    failed = readers.unread(spark, files, sources, exclude=exclude, modified=modified, now=moment).count()
    return index_files(spark, files, root, there=readers.listing(spark, sources), roots=readers.roots_of(sources), failed=failed, now=moment, **how)


def index_files(spark: SparkSession, files: DataFrame, root: str, *, there: DataFrame, roots: Sequence[str], failed: int = 0, target: str = "prod", force: bool = False, rooms: Mapping[str, Sequence[str]] | None = None, embedder: str | None = None,
                dedup: bool = False, min_tokens: int = chunkers.MIN_TOKENS, retention_days: float = 0.0, now: datetime | None = None) -> Report:
    """Bring a collection at root/points up to date with files (path, mtime, text, sha); root/manifest remembers what was done.

    The order is fixed: the collection is ensured; prefixes are filled in and rooms
    recomputed if their settings changed; old versions of changed files end and new chunks
    enter in one write; ended ones past their retention go; the manifest is written last.
    So a run that fails midway leaves a readable collection, and the next run does the same
    work again to the same ids.

    A file is dirty if the manifest does not know it for the target, or if its content, the
    collection or the embedder changed; a message likewise by its own hash. Files that are
    gone leave the manifest, not the collection: those below the run's roots that are not
    in `there` (path). What other runs brought from elsewhere stays known.

    files is read several times, for its keys and once for the texts that are dirty; where
    a second reading may differ, cut it first.
    """
    rooms, moment = rooms or {}, now or datetime.now()
    at = F.lit(moment).cast("timestamp")
    points, state = f"{root.rstrip('/')}/points", f"{root.rstrip('/')}/manifest"
    epoch = f"{points}|{embedder}"
    ingest.ensure(spark, points, POINT)
    ingest.ensure(spark, state, ENTRY + ", id string")
    manifest = cut(ingest.read_latest(spark, state))

    # settings of rooms decide whether all points are classified anew; missing prefixes are filled in by the same write
    reclassified = 0
    rooms_hash = S.settings_hash(dict(rooms))
    known = manifest.where(F.col("kind") == "setting").where(F.col("path") == ROOMS).select("sha").collect()
    if not known or known[0]["sha"] != rooms_hash:
        swept = cut(ingest.reclassify(ingest.backfill_prefixes(ingest.read_latest(spark, points)), rooms))
        reclassified = swept.where("room_changed").count()
        if reclassified:
            ingest.commit(spark, points, swept.drop("room_changed"), by="file_path", replace=True)

    text = files.where(~F.col("path").endswith(".jsonl")).withColumn("target", F.lit(target)).withColumn("epoch", F.lit(epoch))
    seen = manifest.where("kind = 'file'")
    # what is dirty is told by the keys; texts are shuffled only where many, but not all, are
    keys = text.select("path", "target", "sha", "epoch")
    dirty = cut(keys if force else ingest.needs_index(keys, seen))
    todo = text
    if dirty.count() < keys.count():
        picked = small(dirty.select(F.col("path").alias("path_"), F.col("sha").alias("sha_")).distinct())
        todo = text.join(picked, F.col("path").eqNullSafe(F.col("path_")) & F.col("sha").eqNullSafe(F.col("sha_")), "left_semi")
    kept = file_points(spread(todo, "path"), rooms, at, dedup, min_tokens)

    lines = readers.transcript_lines(files.where(F.col("path").endswith(".jsonl")))
    pieces = chunkers.chunk_transcripts(transcript_pairs(lines)).join(files.select("path", "mtime"), "path")
    said = cut(pieces.withColumn("sha", S.sha256(F.col("document"))).withColumn("epoch", F.lit(epoch)).withColumn("target", F.concat_ws("#", "message", F.col("turn_index").cast("string"), F.col("piece").cast("string"))))
    heard = manifest.where("kind = 'message'").select(F.col("path").alias("session"), "target", "sha", "epoch")
    fresh = cut(said if force else ingest.needs_index(said, heard, ("session", "target")))

    # as compressed files, of which the counts and the commit's keys read only their columns
    path = f"{shared_dir(spark).rstrip('/')}/points-{uuid.uuid4().hex}"
    embedded(kept.unionByName(message_points(fresh, rooms, at)), embedder).write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(f"{POINT}, fallback_ boolean").parquet(path)
    fallback = made.where("fallback_").count()
    new = made.drop("fallback_")
    # live versions of any dirty file end, whether or not the manifest still knows it; transcripts only ever grow
    changed = dirty.select(F.col("path").alias("file_path"))
    written = new.count()
    if written or not dirty.isEmpty():
        ingest.commit(spark, points, new, by="file_path", change=lambda old: ingest.close_old(old, ingest.meeting(old.where(live(F.col("valid_to"), at)), changed, "file_path"), at), touched=changed)
    if retention_days:
        whole = ingest.read_latest(spark, points)
        left = cut(ingest.gc_sweep(whole, at, retention_days))
        if left.count() < whole.count():
            ingest.commit(spark, points, left, by="file_path", replace=True)

    entries = dirty.select(F.lit("file").alias("kind"), "path", "target", "sha", "epoch").unionByName(fresh.select(F.lit("message").alias("kind"), F.col("session").alias("path"), "target", "sha", "epoch"))
    entries = entries.unionByName(spark.createDataFrame([("setting", ROOMS, "", rooms_hash, None)], ENTRY))
    old = cut(ingest.prune_manifest(seen, there, roots))
    pruned = seen.count() - old.count()
    key = F.to_json(F.struct("kind", "path", "target"))
    rest = old.unionByName(manifest.where("kind <> 'file'")).select(*(c.split(" ")[0] for c in ENTRY.split(", "))).withColumn("id", key)
    ingest.commit(spark, state, ingest.upsert(rest, entries.withColumn("id", key)), replace=True)
    return Report(files.count(), failed, dirty.count() + fresh.select("session", "message").distinct().count(), written, pruned, reclassified, fallback)
