"""Incremental, bitemporal ingestion: dirty checks, versions, sweeps, and the versioned table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.functions import scalars as S
from memlake.functions.predicates import live
from memlake.shared import cut, small

#: Collections that no caller may write.
RESERVED = frozenset({"system", "internal"})
#: Parts that a collection's rows are dealt into by a hash; an upsert rewrites only those it falls into.
BUCKETS = 64


class CollectionMissingError(LookupError):
    """A collection that was asked for does not exist."""


def needs_index(files: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("path", "target"), same: Sequence[str] = ("sha", "epoch")) -> DataFrame:
    """Files that are unknown to the manifest for their target, changed, or of another epoch."""
    return files.join(manifest.select(*keys, *same).distinct(), [*keys, *same], "left_anti")


def prune_manifest(manifest: DataFrame, files: DataFrame, roots: Sequence[str] | None = None) -> DataFrame:
    """Manifest rows whose absolute path still exists; relative paths stay, and with roots all paths that are not below one.

    files (path) lists what exists: with roots, all files below these.
    """
    there = files.select("path").distinct()
    asked = F.col("path").startswith("/")
    if roots is not None:
        inside = F.lit(False)
        for r in roots:
            inside = inside | (F.col("path") == r) | F.col("path").startswith(r.rstrip("/") + "/")
        asked = asked & inside
    return manifest.where(~asked).unionByName(manifest.where(asked).join(there, "path", "left_semi").select(*manifest.columns))


def close_old(points: DataFrame, changed: DataFrame, now: Column, keys: Sequence[str] = ("file_path",)) -> DataFrame:
    """Live versions of changed keys end now; everything else stays as it is."""
    hit = changed.select(*keys).distinct().withColumn("changed_", F.lit(True))
    out = points.join(hit, list(keys), "left")
    ended = F.when(F.col("changed_") & live(F.col("valid_to"), now), now).otherwise(F.col("valid_to"))
    return out.withColumn("valid_to", ended).select(*points.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new, and rows of old whose key new does not have. Unchanged content has an unchanged id."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns), allowMissingColumns=True)


def meeting(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The keys that both have, each once: told from the keys alone, so that few of them are broadcast and old rows need no shuffle."""
    return small(cut(old.select(key).join(new.select(key), key, "left_semi").distinct()))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last version of each key, by one aggregation without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def gc_sweep(points: DataFrame, now: Column, retention_days: float) -> DataFrame:
    """Points but for those that ended more than retention_days ago; 0 keeps all."""
    if not retention_days:
        return points
    return points.where(F.col("valid_to").isNull() | (S.age_days(F.col("valid_to"), now) <= retention_days))


def reclassify(points: DataFrame, rooms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Points with their room recomputed, and whether it changed; those without a path are skipped."""
    new = F.when(F.col("file_path").isNull(), F.col("room")).otherwise(S.room(F.col("file_path"), rooms))
    return points.withColumn("new_room", new).withColumn("room_changed", ~F.col("new_room").eqNullSafe(F.col("room"))).withColumn("room", F.col("new_room")).drop("new_room")


def backfill_prefixes(points: DataFrame) -> DataFrame:
    """Path prefixes where there are none yet."""
    return points.withColumn("path_prefixes", F.coalesce("path_prefixes", S.path_prefixes(F.col("file_path"))))


def valid_from(ts: Column, mtime: Column, now: Column) -> Column:
    """A message's time if it can be read, else the file's, else now."""
    return F.coalesce(S.parse_time(F.nullif(F.trim(ts), F.lit(""))), mtime, now)


def distinct_chunks(chunks: DataFrame, by: Sequence[str] = ("file_path", "chunk_hash")) -> DataFrame:
    """The first chunk of each content; by chunk hash, so that one file keeps all its different chunks."""
    return chunks.withColumn("rn_", F.row_number().over(Window.partitionBy(*by).orderBy("chunk_idx"))).where("rn_ = 1").drop("rn_")


def update_payload(points: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Points with the columns that changes (key, ...) gives for their key, all else as it is; a null there sets null."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(key, F.struct(*cols).alias("new_"))
    out = points.join(new, key, "left")
    return out.select(*(F.when(F.col("new_").isNotNull(), F.col(f"new_.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in points.columns))


def delete_ids(points: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return points.join(ids.select(key).distinct(), key, "left_anti").select(*points.columns)


def scroll(points: DataFrame, size: int = 512, key: str = "id", after: object = None) -> Iterator[tuple[list[Row], object]]:
    """Pages of rows in key order, each with the offset to go on from; the last one's is None. An empty table has no page.

    A cursor for one reader: rows are sorted once, on the executors, and come a partition at a time.
    """
    rest = points if after is None else points.where(F.col(key) > F.lit(after))
    rows = rest.repartitionByRange(key).sortWithinPartitions(key).toLocalIterator()
    page = list(islice(rows, size))
    while page:
        following = list(islice(rows, size))
        yield page, page[-1][key] if following else None
        page = following


def paged(points: DataFrame, size: int = 512, key: str = "id") -> DataFrame:
    """points with their page, from 0, in key order: all pages at once, for many readers.

    A row's place is its place in its partition of the sorted table, after the rows of all
    partitions before; one row a partition meets in one task.
    """
    place = F.monotonically_increasing_id()  # the partition's number, then 33 bits of the row's
    rows = cut(points.repartitionByRange(key).sortWithinPartitions(key)).withColumn("place_", place)
    rows = rows.withColumn("part_", F.shiftright("place_", 33))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    row = F.col("base_") + F.col("place_").bitwiseAND((1 << 33) - 1)
    return rows.join(small(sizes), "part_").select(*points.columns, F.floor(row / size).alias("page"))


class ConcurrentWriteError(RuntimeError):
    """Another writer finished this version first; nothing of this write is visible."""


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions of a collection, in order."""
    place, fs = _fs(spark, f"{root}/_commits")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(place) if s.getPath().getName().isdigit()) if fs.exists(place) else []


def _state(spark: SparkSession, root: str, version: int | None = None) -> dict:
    found = versions(spark, root)
    if not found or version is not None and version not in found:
        raise CollectionMissingError(root)
    place, fs = _fs(spark, f"{root}/_commits/{found[-1] if version is None else version:09d}")
    stream = fs.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _publish(spark: SparkSession, root: str, version: int, state: dict) -> None:
    """Make a version visible by one file that may not exist yet; the second of two writers loses."""
    place, fs = _fs(spark, f"{root}/_commits/{version:09d}")
    # written beside its place first and renamed, so that no reader sees half a file
    half, _ = _fs(spark, f"{root}/_commits/.{uuid.uuid4().hex}")
    out = fs.create(half, False)
    out.write(json.dumps(state).encode())
    out.close()
    if fs.exists(place) or not fs.rename(half, place):
        fs.delete(half, False)
        raise ConcurrentWriteError(f"{root} has a version {version} already")


def read_latest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest finished version (or a given one); what an unfinished write left behind is never read."""
    state = _state(spark, root, version)
    schema = StructType.fromJson(state["schema"])
    paths = [f"{root}/{p}" for p in state["parts"].values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def exists(spark: SparkSession, root: str) -> bool:
    return bool(versions(spark, root))


def ensure(spark: SparkSession, root: str, schema: str | StructType) -> None:
    """Make an empty collection where there is none."""
    _writable(root)
    if not exists(spark, root):
        _publish(spark, root, 1, {"schema": json.loads(spark.createDataFrame([], schema).schema.json()), "parts": {}, "buckets": BUCKETS})


def _writable(root: str) -> None:
    if root.rstrip("/").rsplit("/", 1)[-1] in RESERVED:
        raise PermissionError(root)


def _crowded(spark: SparkSession, folders: Sequence[str]) -> bool:
    """Whether the folders hold more than four files each, of under 32 MB, in the mean."""
    sums = [fs.getContentSummary(place) for place, fs in (_fs(spark, f) for f in folders)]
    files = sum(s.getFileCount() for s in sums)
    return files > 4 * len(folders) and sum(s.getLength() for s in sums) < files << 25


def commit(spark: SparkSession, root: str, new: DataFrame, key: str = "id", by: str | None = None, change: Callable[[DataFrame], DataFrame] | None = None, touched: DataFrame | None = None, replace: bool = False) -> int:
    """Upsert into a collection as one new version: a failure leaves the old one whole.

    Rows lie in buckets of the column `by` (the key, unless given; equal keys must have
    equal ones), and only buckets that new or touched rows fall into are written again.
    `change` is applied to those buckets' old rows first. With replace nothing old stays.
    """
    _writable(root)
    found = versions(spark, root)
    state = _state(spark, root, found[-1]) if found else {"parts": {}, "buckets": BUCKETS, "schema": None}
    count, version, by = state["buckets"], (found[-1] if found else 0) + 1, by or key
    bucket = F.pmod(F.xxhash64(by), F.lit(count)).cast("int")
    # a bucket is written by as many tasks as its size asks for, not by every task
    dealt = lambda df: df.withColumn("bucket_", bucket).hint("rebalance", F.col("bucket_"))
    rows, out, keep = new, dealt(new), {}
    if found and not replace:
        hit = new.select(bucket.alias("b"))
        hit = hit if touched is None else hit.unionByName(touched.select(bucket.alias("b")))
        hit = {str(r["b"]) for r in hit.distinct().collect()}
        keep = {b: p for b, p in state["parts"].items() if b not in hit}
        again = [f"{root}/{p}" for b, p in state["parts"].items() if b in hit]
        if again:
            old = spark.read.schema(StructType.fromJson(state["schema"])).parquet(*again)
            old = change(old) if change else old
            rest = old.join(meeting(old, new, key), key, "left_anti").select(*old.columns)
            rows = new.unionByName(rest, allowMissingColumns=True)
            # old rows are read by their buckets and need no shuffle, unless many small files are to become few
            out = dealt(rows) if _crowded(spark, again) else out.unionByName(rest.withColumn("bucket_", bucket), allowMissingColumns=True)
    folder = f"data/{version:09d}-{uuid.uuid4().hex}"
    out.write.option("compression", "zstd").partitionBy("bucket_").parquet(f"{root}/{folder}")
    place, fs = _fs(spark, f"{root}/{folder}")
    written = {s.getPath().getName().split("=")[1]: f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(place) if s.getPath().getName().startswith("bucket_=")}
    schema = rows.schema if not found or replace else StructType([*rows.schema, *(f for f in StructType.fromJson(state["schema"]) if f.name not in rows.columns)])
    try:
        _publish(spark, root, version, {"schema": json.loads(schema.json()), "parts": keep | written, "buckets": count})
    except ConcurrentWriteError:
        fs.delete(place, True)
        raise
    return version


def diff_schema(a: DataFrame, b: DataFrame) -> dict[str, tuple[str | None, str | None]]:
    """Columns whose types differ between two tables."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return {c: (x.get(c), y.get(c)) for c in sorted({*x, *y}) if x.get(c) != y.get(c)}


def copy_table(spark: SparkSession, source: str, target: str) -> int:
    """Copy the latest version to a new table and count it there before anyone may drop the source."""
    df = read_latest(spark, source)
    commit(spark, target, df, replace=True)
    n = read_latest(spark, target).count()
    if n != df.count():
        raise RuntimeError("the copy is incomplete")
    return n


def snapshot(spark: SparkSession, root: str) -> str:
    """A copy of the latest version beside the collection; its path."""
    path = f"{root.rstrip('/')}-snapshot-{versions(spark, root)[-1]:09d}"
    if not exists(spark, path):
        copy_table(spark, root, path)
    return path


def migrate(spark: SparkSession, source: str, target: str, mode: str = "coexist", yes: bool = False, owned: str = "memlake") -> str:
    """coexist: an empty target beside the source. migrate: snapshot, copy, count, and only then drop the source. adopt: use the source as it is.

    Returns the collection to use. migrate needs yes, and a target whose name begins with owned.
    """
    if mode == "adopt":
        return source
    if mode == "coexist":
        ensure(spark, target, read_latest(spark, source).schema)
        return target
    if mode != "migrate":
        raise ValueError(f"no such mode: {mode}")
    if not yes:
        raise PermissionError("migrate drops the source: it needs yes")
    if not target.rstrip("/").rsplit("/", 1)[-1].startswith(owned):
        raise PermissionError(f"{target} does not begin with {owned}")
    snapshot(spark, source)
    copy_table(spark, source, target)
    place, fs = _fs(spark, source)
    fs.delete(place, True)
    return target
