"""Sources: files, transcripts, logs, datasets."""

from __future__ import annotations

import _hashlib
import ctypes
import json
import re
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from memlake.functions import scalars as S
from memlake.shared import cut

AUDIT = "ts string, kind string, source string, tokens long, latency_ms double"
CHUNK = "struct<source:string,score:double,exists:boolean,lang:string>"
JOURNAL = f"ts string, session string, target string, query string, rerank string, chunks array<{CHUNK}>, empty boolean, deduped int, dropped struct<stale:int,floor:int,foreign:int>, ms double, shadow struct<query:string,chunks:array<{CHUNK}>>, kind string"
# What a code corpus holds and leaves out.
CODE_SUFFIXES = (".py", ".ts", ".md")
TOP_NAMES = ("README.md", "CHANGELOG.md", "AGENTS.md", "llms.txt")
LEFT_OUT_FIRST = ("tests", "dist", "build", ".planning", ".gsd")
LEFT_OUT_NAMES = ("test_*.py", "*_test.py", "*.lock", "*.generated.*")
SUFFIXES = (".md", ".jsonl")
#: Bytes of libcrypto's SHA256_CTX: eight words, the length, a block, and two counts.
SHA256_STATE = 112
TRANSCRIPT_TYPES = ("user", "assistant", "system", "summary")


def since(text: str) -> timedelta | None:
    """Nd or Nh as a duration; 0 means no limit."""
    if text == "0":
        return None
    m = re.fullmatch(r"(\d+)([dh])", text)
    if not m:
        raise ValueError(f"not a duration: {text}")
    return timedelta(**{"days" if m[2] == "d" else "hours": int(m[1])})


def plain_path(path: Column) -> Column:
    """A path of the local file system without its scheme; others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def below(path: Column, roots: Sequence[str]) -> Column:
    """A path relative to the longest of the roots that holds it; a root that is a file, to its folder; else as it is."""
    out = path
    folders = {x.rsplit("/", 1)[0] if x.endswith(SUFFIXES) else x.rstrip("/") for x in roots}
    for r in sorted(folders, key=len):
        out = F.when(path.startswith(r + "/"), F.substring(path, F.lit(len(r) + 2), F.length(path))).otherwise(out)
    return out


def roots_of(sources: str | Sequence[str]) -> list[str]:
    """Sources without a local scheme, each once; one inside another is left out."""
    given = [sources] if isinstance(sources, str) else list(sources)
    given = [re.sub("^file:/+", "/", x).rstrip("/") for x in given]
    return sorted({x for x in given if not any(x != y and x.startswith(y + "/") for y in given)})


def listing(spark: SparkSession, sources: str | Sequence[str]) -> DataFrame:
    """(path) of all files of the sources, of any age and without excludes; no contents are read."""
    return _files(spark, sources, (), "0", None, None).select("path")


def _files(spark: SparkSession, sources: str | Sequence[str], exclude: Sequence[str], modified: str, now: datetime | None, base: str | None, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    given = roots_of(sources)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    if (window := since(modified)) is not None:
        reader = reader.option("modifiedAfter", ((now or datetime.now()) - window).strftime("%Y-%m-%dT%H:%M:%S"))
    df = reader.load(given).withColumn("path", plain_path(F.col("path")))
    return df.where(~S.excluded(below(F.col("path"), [base] if base else given), exclude))


def read_files(spark: SparkSession, sources: str | Sequence[str], exclude: Sequence[str] = (), modified: str = "0", now: datetime | None = None, base: str | None = None, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(path, mtime, text, sha) of markdown and transcript files (or other suffixes) of the sources (files, or folders at any depth), each once.

    Excludes are globs over paths relative to the base, or else to the source. The suffix
    and age conditions reach the file listing, so contents of other files are not read.
    Invalid UTF-8 is replaced. Files that cannot be read are left out: see unread.
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return _files(spark, sources, exclude, modified, now, base, suffixes).select("path", F.col("modificationTime").alias("mtime"), text.alias("text"), F.sha2("content", 256).alias("sha"))


def unread(spark: SparkSession, files: DataFrame, sources: str | Sequence[str], **how) -> DataFrame:
    """(path) of listed files that read_files (files) could not read; the listing reads no contents."""
    options = {"exclude": (), "modified": "0", "now": None, "base": None} | how  # suffixes too
    return _files(spark, sources, **options).select("path").join(files.select("path"), "path", "left_anti")


def tail_lines(files: DataFrame, cap: int = 256 * 1024) -> DataFrame:
    """(path, pos, line) of texts (path, text): the lines that begin within the last cap bytes; all lines of shorter texts.

    Only the last bytes are split, in their row. Of files, the source log_lines reads no more than them.
    """
    size = F.octet_length("text")
    last = F.split(F.substring(F.col("text").cast("binary"), size - cap + 1, F.lit(cap)).cast("string"), "\n")
    kept = F.when(size <= cap, F.split("text", "\n")).otherwise(F.slice(last, F.lit(2), F.size(last)))  # the line that was begun before goes
    all_lines = size - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    tails = files.select("path", all_lines.alias("all"), kept.alias("kept"))
    return tails.select("path", (F.col("all") - F.size("kept")).alias("before"), F.posexplode("kept").alias("at", "line")).select("path", (F.col("before") + F.col("at")).alias("pos"), "line")


def transcript_lines(files: DataFrame) -> DataFrame:
    """(path, pos, type, event VARIANT) of transcript texts.

    Blank lines and unknown types are skipped, a broken last line is dropped, a broken line
    before it or one that is no object raises.
    """
    split = F.split("text", "\n")
    last = F.array_max(F.transform(split, lambda x, i: F.when(F.trim(x) != "", i)))
    lines = files.select("path", last.alias("last"), F.posexplode(split).alias("pos", "line")).where(F.trim("line") != "")
    parsed = lines.withColumn("event", F.try_parse_json("line"))
    shape = F.schema_of_variant("event").startswith("OBJECT")
    bad = F.raise_error(F.concat(F.lit("broken transcript line "), F.col("pos").cast("string"), F.lit(" of "), F.col("path")))
    kind = F.try_variant_get("event", "$.type", "string")
    # one condition: as two, the optimizer could test the type first and never reach the error
    ok = F.when(F.col("event").isNull(), F.when(F.col("pos") == F.col("last"), False).otherwise(bad.cast("boolean"))).when(~shape, bad.cast("boolean")).otherwise(kind.isin(*TRANSCRIPT_TYPES))
    return parsed.where(ok).select("path", "pos", kind.alias("type"), "event")


def read_log(spark: SparkSession, path: str, schema: str = AUDIT) -> DataFrame:
    """JSON lines; blank and malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


RECORD = "struct<question_id:string,question_type:string,question:string,answer:string,answer_session_ids:array<string>,haystack_session_ids:array<string>,haystack_sessions:array<array<struct<role:string,content:string>>>>"


def parse_records(texts: DataFrame, axes: Mapping[str, str]) -> DataFrame:
    """Long-memory records of JSON texts (value), lists of records or objects of them, with their axis; unknown axes and broken texts are dropped."""
    alias = F.create_map(*(F.lit(x) for pair in axes.items() for x in pair)) if axes else F.lit(None).cast("map<string,string>")
    listed = F.from_json("value", f"array<{RECORD}>")
    named = F.map_values(F.from_json("value", f"map<string,{RECORD}>"))
    rec = texts.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(named)).alias("r")).select("r.*")
    return rec.withColumn("axis", alias[F.col("question_type")]).where("axis is not null and question_id is not null")


def read_records(spark: SparkSession, path: str, axes: Mapping[str, str], fallback: DataFrame | None = None) -> DataFrame:
    """Records of all JSON files below a path; where there are none, those of the fallback's texts (value)."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    if fallback is not None and files.isEmpty():
        files = fallback
    return parse_records(files, axes)


def haystack(records: DataFrame) -> DataFrame:
    """(question_id, session_id, turn, document) of every turn with content, as `role: content`."""
    flat = records.select("question_id", F.explode(F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_sessions").alias("turns"))).alias("s"))
    turns = flat.select("question_id", F.col("s.id").alias("session_id"), F.posexplode("s.turns").alias("turn", "t"))
    return turns.where(F.trim("t.content") != "").select("question_id", "session_id", "turn", F.concat("t.role", F.lit(": "), "t.content").alias("document"))


def corpus_path(path: Column) -> Column:
    """Whether a code corpus takes a path: an allowed suffix or a top-level document, outside tests, builds, caches and lock files."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    taken = path.rlike("(" + "|".join(re.escape(s) for s in CODE_SUFFIXES) + ")$") | path.isin(*TOP_NAMES)
    out = parts[0].isin(*LEFT_OUT_FIRST) | F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), "tests") | F.array_contains(parts, "__pycache__")
    for glob in LEFT_OUT_NAMES:
        out = out | name.rlike(S.glob_pattern(glob))
    return taken & ~out


def git_log(text: DataFrame) -> DataFrame:
    """(sha, title, files) of an exported log: records after \\x1e, fields between tabs, then a file a line."""
    rec = text.select(F.explode(F.split("value", "\u001e")).alias("r")).where(F.trim("r") != "")
    lines = F.split("r", "\n")
    files = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x) != "")
    return rec.select(F.split_part(lines[0], F.lit("\t"), F.lit(1)).alias("sha"), F.split_part(lines[0], F.lit("\t"), F.lit(2)).alias("title"), files.alias("files"))


def content_digest(files: DataFrame) -> str:
    """One SHA-256 of a tree (path, content binary or text): each path and its content, both ended by a zero byte, in path order.

    A hash of a sequence has to see it in sequence: the sorted parts are read one after another, each by a task
    of its own, and only the hash's state of 112 bytes goes from part to part by way of the driver.
    """
    rows = cut(files.select("path", F.col("content").cast("binary").alias("content")).repartitionByRange("path").sortWithinPartitions("path")).rdd
    state = Sha256().state()
    for part in range(rows.getNumPartitions()):
        state = rows.context.runJob(rows, lambda own, state=state: [_hashed(own, state)], [part])[0]
    return Sha256(state).hexdigest()


def _hashed(rows: Iterable[Row], state: bytes) -> bytes:
    h = Sha256(state)
    for r in rows:
        h.update(r["path"].encode() + b"\0" + bytes(r["content"]) + b"\0")
    return h.state()


class Sha256:
    """SHA-256 of the library that hashlib uses, with a state that another process can go on from (hashlib keeps its own to itself)."""

    def __init__(self, state: bytes | None = None) -> None:
        self._lib, self._at = ctypes.CDLL(_hashlib.__file__), ctypes.create_string_buffer(state, SHA256_STATE) if state else ctypes.create_string_buffer(SHA256_STATE)
        if state is None:
            self._lib.SHA256_Init(self._at)

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._at, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self._at.raw

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self._at.raw, SHA256_STATE)
        self._lib.SHA256_Final(out, last)
        return out.raw.hex()


def tree_digest(files: DataFrame) -> DataFrame:
    """(files, digest): one SHA-256 of a tree (path, content) that does not depend on an order, so that tasks' shares merge.

    Every file counts with the hash of its path and content; the eight words of these
    hashes are summed up, and the sums and the count hashed. Paths and contents are told
    apart by the length of the path.
    """
    path, content = F.col("path").cast("binary"), F.coalesce(F.col("content").cast("binary"), F.lit("").cast("binary"))
    own = files.select(F.sha2(F.concat(F.concat(F.length(path).cast("string"), F.lit(":")).cast("binary"), path, content), 256).alias("h"))
    word = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = own.agg(F.count("*").alias("files"), *(F.coalesce(F.sum(word(i)), F.lit(0)).alias(f"w{i}") for i in range(8)))
    return sums.select("files", F.sha2(F.concat_ws(":", "files", *(F.col(f"w{i}").cast("string") for i in range(8))).cast("binary"), 256).alias("digest"))


#: Keys of a manifest that are no paths, and its suffix of epochs.
TRANSCRIPTS, EPOCH = "__transcripts__", "_epoch"


def parse_manifest(texts: DataFrame) -> DataFrame:
    """(path, target, sha, epoch) of manifests in JSON (value): nested by target, or the older flat form (target prod)."""
    raw = texts.select(F.explode(F.from_json("value", "map<string,string>")).alias("path", "v")).where(~(F.col("path").startswith("__") & F.col("path").endswith("__")))
    nested = raw.where(F.col("v").startswith("{")).select("path", F.from_json("v", "map<string,string>").alias("m"))
    nested = nested.select("path", "m", F.explode("m").alias("target", "sha")).where(~F.col("target").endswith(EPOCH) & (F.col("sha") != ""))
    nested = nested.select("path", "target", "sha", F.element_at("m", F.concat("target", F.lit(EPOCH))).alias("epoch"))
    flat = raw.where(~F.col("v").startswith("{")).select("path", F.lit("prod").alias("target"), F.col("v").alias("sha"), F.lit(None).cast("string").alias("epoch"))
    return nested.unionByName(flat)


def parse_manifest_messages(texts: DataFrame) -> DataFrame:
    """(session, message, content_hash, epoch) of the transcripts that manifests in JSON (value) hold."""
    kept = F.from_json(F.get_json_object("value", f"$.{TRANSCRIPTS}"), "map<string,map<string,struct<content_hash:string,indexed_at:string,epoch:string>>>")
    flat = texts.select(F.explode(kept).alias("session", "m")).select("session", F.explode("m").alias("message", "x"))
    return flat.select("session", "message", F.coalesce("x.content_hash", F.lit("")).alias("content_hash"), "x.epoch")


def parse_manifest_settings(texts: DataFrame) -> DataFrame:
    """(key, value) of a manifest's reserved keys but for the transcripts."""
    raw = texts.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return raw.where(F.col("key").startswith("__") & F.col("key").endswith("__") & (F.col("key") != TRANSCRIPTS))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path, wholetext=True))


def save_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest (path, target, sha, epoch) as JSON objects, a line a file, which load_manifest reads; however large it is."""
    epoch = F.when(F.col("epoch").isNotNull(), F.struct(F.concat("target", F.lit(EPOCH)).alias("k"), F.col("epoch").alias("v")))
    own = F.struct(F.col("target").alias("k"), F.col("sha").alias("v"))
    each = F.array_compact(F.flatten(F.collect_list(F.array(own, epoch))))
    lines = manifest.groupBy("path").agg(F.map_from_entries(each).alias("m")).select(F.to_json(F.create_map("path", "m")))
    lines.write.mode("overwrite").text(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def manifest_json(manifest: DataFrame, settings: Mapping[str, str] | None = None) -> str:
    """A manifest (path, target, sha, epoch) in its JSON form, keys in order; epochs and settings that are null are left out.

    For interchange: the rows are streamed to the driver, which writes one file of them.
    """
    out: dict[str, object] = {k: v for k, v in (settings or {}).items() if v is not None}
    for r in manifest.toLocalIterator():
        entry = out.setdefault(r["path"], {"prod": "", "tuned": ""})
        entry[r["target"]] = r["sha"]
        if r["epoch"] is not None:
            entry[r["target"] + EPOCH] = r["epoch"]
    return json.dumps(out, indent=2, sort_keys=True)
