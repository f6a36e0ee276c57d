"""Operators over literal rows and files, with their rows written out. All columns are compared as text; arrays and structs as JSON."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake import registry
from memlake.config import Config
from memlake.functions import scalars as S
from memlake.operators import chunkers, evaluation, hooks, indexing, ingest, telemetry
from memlake.shared import shared_dir
from memlake.sources import readers, sinks

T0 = datetime(2024, 1, 1)


CASES = {}


def rows(cols: str, *values: tuple) -> tuple[list[str], list[tuple]]:
    return cols.split(", "), [tuple(None if v is None else str(v) for v in row) for row in values]


def query(expected):
    def add(f):
        CASES[f.__name__.removeprefix("q_")] = f, expected
        return f

    return add


def as_text(df: DataFrame) -> DataFrame:
    deep = lambda t: t.startswith(("array", "struct", "map"))
    return df.select(*((F.to_json(c) if deep(t) else F.col(c).cast("string")).alias(c) for c, t in df.dtypes))


def folder(spark: SparkSession, files: dict[str, str | bytes], ages: dict[str, float] | None = None) -> str:
    """Literal files in a new folder that all executors see, some of them so many days old."""
    root = f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in files.items():
        place = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        fs = place.getFileSystem(conf)
        out = fs.create(place)
        out.write(text.encode() if isinstance(text, str) else text)
        out.close()
        if ages and name in ages:
            fs.setTimes(place, int((datetime.now().timestamp() - ages[name] * 86400) * 1000), -1)
    return root


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


_TREE = {"src/docs/a.md": "# A\nx", "src/b.md": b"ok \xff", "src/c.txt": "no", "src/never/d.md": "d", "src/t.jsonl": "{}", "other.md": "o"}


@query(rows("path, text, sha", *((p, t, sha(_TREE[p])) for p, t in (("src/docs/a.md", "# A\nx"), ("src/b.md", "ok \ufffd"), ("src/t.jsonl", "{}"), ("other.md", "o")))))
def q_file_expansion(spark, sf_dir):
    root = folder(spark, _TREE)
    files = readers.read_files(spark, [f"{root}/src", f"{root}/src/docs", f"{root}/other.md"], exclude=["never/*"])
    return as_text(files.select(readers.below(F.col("path"), [readers.re.sub("^file:/+", "/", root)]).alias("path"), "text", "sha"))


@query(rows("name", ("a.md",), ("b.md",)))
def q_recency_scan(spark, sf_dir):
    root = folder(spark, {"a.md": "a", "b.md": "b", "old.md": "o"}, {"b.md": 1, "old.md": 9})
    return as_text(readers.read_files(spark, root, modified="3d").select(F.element_at(F.split("path", "/"), -1).alias("name")))


def _line(kind: str, ident: str, text: object, side: bool = False) -> str:
    return json.dumps({"type": kind, "uuid": ident, "sessionId": "s1", "timestamp": "2024-01-01T00:00:00Z", "isSidechain": side, "message": {"content": text}})


_TALK = "\n".join([_line("user", "u1", "how do turtles swim"), "", _line("assistant", "a1", [{"type": "text", "text": "slowly"}]), '{"type": "weird"}', _line("assistant", "a2", "aside", True), _line("system", "y", "s"), _line("user", "u2", "and why"), '{"type": "us'])


@query(rows("pos, type", ("0", "user"), ("2", "assistant"), ("4", "assistant"), ("5", "system"), ("6", "user")))
def q_transcript_scan(spark, sf_dir):
    return as_text(readers.transcript_lines(spark.createDataFrame([("p", _TALK)], "path string, text string")).select("pos", "type"))


@query(rows("session, message, turn_index, user_json, answers", ("s1", "u1", "0", '"how do turtles swim"', '[[{"text":"slowly","type":"text"}]]'), ("s1", "u2", "1", '"and why"', "[]")))
def q_transcript_pairs(spark, sf_dir):
    pairs = indexing.transcript_pairs(readers.transcript_lines(spark.createDataFrame([("p", _TALK)], "path string, text string")))
    return as_text(pairs.select("session", "message", "turn_index", "user_json", F.concat(F.lit("["), F.array_join("assistant_json", ","), F.lit("]")).alias("answers")))


@query(rows("kind, n, tokens", ("a", "2", "7"), ("?", "1", "1")))
def q_audit_scan(spark, sf_dir):
    root = folder(spark, {"log.jsonl": '{"kind":"a","tokens":3}\nnonsense\n\n{"kind":"a","tokens":4}\n{"tokens":1}\n'})
    log = readers.read_log(spark, f"{root}/log.jsonl").where("tokens is not null")
    return as_text(log.groupBy(F.coalesce("kind", F.lit("?")).alias("kind")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")))


def _record(ident: str, kind: str) -> dict:
    return {"question_id": ident, "question_type": kind, "question": "q", "answer": "a", "haystack_session_ids": ["s1", "s2"], "haystack_sessions": [[{"role": "user", "content": "x"}, {"role": "assistant", "content": " "}], [{"role": "user", "content": "y"}]]}


@query(rows("question_id, axis, session_id, turn, document", *((i, "facts", s, "0", d) for i in ("1", "3", "4") for s, d in (("s1", "user: x"), ("s2", "user: y")))))
def q_longmem_records(spark, sf_dir):
    root = folder(spark, {"a/list.json": json.dumps([_record("1", "single"), _record("2", "odd")]), "b/map.json": json.dumps({"k": _record("3", "single")}), "broken.json": "[{", "note.txt": "x"})
    spare = spark.createDataFrame([(json.dumps([_record("4", "single")]),)], "value string")
    found = readers.read_records(spark, root, {"single": "facts"}).unionByName(readers.read_records(spark, folder(spark, {"x.txt": ""}), {"single": "facts"}, fallback=spare))
    return as_text(readers.haystack(found).join(found.select("question_id", "axis"), "question_id").select("question_id", "axis", "session_id", "turn", "document"))


@query(rows("sha, title, files", ("abc", "Fix it", '["src/a.py"]'), ("def", "More", "[]")))
def q_git_log(spark, sf_dir):
    return as_text(readers.git_log(spark.createDataFrame([("\u001eabc\tFix it\nsrc/a.py\n\n\u001edef\tMore\n",)], "value string")))


_MANIFEST = json.dumps({"a": "s1", "b": {"prod": "x", "tuned": "y", "prod_epoch": "e"}, "__gate__": "z", "__transcripts__": {"s": {"m": {"content_hash": "h", "indexed_at": "t", "epoch": "e"}}}})


@query(rows("kind, path, target, sha, epoch", ("file", "a", "prod", "s1", None), ("file", "b", "prod", "x", "e"), ("file", "b", "tuned", "y", None), ("message", "s", "m", "h", "e"), ("setting", "__gate__", None, "z", None)))
def q_manifest_state(spark, sf_dir):
    """Read, written in the JSON form and read again."""
    text = spark.createDataFrame([(_MANIFEST,)], "value string")
    again = spark.createDataFrame([(readers.manifest_json(readers.parse_manifest(text), {r["key"]: r["value"] for r in readers.parse_manifest_settings(text).collect()}),)], "value string")
    none = F.lit(None).cast("string")
    out = readers.parse_manifest(again).select(F.lit("file").alias("kind"), "path", "target", "sha", "epoch")
    out = out.unionByName(readers.parse_manifest_messages(text).select(F.lit("message").alias("kind"), F.col("session").alias("path"), F.col("message").alias("target"), F.col("content_hash").alias("sha"), "epoch"))
    return as_text(out.unionByName(readers.parse_manifest_settings(again).select(F.lit("setting").alias("kind"), F.col("key").alias("path"), none.alias("target"), F.col("value").alias("sha"), none.alias("epoch"))))


@query(rows("what, n", ("report", "1"), ("journal", "4"), ("beir", "2")))
def q_report_and_journal(spark, sf_dir):
    root = folder(spark, {"x": ""})
    q = spark.createDataFrame([("q", "text", ["d1", "d2"])], "id string, text string, gold array<string>")
    path = sinks.write_report(q, root, "1")
    for _ in "ab":
        sinks.append_log(q.unionByName(q), f"{root}/journal")
    sinks.write_beir(q, q.select("id"), f"{root}/beir")
    counts = [("report", spark.read.json(path).count()), ("journal", spark.read.json(f"{root}/journal").count()), ("beir", spark.read.parquet(f"{root}/beir/qrels").count())]
    return as_text(spark.createDataFrame(counts, "what string, n int"))


@query(rows("what, n", ("coexist", "0"), ("snapshot", "3"), ("moved", "3"), ("source", "gone"), ("adopted", "3"), ("refused", "PermissionError"), ("reserved", "PermissionError"), ("missing", "CollectionMissingError")))
def q_collection_modes(spark, sf_dir):
    root = folder(spark, {"x": ""})
    for name in ("one", "two"):
        ingest.commit(spark, f"{root}/{name}", spark.range(3))
    count = lambda path: str(ingest.read_latest(spark, path).count())

    def error(run) -> str:
        try:
            return str(run())
        except (PermissionError, LookupError) as e:
            return type(e).__name__

    got = [("coexist", count(ingest.migrate(spark, f"{root}/one", f"{root}/beside"))), ("adopted", count(ingest.migrate(spark, f"{root}/one", "x", "adopt"))), ("refused", error(lambda: ingest.migrate(spark, f"{root}/two", f"{root}/memlake-two", "migrate")))]
    got += [("moved", count(ingest.migrate(spark, f"{root}/two", f"{root}/memlake-two", "migrate", yes=True))), ("snapshot", count(f"{root}/two-snapshot-000000001")), ("source", "there" if ingest.exists(spark, f"{root}/two") else "gone")]
    got += [("reserved", error(lambda: ingest.commit(spark, f"{root}/system", spark.range(1)))), ("missing", error(lambda: ingest.read_latest(spark, f"{root}/none")))]
    return as_text(spark.createDataFrame(got, "what string, n string"))


_LONG = "word " * 400
_PIECE = ("word " * 160).strip()


@query(rows("path, chunk_idx, document", ("a", "0", "x"), ("a", "1", "y"), ("a", "2", "z"), ("c", "0", "# only"), ("d", "0", "p\n```\n# no header\n```\nq"), ("e", "0", _PIECE), ("e", "1", _PIECE), ("e", "2", ("word " * 112).strip()), ("f", "1", "long enough " * 8 + "end")))
def q_markdown_chunks(spark, sf_dir):
    """Sections without their headers, fences kept, long ones cut at 800 with 80 carried over; indices count before small chunks go."""
    docs = [("a", "# A\nx\n## B\ny\n### C\nz"), ("b", " \n "), ("c", "# only"), ("d", "p\n```\n# no header\n```\nq"), ("e", _LONG)]
    small = spark.createDataFrame([("f", "# H\nshort\n# I\n" + "long enough " * 8 + "end")], "path string, text string")
    return as_text(chunkers.chunk_documents(spark.createDataFrame(docs, "path string, text string"), min_tokens=0).unionByName(chunkers.chunk_documents(small)))


_BLOCKS = [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"p": "x" * 5000}}, {"type": "image"}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_result", "tool_use_id": "t1", "content": "no", "is_error": True}]


@query(rows("session, turn_index, piece, document", ("s", "0", "0", "### User\nquestion\n\n### Assistant\nhi\n[tool_use:Read id=t1 input=…(4kB elided)]\n[image]\n[thinking]\nhm\n[/thinking]\n[tool_result id=t1 is_error=true]\nno"), ("s", "1", "0", "### User"), ("s", "1", "1", ("w " * 1000).strip()), ("s", "1", "2", ("w " * 590).strip()), ("s", "1", "3", "```\n" + "c " * 500 + "\n```")))
def q_transcript_chunks(spark, sf_dir):
    """A turn as one chunk with blocks written out and payloads elided; a long one cut outside its fences."""
    two = "w " * 1510 + "\n\n```\n" + "c " * 500 + "\n```"
    pairs = [("s", 0, json.dumps("question"), [json.dumps(_BLOCKS)]), ("s", 1, json.dumps(two), [])]
    return as_text(chunkers.chunk_transcripts(spark.createDataFrame(pairs, "session string, turn_index int, user_json string, assistant_json array<string>")))


_PY = "import a\nimport b\n\nclass K:\n    y = 2\n\n    def m(self):\n        return 1\n\n@deco\ndef f():\n    a = 1\n\n    return a\n"


@query(rows("path, chunk_idx, document", *((p, str(i), d) for p, ds in {"k.py": ["import a\n\nimport b", "class K:\n    y = 2", "    def m(self):\n        return 1", "@deco\ndef f():\n    a = 1", "    return a"], "bad.py": ["def ("]}.items() for i, d in enumerate(ds))))
def q_python_chunks(spark, sf_dir):
    return as_text(chunkers.chunk_documents(spark.createDataFrame([("k.py", _PY), ("bad.py", "def (:\n# A".replace(":", ""))], "path string, text string"), "python", min_tokens=0))


@query(rows("path, chunk_idx, document", ("n.md", "0", "plain text " * 8 + "end"), ("s#0", "0", "### User\nhello")))
def q_chunk_by_suffix(spark, sf_dir):
    files = spark.createDataFrame([("n.md", "plain text " * 8 + "end"), ("t.jsonl", "{}")], "path string, text string")
    pairs = spark.createDataFrame([("s", 0, json.dumps("hello"), [])], "session string, turn_index int, user_json string, assistant_json array<string>")
    return as_text(chunkers.chunk_by_suffix(files, pairs))


@query(rows("path, query", ("src/models/user_store.py", "user store"), ("src/pay/service.py", "pay service"), ("tests/test_app.py", ""), ("a/My-Cool_File.v2.py", "my cool file"), ("src/__init__.py", "init")))
def q_derived_queries(spark, sf_dir):
    paths = ["src/models/user_store.py", "src/pay/service.py", "tests/test_app.py", "a/My-Cool_File.v2.py", "src/__init__.py"]
    return as_text(spark.createDataFrame([(p,) for p in paths], "path string").select("path", S.derive_query(F.col("path")).alias("query")))


_HITS = [("src/a.py", "A", 0.9), ("/else/b.py", "B", 0.9), ("src/low.py", "C", 0.1), ("src/gone.py", "D", 0.9), ("src/a.py", "A", 0.8), ("src/seen.py", "E", 0.8), ("/r/src/c.py", "F", None), ("src/d.py", "G", 0.5)]


@query(rows("qid, query, sources, empty, deduped, dropped, shadow", ("1", "user store", "src/a.py,/r/src/c.py", "false", "1", '{"stale":1,"floor":1,"foreign":1}', "fix the store user store"), ("2", "", "", "true", "0", '{"stale":0,"floor":0,"foreign":0}', None), ("3", "pay", "src/a.py,src/seen.py", "false", "0", '{"stale":1,"floor":1,"foreign":1}', None)))
def q_hook_run(spark, sf_dir):
    """Fetch, filter, inject, with shadow queries from the last task as of the edit."""
    t = lambda m: T0 + timedelta(minutes=m)
    edits = spark.createDataFrame([(1, "s", t(5), "/r/src/models/user_store.py"), (2, "s", t(6), "/r/notes.md"), (3, "u", t(5), "/r/src/pay.py")], "qid int, session string, ts timestamp, path string")
    said = spark.createDataFrame([("s", t(1), "old task"), ("s", t(4), " fix the store "), ("s", t(9), "later")], "session string, ts timestamp, text string")
    files = spark.createDataFrame([(f"/r/src/{x}.py",) for x in ("a", "low", "seen", "c", "d")], "path string")
    seen = spark.createDataFrame([("s", "src/seen.py", "E")], "session string, source string, text string").select("session", S.chunk_key(F.col("source"), F.col("text")).alias("key"))
    found = spark.createDataFrame([(i + 1, s, x, 1.0 / (i + 1), r) for i, (s, x, r) in enumerate(_HITS)], "rk int, source string, text string, score double, rerank_score double")
    search = lambda q: q.select("qid", F.explode(F.sequence(F.lit(1), F.lit(len(_HITS)))).alias("rk")).join(F.broadcast(found), "rk")
    got = hooks.run_hook(edits, search, seen, files, "/r", said, Config(min_score=0.3, inject_k=2))
    return as_text(got.select("qid", "query", F.array_join(F.transform("chunks", lambda c: c["source"]), ",").alias("sources"), "empty", "deduped", "dropped", F.col("shadow.query").alias("shadow")))


@query(rows("step, changed, written, pruned, live, ended", ("new", "4", "5", "0", "5", "0"), ("same", "0", "0", "0", "5", "0"), ("edited", "1", "1", "0", "5", "1")))
def q_index_run(spark, sf_dir):
    """The ingestion job over literal files: all, then nothing, then one changed file whose old version ends."""
    words = lambda seed: " ".join(f"{seed}{i}" for i in range(60))
    tree = {"src/a.md": f"# A\n{words('alpha')}\n# B\n{words('beta')}", "src/b.md": words("gamma"), "src/t.jsonl": _TALK}
    root, out = folder(spark, tree), []
    other = folder(spark, tree | {"src/b.md": words("delta")})
    for step, at in (("new", root), ("same", root), ("edited", None)):
        if at is None:  # the changed text takes the file's place
            _replace(spark, f"{other}/src/b.md", f"{root}/src/b.md")
        r = indexing.index(spark, f"{root}/src", f"{root}/state", now=T0)
        p = ingest.read_latest(spark, f"{root}/state/points")
        out.append((step, r.changed, r.written, r.pruned, p.where("valid_to is null").count(), p.where("valid_to is not null").count()))
    return as_text(spark.createDataFrame(out, "step string, changed int, written int, pruned int, live int, ended int"))


def _replace(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(b, False)
    fs.rename(a, b)


@query(rows("path, chunk_id", *(("a.md", "a.md#" + hashlib.sha1(t).hexdigest()[:12]) for t in (b"one", b"two"))))
def q_gold_chunks(spark, sf_dir):
    files = spark.createDataFrame([("a.md", "# H\none\n# I\ntwo"), ("b.md", "x")], "path string, text string")
    return as_text(evaluation.gold_chunks(files.where("path = 'a.md'"), files))


@query(rows("path, question, gold, missing", ("docs/1.md", "First  part\nof it.", '["docs/1.md","src/a.py"]', "src/gone.ts")))
def q_citations(spark, sf_dir):
    text = "# T\n## Context\n\nFirst  part\nof it.\n\nSecond.\n## Decision\nUse `src/a.py` and `src/gone.ts`, not `b.py`.\n## After\n`src/c.py`"
    adr = spark.createDataFrame([("docs/1.md", text), ("docs/2.md", "## Decision\n`src/a.py`")], "path string, text string")
    gold, missing = evaluation.citations(adr, spark.createDataFrame([("src/a.py",), ("src/c.py",)], "path string"))
    return as_text(gold.join(missing.withColumnRenamed("cited", "missing"), "path").select("path", "question", "gold", "missing"))


@query(rows("key, sum, sumsq, n, least, most", ("a", "7", "49", "7", "7", "7"), ("b", "3", "5", "2", "1", "2")))
def q_migrated_aggregates(spark, sf_dir):
    return as_text(telemetry.migrate_aggregates(spark.createDataFrame([("a", "7"), ("b", '{"sum": 3, "sumsq": 5, "count": 2, "min": 1, "max": 2}')], "key string, value string")))


@query(rows("axis, metric, own, other, combined", ("a", "m", "0.5", None, "0.5"), ("b", "m", "0.5", "0.7", "0.6")))
def q_envelope_collapse(spark, sf_dir):
    return as_text(evaluation.collapse_envelope(spark.createDataFrame([("a", "m", 0.5, None, None), ("b", "m", 0.5, 0.7, 0.6)], "axis string, metric string, own double, other double, combined double")))


@query(rows("session, block", ("s", "\n".join(["- a.md § H (0.50) One two."] * 74))))
def q_pointer_block(spark, sf_dir):
    """74 lines of 26 characters and their breaks are the most that fit into 2,000."""
    p = spark.createDataFrame([("s", i, "/r/a.md", "H", 0.5, "One  two. Three.") for i in range(100)], "session string, pos int, source string, header string, score double, text string")
    return as_text(telemetry.pointer_lines(p, "/r"))


@query(rows("kind, names", ("chunker", "markdown,python"), ("embedder", "hashing"), ("reranker", "lexical"), ("retrieval", "bm25,dense,filtered_dense,tuned_hybrid,tuned_hybrid_hyde")))
def q_plugin_names(spark, sf_dir):
    return as_text(spark.createDataFrame([(k, ",".join(registry.names(k))) for k in ("chunker", "embedder", "reranker", "retrieval")], "kind string, names string"))


@query(rows("qid, id, score, error", ("1", "10", "0.9", None), ("1", "11", "0.2", None), ("2", "10", "0.4", "RerankError"), ("2", "11", "0.3", "RerankError")))
def q_remote_rerank(spark, sf_dir):
    """A reply with an index out of range fails its query, which keeps its fused scores."""
    hits = spark.createDataFrame([(q, i, i - 9, s, w, t) for q, w in ((1, "good"), (2, "bad")) for i, s, t in ((10, 0.4, "x"), (11, 0.3, "y"))], "qid int, id int, rk int, score double, query string, text string")

    def post(query: str, texts: list[str]) -> list[dict]:
        return [{"index": 0, "relevance_score": 0.9}, {"index": 1 if query == "good" else 7, "relevance_score": 0.2}]

    from memlake.operators.retrieval import rerank

    return as_text(rerank(hits, registry.checked_scorer(post)).select("qid", "id", "score", F.col("rerank_error").alias("error")))


@query(rows("merged", ('{"a":{"b":1,"c":[1,2,3]},"d":{"new":true},"e":5,"f":null}',)))
def q_merged_json(spark, sf_dir):
    base, over = '{"a": {"b": 1, "c": [1, 2]}, "d": {"old": true}, "e": 4}', '{"a": {"c": [2, 3, 3]}, "d": {"__replace__": true, "value": {"new": true}}, "e": 5, "f": null}'
    return as_text(spark.createDataFrame([(base, over)], "a string, b string").select(S.merge_json(F.col("a"), F.col("b")).alias("merged")))


_ROOMS = {"docs": ["docs"], "code": ["src"]}


@query(rows("what, hash", ("rooms", sha('{"docs": ["docs"], "code": ["src"]}')), ("reordered", sha('{"code": ["src"], "docs": ["docs"]}')), ("short", sha('{"k": 5}')[:16])))
def q_settings_hash(spark, sf_dir):
    got = [("rooms", S.settings_hash(_ROOMS)), ("reordered", S.settings_hash(dict(reversed(_ROOMS.items())))), ("short", S.settings_hash({"k": 5}, 16))]
    return as_text(spark.createDataFrame(got, "what string, hash string"))


@query(rows("id, document, file", (str(uuid.uuid5(uuid.NAMESPACE_URL, "my-topic")), "---\ntopic: My Topic!\ndescription: \ntags: [a]\n---\n\nsecond\n", "my-topic.md")))
def q_agent_write(spark, sf_dir):
    """A memory written twice is one point, of its last text."""
    root = folder(spark, {"x": ""})
    local = root.removeprefix("file:")
    for text in ("first", "second"):
        path, _ = sinks.remember(spark, local, f"{root}/points", topic="My Topic!", content=text, tags=["a"])
    return as_text(ingest.read_latest(spark, f"{root}/points").where("valid_to is null").select("id", F.col("text").alias("document"), F.element_at(F.split("file_path", "/"), -1).alias("file")))


@pytest.mark.parametrize("name", list(CASES))
def test_literal_rows(spark, sf, name):
    run, (columns, expected) = CASES[name]
    got = run(spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, expected))
