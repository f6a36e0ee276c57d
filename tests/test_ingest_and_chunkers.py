import json
import uuid
from datetime import datetime

import pytest
from memlake.operators import chunkers, ingest, turns
from memlake.sources import readers, sinks
from pyspark.sql import functions as F


def test_markdown():
    assert chunkers.chunk_markdown("# A\nx\n## B\ny\n### C\nz") == ["x", "y", "z"]
    assert chunkers.chunk_markdown("  \n ") == [] and chunkers.chunk_markdown(None) == [] and chunkers.chunk_markdown("# only") == ["# only"]
    assert chunkers.chunk_markdown("a\n```\n# no header\n```\nb") == ["a\n```\n# no header\n```\nb"]
    long = chunkers.chunk_markdown("word " * 1000)
    assert all(len(c) <= 800 for c in long) and len(long) > 5 and "".join(long).count("word") >= 1000


def test_fences():
    text, blocks = chunkers.protect_fences("a\n```py\nx\n```\nb")
    assert blocks == ["```py\nx\n```"] and chunkers.restore_fences(text, blocks) == "a\n```py\nx\n```\nb"
    for bad in ("```\nx", "```a\n```b\n```"):
        with pytest.raises(ValueError):
            chunkers.protect_fences(bad)


def test_drawer():
    blocks = [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"p": "x" * 5000}}, {"type": "image"}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_result", "tool_use_id": "t1", "content": "no", "is_error": True}]
    (one,) = chunkers.chunk_drawer("question", [blocks], soft_max=10_000)
    assert one.startswith("### User\nquestion\n\n### Assistant\nhi") and "[tool_use:Read id=t1 input=…(4kB elided)]" in one and "[image]" in one and "[thinking]\nhm\n[/thinking]" in one and "[tool_result id=t1 is_error=true]\nno" in one
    many = chunkers.chunk_drawer("q", ["p " * 3000])
    assert len(many) > 2 and all(len(c) <= 2000 for c in many)


def test_python_chunks():
    src = "import a\nimport b\n\nX = 1\n\nclass K:\n    y = 2\n\n    def m(self):\n        return 1\n\n@deco\ndef f():\n    a = 1\n\n    return a\n"
    got = chunkers.chunk_python(src)
    assert got[0].startswith("import a") and any(c.startswith("class K:\n    y = 2") for c in got) and any("def m" in c for c in got) and any(c.startswith("@deco\ndef f") for c in got) and "    return a" in got
    assert chunkers.chunk_python("def (:\n# A") == chunkers.chunk_markdown("def (:\n# A")


def test_chunk_documents_indexes_before_the_filter(spark):
    df = spark.createDataFrame([("a.md", "# H\n" + "short\n# I\n" + "long enough " * 20)], "path string, text string")
    assert [(r["chunk_idx"]) for r in chunkers.chunk_documents(df).collect()] == [1]


EVENTS = [("s", 0, "assistant"), ("s", 1, "user"), ("s", 2, "assistant"), ("s", 3, "system"), ("s", 4, "assistant"), ("s", 5, "user"), ("t", 0, "user")]


def test_turn_pairs(spark):
    df = spark.createDataFrame(EVENTS, "session string, pos long, type string").withColumn("isSidechain", F.col("pos") == 4)
    got = sorted((r["session"], r["turn_index"], r["user_pos"], r["assistant_pos"]) for r in turns.turn_pairs(df).collect())
    assert got == [("s", 0, 1, [2]), ("s", 1, 5, []), ("t", 0, 0, [])]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "c")
    with pytest.raises(ingest.CollectionMissingError):
        ingest.read_latest(spark, root)
    assert ingest.commit(spark, root, spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")) == 1
    assert ingest.commit(spark, root, spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string")) == 2
    assert sorted(tuple(r) for r in ingest.read_latest(spark, root).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert ingest.copy_table(spark, root, str(tmp_path / "d")) == 3
    with pytest.raises(PermissionError):
        ingest.commit(spark, str(tmp_path / "system"), spark.range(1))
    # what an unfinished write leaves behind is neither read nor in the way
    (tmp_path / "c" / "data" / "000000003-left").mkdir()
    assert ingest.read_latest(spark, root).count() == 3 and ingest.read_latest(spark, root, 1).count() == 2
    assert ingest.commit(spark, root, spark.createDataFrame([(4, "e", 1)], "id int, x string, y int")) == 3
    assert sorted(map(tuple, ingest.read_latest(spark, root).collect()))[-1] == (4, "e", 1) and ingest.read_latest(spark, root).columns == ["id", "x", "y"]
    # only buckets with new rows are written again
    before, after = (ingest._state(spark, root, v)["parts"] for v in (2, 3))
    assert sum(before.get(b) != p for b, p in after.items()) == 1
    # the second of two writers of one version loses, and its files go
    with pytest.raises(ingest.ConcurrentWriteError):
        ingest._publish(spark, root, 3, {})
    old = ingest.versions
    try:
        ingest.versions = lambda spark, root: old(spark, root)[:-1]
        with pytest.raises(ingest.ConcurrentWriteError):
            ingest.commit(spark, root, spark.createDataFrame([(9, "z")], "id int, x string"))
    finally:
        ingest.versions = old
    assert ingest.read_latest(spark, root).count() == 4
    ingest.ensure(spark, str(tmp_path / "e"), "id int, x string")
    assert ingest.read_latest(spark, str(tmp_path / "e")).count() == 0
    p = ingest.read_latest(spark, root).drop("y")
    assert {(r["id"], r["x"]) for r in ingest.update_payload(p, spark.createDataFrame([(1, "new"), (3, None)], "id int, x string")).collect()} == {(1, "new"), (2, "c"), (3, None), (4, "e")}
    assert sorted(r["id"] for r in ingest.delete_ids(p, spark.createDataFrame([(1,), (7,)], "id int")).collect()) == [2, 3, 4]
    pages = list(ingest.scroll(p, 2))
    assert [([r["id"] for r in page], at) for page, at in pages] == [([1, 2], 2), ([3, 4], None)] and list(ingest.scroll(p.limit(0), 2)) == []
    with pytest.raises(PermissionError):
        ingest.migrate(spark, root, str(tmp_path / "memlake-x"), "migrate")
    with pytest.raises(PermissionError):
        ingest.migrate(spark, root, str(tmp_path / "other"), "migrate", yes=True)
    assert ingest.migrate(spark, root, str(tmp_path / "co")) == str(tmp_path / "co") and ingest.read_latest(spark, str(tmp_path / "co")).count() == 0 and ingest.migrate(spark, root, "x", "adopt") == root
    copy = ingest.copy_table(spark, root, str(tmp_path / "src"))
    moved = ingest.migrate(spark, str(tmp_path / "src"), str(tmp_path / "memlake-x"), "migrate", yes=True)
    assert ingest.read_latest(spark, moved).count() == copy == ingest.read_latest(spark, str(tmp_path / "src-snapshot-000000001")).count() and not ingest.exists(spark, str(tmp_path / "src"))
    assert ingest.diff_schema(spark.range(1), spark.createDataFrame([("x",)], "id string")) == {"id": ("bigint", "string")}


def test_incremental(spark):
    manifest = spark.createDataFrame([("/gone", "prod", "1", "e"), ("rel", "prod", "1", "e"), ("/here", "prod", "1", "e")], "path string, target string, sha string, epoch string")
    files = spark.createDataFrame([("/here", "prod", "1", "e"), ("rel", "prod", "2", "e"), ("new", "prod", "1", "e"), ("/here", "tuned", "1", "e")], "path string, target string, sha string, epoch string")
    assert sorted((r["path"], r["target"]) for r in ingest.needs_index(files, manifest).collect()) == [("/here", "tuned"), ("new", "prod"), ("rel", "prod")]
    assert sorted(r["path"] for r in ingest.prune_manifest(manifest, files).collect()) == ["/here", "rel"]
    now = F.lit("2024-02-01").cast("timestamp")
    p = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "a", datetime(2023, 1, 1))], "id int, file_path string, valid_to timestamp")
    got = {r["id"]: r["valid_to"] for r in ingest.close_old(p, spark.createDataFrame([("a",)], "file_path string"), now).collect()}
    assert got == {1: datetime(2024, 2, 1), 2: None, 3: datetime(2023, 1, 1)}
    assert sorted(r["id"] for r in ingest.gc_sweep(p, now, 30).collect()) == [1, 2] and ingest.gc_sweep(p, now, 0).count() == 3
    chunks = spark.createDataFrame([("f", 0, "h"), ("f", 1, "h"), ("f", 2, "i")], "file_path string, chunk_idx int, chunk_hash string")
    # a file keeps all its different chunks
    assert sorted(r["chunk_idx"] for r in ingest.distinct_chunks(chunks).collect()) == [0, 2]
    t = spark.createDataFrame([("2024-01-01T00:00:00Z", None), ("", datetime(2020, 1, 1)), ("bad", None)], "ts string, m timestamp").select(ingest.valid_from(F.col("ts"), F.col("m"), now)).collect()
    assert [r[0] for r in t] == [datetime(2024, 1, 1), datetime(2020, 1, 1), datetime(2024, 2, 1)]
    back = ingest.backfill_prefixes(spark.createDataFrame([("a/b", None), ("a/b", ["x"])], "file_path string, path_prefixes array<string>"))
    assert [r["path_prefixes"] for r in back.collect()] == [["a", "a/b"], ["x"]]


def line(kind, **kw):
    return json.dumps({"type": kind, **kw})


def test_files_and_transcripts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"ok \xff")
    (tmp_path / "sub" / "t.jsonl").write_text("\n".join([line("user", message={"content": "hi"}), "", line("weird"), line("assistant", message={"content": [{"type": "text"}]}), '{"type": "us']))
    (tmp_path / "c.txt").write_text("no")
    files = readers.read_files(spark, str(tmp_path), exclude=["never/*"])
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in files.collect()) == ["a.md", "t.jsonl"]
    assert files.where("path like '%a.md'").first()["text"] == "ok \ufffd"
    got = readers.transcript_lines(files.where("path like '%.jsonl'")).orderBy("pos").collect()
    assert [(r["pos"], r["type"]) for r in got] == [(0, "user"), (3, "assistant")]
    for bad in ('{"type": \n{"type": "user"}', "[1]\n" + line("user")):
        with pytest.raises(Exception, match="broken transcript line"):
            readers.transcript_lines(spark.createDataFrame([("p", bad)], "path string, text string")).collect()
    assert readers.since("0") is None and readers.since("2d").days == 2
    with pytest.raises(ValueError):
        readers.since("2w")
    import hashlib

    tree = spark.createDataFrame([("b", "2"), ("a", "é")], "path string, content string").repartition(2)
    assert readers.content_digest(tree) == hashlib.sha256(b"a\0" + "é".encode() + b"\0b\0002\0").hexdigest()


def test_logs_records_manifest(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","kind":"a","tokens":3}\nnonsense\n\n{"kind":"b"}\n')
    assert readers.read_log(spark, str(tmp_path / "log.jsonl")).where("kind is not null").count() == 2
    rec = [{"question_id": "1", "question_type": "single", "question": "q", "answer": "a", "haystack_session_ids": ["s1", "s2"], "haystack_sessions": [[{"role": "user", "content": "x"}, {"role": "assistant", "content": " "}], [{"role": "user", "content": "y"}]]}, {"question_id": "2", "question_type": "odd"}]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "d.json").write_text(json.dumps(rec))
    records = readers.read_records(spark, str(tmp_path / "r"), {"single": "facts"})
    assert [r["axis"] for r in records.collect()] == ["facts"]
    assert sorted((r["session_id"], r["turn"], r["document"]) for r in readers.haystack(records).collect()) == [("s1", 0, "user: x"), ("s2", 0, "user: y")]
    (tmp_path / "m.json").write_text(json.dumps({"a": "sha1", "b": {"prod": "x", "tuned": "y", "prod_epoch": "e"}, "__gate__": "z"}))
    assert sorted(tuple(r) for r in readers.read_manifest(spark, str(tmp_path / "m.json")).collect()) == [("a", "prod", "sha1", None), ("b", "prod", "x", "e"), ("b", "tuned", "y", None)]
    (tmp_path / "m2.json").write_text(readers.manifest_json(readers.read_manifest(spark, str(tmp_path / "m.json")), {"__gate__": "z", "__none__": None}))
    assert sorted(map(str, readers.read_manifest(spark, str(tmp_path / "m2.json")).collect())) == sorted(map(str, readers.read_manifest(spark, str(tmp_path / "m.json")).collect())) and "__none__" not in (tmp_path / "m2.json").read_text()
    text = spark.read.text(str(tmp_path / "m2.json"), wholetext=True)
    assert [tuple(r) for r in readers.parse_manifest_settings(text).collect()] == [("__gate__", "z")]
    heard = spark.createDataFrame([(json.dumps({"__transcripts__": {"s": {"m": {"content_hash": "h", "indexed_at": "t", "epoch": "e"}, "n": {}}}}),)], "value string")
    assert sorted(map(tuple, readers.parse_manifest_messages(heard).select("session", "message", "content_hash").collect())) == [("s", "m", "h"), ("s", "n", "")] and readers.parse_manifest(heard).count() == 0
    named = spark.createDataFrame([(json.dumps({"k": rec[0]}),), ("{broken",)], "value string")
    assert [r["question_id"] for r in readers.parse_records(named, {"single": "facts"}).collect()] == ["1"]
    (tmp_path / "empty").mkdir()
    assert readers.read_records(spark, str(tmp_path / "empty"), {"single": "facts"}, fallback=named).count() == 1
    log = readers.git_log(spark.createDataFrame([("\u001eabc\tFix it\nsrc/a.py\n\n\u001edef\tMore\n",)], "value string")).collect()
    assert [(r["sha"], r["title"], r["files"]) for r in log] == [("abc", "Fix it", ["src/a.py"]), ("def", "More", [])]


def test_sinks(spark, tmp_path):
    q = spark.createDataFrame([("q", "text", ["d1", "d2"])], "id string, text string, gold array<string>")
    sinks.write_beir(q, spark.range(2), str(tmp_path / "beir"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "beir/qrels")).collect()) == [("q", "d1", 1), ("q", "d2", 1)]
    assert spark.read.json(sinks.write_report(q, str(tmp_path), "1")).count() == 1
    sinks.append_log(q, str(tmp_path / "log"))
    sinks.append_log(q, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    path, row = sinks.write_memory(spark, str(tmp_path / "mem"), topic="My Topic!", content="body", tags=["a"])
    assert path.endswith("my-topic.md") and open(path).read().endswith("body\n") and row.first()["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "my-topic"))
    with pytest.raises(ValueError):
        sinks.write_memory(spark, str(tmp_path), topic=" ", content="x")


def test_a_bucket_is_one_file_however_many_tasks_write(spark, tmp_path):
    root = str(tmp_path / "c")
    ingest.commit(spark, root, spark.range(0, 4000, 1, 8).withColumn("v", F.lit("x")))
    files = [str(p.parent) for p in (tmp_path / "c" / "data").rglob("*.parquet")]
    assert len(files) == len(set(files)) > 1
    assert ingest.read_latest(spark, root).count() == 4000


def test_many_small_files_of_a_bucket_become_one_again(spark, tmp_path):
    root, most = str(tmp_path / "c"), 0
    for i in range(8):
        ingest.commit(spark, root, spark.createDataFrame([(0, f"{i}"), (i + 1, "x")], "id int, x string").withColumn("of", F.lit("one")), by="of")
        files = ingest.read_latest(spark, root).inputFiles()
        most = max(most, len(files))
    assert 1 < most <= 6 and len(files) < 6
    assert sorted((r["id"], r["x"]) for r in ingest.read_latest(spark, root).collect()) == [(0, "7"), *((i + 1, "x") for i in range(8))]


def test_chunks_keep_columns_of_their_document(spark):
    df = spark.sql("select 'a' as path, '# H\none\n# I\ntwo' as text, timestamp'2024-01-01 00:00:00.000001' as mtime, 7L as n union all select 'b', null, null, null union all select 'c', 'x', null, null")
    got = chunkers.chunk_documents(df, min_tokens=0, keep=("mtime", "n"))
    at = datetime(2024, 1, 1, 0, 0, 0, 1)
    assert sorted(map(tuple, got.collect()), key=str) == [("a", at, 7, 0, "one"), ("a", at, 7, 1, "two"), ("c", None, None, 0, "x")]


def test_content_digest_sends_no_contents_to_the_driver(spark, monkeypatch):
    import hashlib

    tree = spark.range(300).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.repeat(F.lit("ab"), F.col("id").cast("int")).alias("content")).repartition(5)
    monkeypatch.setattr(type(tree), "toLocalIterator", None)
    want = hashlib.sha256()
    for p in sorted(f"p{i}" for i in range(300)):
        want.update(p.encode() + b"\0" + b"ab" * int(p[1:]) + b"\0")
    assert readers.content_digest(tree) == want.hexdigest()
    assert readers.content_digest(tree.limit(0)) == hashlib.sha256().hexdigest()


def test_transcripts_are_archived(spark, tmp_path):
    from memlake.plans import derived

    rows = spark.range(3000).select((F.col("id") % 1000).alias("conv_id"), F.expr("id div 1000").alias("turn"), F.lit("user").alias("role"), F.lit('a "b"\nc').alias("text"))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    files = derived.transcript_files(spark, str(tmp_path))
    assert files.select("path").distinct().count() == 1000
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(derived.transcript_folder(spark, str(tmp_path))).count() < 25
    got = derived.q_transcript_scan(spark, str(tmp_path)).groupBy("conv_id").agg(F.array_sort(F.collect_list("pos")).alias("pos"))
    assert {tuple(r["pos"]) for r in got.collect()} == {(0, 1, 2)} and got.count() == 1000
    assert derived.q_file_expansion(spark, str(tmp_path)).count() == 1000 - 111
