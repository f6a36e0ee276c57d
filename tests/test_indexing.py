import json
import os
import time
import uuid
from datetime import datetime, timedelta

import pytest
from memlake.config import Config
from memlake.operators import chunkers, hooks, indexing, ingest, retrieval
from memlake.registry import RerankError, UnknownPluginError, batched_scorer, checked_scorer, floor_is_reachable, lookup, names, register
from memlake.sources import readers
from pyspark.sql import functions as F

NOW = datetime(2024, 2, 1)
ROOMS = {"docs": ["docs"]}


def words(n, seed):
    return " ".join(f"{seed}{i}" for i in range(n))


def message(kind, ident, text, session="s1", **more):
    return json.dumps({"type": kind, "uuid": ident, "sessionId": session, "timestamp": "2024-01-01T00:00:00Z", "message": {"content": text}} | more)


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src" / "docs").mkdir(parents=True)
    (tmp_path / "src" / "docs" / "a.md").write_text(f"# A\n{words(60, 'alpha')}\n# B\n{words(60, 'beta')}")
    (tmp_path / "src" / "b.md").write_text(words(80, "gamma"))
    (tmp_path / "src" / "t.jsonl").write_text("\n".join([message("user", "u1", "how do turtles swim"), message("assistant", "x", "slowly"), message("user", "u2", "and why")]))
    return tmp_path


def run(spark, tree, **how):
    return indexing.index(spark, str(tree / "src"), str(tree / "state"), rooms=ROOMS, now=NOW, **how)


def points(spark, tree):
    return ingest.read_latest(spark, str(tree / "state" / "points"))


def test_index_goes_from_empty_to_changed_to_done(spark, tree):
    first = run(spark, tree)
    assert (first.files, first.failed, first.changed, first.written, first.fallback) == (3, 0, 4, 5, 0)
    got = points(spark, tree).collect()
    assert {r["room"] for r in got if r["file_path"].endswith("a.md")} == {"docs"} and all(r["valid_to"] is None for r in got)
    said = [r for r in got if r["chunker"] == "transcript"]
    assert len(said) == 2 and {r["valid_from"] for r in said} == {datetime(2024, 1, 1)} and {(r["session"], r["message"]) for r in said} == {("s1", "u1"), ("s1", "u2")} and any("slowly" in r["text"] for r in said)
    assert run(spark, tree).written == 0  # nothing is dirty
    (tree / "src" / "b.md").write_text(words(80, "delta"))
    with open(tree / "src" / "t.jsonl", "a") as f:
        f.write("\n" + message("assistant", "y", "because"))
    third = run(spark, tree)
    assert (third.changed, third.written) == (2, 2)
    got = points(spark, tree)
    assert got.where("valid_to is not null").select("text").collect()[0][0].startswith("gamma0") and got.where("file_path like '%b.md' and valid_to is null").count() == 1
    assert got.where("chunker = 'transcript'").count() == 2  # the grown turn took its own place
    fourth = run(spark, tree, retention_days=1.0)
    assert fourth.written == 0 and points(spark, tree).where("valid_to is not null").count() == 1
    indexing.index(spark, str(tree / "src"), str(tree / "state"), rooms=ROOMS, now=NOW + timedelta(days=3), retention_days=1.0)
    assert points(spark, tree).where("valid_to is not null").count() == 0
    os.remove(tree / "src" / "b.md")
    gone = run(spark, tree)
    assert gone.pruned == 1 and points(spark, tree).where("file_path like '%b.md'").count() == 1
    moved = indexing.index(spark, str(tree / "src"), str(tree / "state"), rooms={"letters": ["src"]}, now=NOW)
    assert moved.reclassified >= 2 and moved.written == 0 and {r["room"] for r in points(spark, tree).collect()} <= {"letters", None}


def test_a_run_that_fails_midway_is_done_again(spark, tree, monkeypatch):
    run(spark, tree)
    (tree / "src" / "b.md").write_text(words(80, "delta"))
    real, calls = ingest.commit, []

    def failing(spark, root, *args, **kw):
        if root.endswith("manifest"):
            raise OSError("disk")
        return real(spark, root, *args, **kw)

    monkeypatch.setattr(ingest, "commit", failing)
    with pytest.raises(OSError):
        run(spark, tree)
    monkeypatch.setattr(ingest, "commit", real)
    before = sorted(r["id"] for r in points(spark, tree).collect())
    again = run(spark, tree)
    assert again.written == 1 and sorted(r["id"] for r in points(spark, tree).collect()) == before and not calls
    live = points(spark, tree).where("file_path like '%b.md' and valid_to is null").collect()
    assert [r["text"].split()[0] for r in live] == ["delta0"]


def test_texts_are_neither_cut_nor_dealt_again(spark, tree, monkeypatch):
    """Only keys are cut; a commit deals its new rows to the buckets, and old ones stay in theirs."""
    cuts, dealt, real_cut, frame = [], [], indexing.cut, type(spark.range(1))
    real_hint = frame.hint
    sources = str(tree / "src")
    index = lambda day: indexing.index_files(spark, files, str(tree / "state"), there=files.select("path"), roots=[sources], now=NOW + timedelta(days=day))
    files = real_cut(readers.read_files(spark, sources))
    assert index(0).written == 5
    before = {r["id"]: r["text"] for r in points(spark, tree).collect()}
    (tree / "src" / "b.md").write_text(words(80, "delta"))
    files = real_cut(readers.read_files(spark, sources))
    for module in (indexing, ingest):
        monkeypatch.setattr(module, "cut", lambda df: cuts.append(df.columns) or real_cut(df))
    monkeypatch.setattr(frame, "hint", lambda df, name, *p: (name == "rebalance" and "text" in df.columns and dealt.append(df.count())) or real_hint(df, name, *p))
    got = index(1)
    assert (got.changed, got.written) == (1, 1) and not [c for c in cuts if "text" in c] and dealt == [1]
    after = {r["id"]: r for r in points(spark, tree).collect()}
    assert len(after) == 6 and {i: after[i]["text"] for i in before} == before
    assert [r["text"].split()[0] for r in after.values() if r["valid_to"]] == ["gamma0"]


def test_search_over_an_indexed_collection(spark, tree):
    run(spark, tree, embedder="hashing")
    p = points(spark, tree)
    vec = lookup("embedder", "hashing")
    q = spark.createDataFrame([("q1", "alpha3 alpha4", vec(["alpha3 alpha4"])[0]), ("q2", "turtles", vec(["turtles"])[0])], "qid string, text string, vec array<double>")
    for name in ("tuned_hybrid", "filtered_dense", "tuned_hybrid_hyde"):
        hits = lookup("retrieval", name)(p, q, now=str(NOW), config=Config(content_dedup=True, decay_enabled=True)).collect()
        best = {r["qid"]: r for r in hits if r["place"] == 1}
        assert best["q1"]["text"].startswith("alpha0") and "turtles" in best["q2"]["text"] and all(uuid.UUID(r["id"]) for r in hits)
    hits = retrieval.search(p, q, now=str(NOW), scorer=lookup("reranker", "lexical")).collect()
    assert {r["rerank_error"] for r in hits} == {None} and {r["qid"] for r in hits} == {"q1", "q2"}
    for arm in ("dense", "bm25"):
        assert lookup("retrieval", arm)(p, q).where("rk = 1").count() == 2


def test_broken_pairs_raise(spark):
    lines = readers.transcript_lines(spark.createDataFrame([("p", message("user", "", "hi"))], "path string, text string"))
    with pytest.raises(Exception, match="without session or message id"):
        indexing.transcript_pairs(lines).collect()


def test_sources_and_excludes(spark, tree):
    (tree / "other.md").write_text("x")
    names_ = lambda **how: sorted(r["path"].rsplit("/", 1)[-1] for r in readers.read_files(spark, [str(tree / "src"), str(tree / "src" / "docs"), str(tree / "other.md")], **how).collect())
    assert names_() == ["a.md", "b.md", "other.md", "t.jsonl"]
    assert names_(exclude=["docs/*"]) == ["b.md", "other.md", "t.jsonl"] and names_(exclude=["*.md"]) == ["t.jsonl"] and names_(exclude=["src/*"], base=str(tree)) == ["other.md"]
    files = readers.read_files(spark, str(tree / "src"))
    assert readers.unread(spark, files.where("path not like '%b.md'"), str(tree / "src")).collect()[0]["path"].endswith("b.md")
    old = time.time() - 10 * 86400
    os.utime(tree / "src" / "b.md", (old, old))
    assert readers.read_files(spark, str(tree / "src"), modified="2d").where("path like '%b.md'").count() == 0


def test_tail_lines(spark):
    rng = list(range(40))
    text = "\n".join("x" * (i % 7) for i in rng) + "\n"
    for cap in (1, 10, 33, 60, 10_000):
        start = max(0, len(text) - cap)
        blob = text[start:]
        want = (blob if not start else blob[blob.find("\n") + 1 :]).split("\n")
        got = [r["line"] for r in readers.tail_lines(spark.createDataFrame([("p", text)], "path string, text string"), cap).orderBy("pos").collect()]
        assert [x for x in got if x] == [x for x in want if x], cap


def test_transcript_pieces_keep_their_pair(spark):
    pairs = spark.createDataFrame([("p", "s", "m", 3, json.dumps("word " * 3000), [json.dumps("ok")])], "path string, session string, message string, turn_index int, user_json string, assistant_json array<string>")
    got = chunkers.chunk_transcripts(pairs).orderBy("piece").collect()
    assert len(got) > 2 and {(r["path"], r["session"], r["message"], r["turn_index"]) for r in got} == {("p", "s", "m", 3)} and [r["piece"] for r in got] == list(range(len(got)))


def test_registries():
    assert names("retrieval") == ["bm25", "dense", "filtered_dense", "tuned_hybrid", "tuned_hybrid_hyde"] and {"markdown", "python"} <= set(names("chunker"))
    with pytest.raises(UnknownPluginError):
        lookup("reranker", "nothing")
    with pytest.raises(UnknownPluginError):
        register("nothing", "x")(1)
    assert batched_scorer(lambda pairs: [len(t) for _, t in pairs], 2)("q", ["a", "bb", "ccc"]) == [1.0, 2.0, 3.0]
    with pytest.warns(UserWarning):
        assert not floor_is_reachable(2.5, 1.0)
    assert floor_is_reachable(0.5, 1.0) and floor_is_reachable(9, None) and floor_is_reachable(0, 0)
    with pytest.warns(UserWarning):
        assert Config.read({"k": 7, "odd": 1}).k == 7
    for bad in ({"k": "7"}, {"decay_enabled": 1}, {"remote_timeout": 0.0}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_checked_scorer():
    ok = checked_scorer(lambda q, t: [{"index": 1, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}])
    assert ok("q", ["a", "b", "c"]) == [0.1, 0.9, -0.9]
    for bad in ([], [{"index": 5, "relevance_score": 1}], [{"index": 0}], [{"index": True, "relevance_score": 1}], [{"index": 0, "relevance_score": float("nan")}], [{"index": 0, "relevance_score": 1}] * 2):
        with pytest.raises(RerankError):
            checked_scorer(lambda q, t, bad=bad: bad)("q", ["a", "b"])
    calls = []

    def flaky(q, t):
        calls.append(1)
        if len(calls) < 2:
            raise TimeoutError
        return [{"index": 0, "relevance_score": 1.0}]

    assert checked_scorer(flaky, wait=0)("q", ["a"]) == [1.0] and len(calls) == 2

    def down(q, t):
        raise OSError

    with pytest.raises(RerankError):
        checked_scorer(down, wait=0)("q", ["a"])


def test_hook(spark):
    t = lambda m: NOW + timedelta(minutes=m)
    edits = spark.createDataFrame([(1, "s", t(5), "/r/src/models/user_store.py"), (2, "s", t(6), "/r/notes.md"), (3, "u", t(5), "/r/src/pay.py")], "qid int, session string, ts timestamp, path string")
    said = spark.createDataFrame([("s", t(1), "old task"), ("s", t(4), " fix the store "), ("s", t(9), "later"), ("s", t(4.5), " ")], "session string, ts timestamp, text string")
    asked = {(r["qid"], r["channel"]): r["query"] for r in hooks.edit_queries(edits, said, "/r").collect()}
    assert asked == {(1, "hook"): "user store", (1, "shadow"): "fix the store user store", (3, "hook"): "pay"}
    assert hooks.last_task(edits, said).where("qid = 3").first()["task"] == ""
    rows = [("src/a.py", "A", 0.9), ("/else/b.py", "B", 0.9), ("src/low.py", "C", 0.1), ("src/gone.py", "D", 0.9), ("src/a.py", "A", 0.8), ("src/seen.py", "E", 0.8), ("/r/src/c.py", "F", None), ("src/d.py", "G", 0.5)]
    files = spark.createDataFrame([(f"/r/src/{x}.py",) for x in ("a", "low", "seen", "c", "d")], "path string")
    seen = hits_key(spark, [("s", "src/seen.py", "E")])

    def search(queries):
        one = spark.createDataFrame([(i + 1, s, x, 1.0 / (i + 1), r) for i, (s, x, r) in enumerate(rows)], "rk int, source string, text string, score double, rerank_score double")
        return queries.select("qid").crossJoin(one)

    got = {r["qid"]: r for r in hooks.run_hook(edits, search, seen, files, "/r", said, Config(min_score=0.3, inject_k=2)).collect()}
    one = got[1]
    assert [c["source"] for c in one["chunks"]] == ["src/a.py", "/r/src/c.py"] and one["deduped"] == 1 and tuple(one["dropped"]) == (1, 1, 1) and not one["empty"]
    assert one["shadow"]["query"] == "fix the store user store" and len(one["shadow"]["chunks"]) == 2
    assert got[2]["empty"] and got[2]["query"] == "" and got[2]["shadow"] is None and tuple(got[2]["dropped"]) == (0, 0, 0)
    assert got[3]["deduped"] == 0 and got[3]["shadow"] is None


def hits_key(spark, rows):
    from memlake.functions import scalars as S

    return spark.createDataFrame(rows, "session string, source string, text string").select("session", S.chunk_key(F.col("source"), F.col("text")).alias("key"))
