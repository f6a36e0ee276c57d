import uuid
from datetime import datetime

import pytest
from memlake.config import Config
from memlake.functions import predicates
from memlake.functions import scalars as S
from pyspark.sql import functions as F


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_config_checks():
    assert Config().k == 5
    for bad in ({"decay_alpha": 1.5}, {"decay_half_life_days": 0}, {"k_max": 51}, {"dedup_cosine": 0}, {"fetch_k": 0}, {"inject_k": 31}, {"min_score": float("nan")}, {"response_format": "x"}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_path_prefixes(spark):
    got = values(spark, [("src/a/b.py",), ("./src/a.py",), ("/abs/x.py",), ("README.md",), ("",), (".github/w.yml",), ("a//b",)], "p string", S.path_prefixes(F.col("p")))
    # leading dots of names stay: .github is not github
    assert got == [["src", "src/a", "src/a/b.py"], ["src", "src/a.py"], ["abs", "abs/x.py"], ["README.md"], [], [".github", ".github/w.yml"], ["a", "a/b"]]


def test_room(spark):
    rooms = {"tests": ["tests", "test"], "code": ["src"], "none": []}
    got = values(spark, [("data/chest_xray/img.png",), ("src/tests/a.py",), ("src/a.py",), (None,)], "p string", S.room(F.col("p"), rooms))
    assert got == [None, "tests", "code", None]


def test_globs(spark):
    got = values(spark, [("docs/a/b.md",), ("src/a.py",), ("x[1].md",)], "p string", S.excluded(F.col("p"), ["docs/*", "[!a-w][[]1].md"]))
    assert got == [True, False, True]


def test_decay_and_recency(spark):
    now = F.lit("2024-01-29").cast("timestamp")
    rows = [("2024-01-29",), ("2024-01-15",), ("2024-01-01",), ("1900-01-01",), (None,), ("nonsense",)]
    got = values(spark, rows, "t string", F.round(S.decay(S.parse_time(F.col("t")), now), 6))
    assert got == [1.0, 0.85, 0.775, 0.7, 1.0, 1.0]
    got = values(spark, rows[:1] + rows[4:], "t string", F.round(S.recency(S.parse_time(F.col("t")), now), 6))
    assert got == [1.1, 1.0, 1.0]


def test_naive_times_are_utc(spark):
    got = values(spark, [("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("2024-01-01T02:00:00+02:00",)], "t string", F.unix_micros(S.parse_time(F.col("t"))))
    assert len(set(got)) == 1


def test_uuid5(spark):
    names = ["a#chunk=0#hash=x", "ü", "", "日本"]
    assert values(spark, [(n,) for n in names], "n string", S.uuid5(F.col("n"))) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_piece_index_is_part_of_the_message_id(spark):
    got = values(spark, [(0,), (1,)], "i int", S.message_point_id(F.lit("s"), F.lit("m"), F.col("i")))
    assert len(set(got)) == 2


def test_text_functions(spark):
    assert values(spark, [("  Hello, World! ",), ("***",), (None,), ("x" * 80,)], "t string", S.slug(F.col("t"))) == ["hello-world", "untitled", "untitled", "x" * 64]
    assert values(spark, [("",), ("abcdefgh",)], "t string", S.token_estimate(F.col("t"))) == [1, 2]
    assert values(spark, [("привет мир ok",), ("hello",), ("123",)], "t string", S.cyrillic(F.col("t"))) == ["ru", "en", "en"]
    assert values(spark, [("abcdef",), ("abc",)], "t string", S.preview(F.col("t"), 4)) == ["abc…", "abc"]
    assert values(spark, [("a",), ("please FIX it",), (None,)], "t string", S.looks_edit_bound(F.col("t"))) == [False, True, False]


def test_complexity_and_effective_k(spark):
    text = "what is foo_bar and baz_qux? why or how; `x`"
    score = S.complexity(F.col("t"), F.lit(True))
    got = spark.createDataFrame([(text,), ("",)], "t string").select(score.alias("s"), S.effective_k(5, score, 0.5, 20).alias("k"), S.effective_k(5, score, 0.5, 3).alias("low")).collect()
    assert got[0]["s"] == pytest.approx(0.4 * 11 / 64 + 0.25 + 0.15 + 0.2) and got[0]["k"] == 6 and got[0]["low"] == 5
    assert got[1]["s"] == pytest.approx(0.4 / 64 + 0.15)


def test_targets(spark):
    pairs = [("/repo/src/myapp.py", "app.py"), ("src/app.py", "/repo/src/app.py"), ("/a/x", "/b/a/x"), ("a", "a")]
    assert [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(S.same_target(F.col("a"), F.col("b"))).collect()] == [False, True, False, True]
    got = [r[0] for r in spark.createDataFrame([("see myapp.py", "app.py"), ("see app.py, ok", "app.py"), ("éapp.py", "app.py")], "t string, b string").select(S.mentions(F.col("t"), F.col("b"))).collect()]
    assert got == [False, True, False]
    assert values(spark, [("src/a.py",), ("src/a.md",), ("lib/a.py",)], "p string", S.is_code_target(F.col("p"))) == [True, False, False]
    assert values(spark, [("a",), ("/r/x",), ("/rx",), (None,)], "p string", S.in_project(F.col("p"), "/r")) == [True, True, False, False]
    assert values(spark, [("src/User_auth-token.py",), ("pkg/utils.py",), ("a/b/c/d_e_f_g.py",), ("api/main.py",)], "p string", S.derive_query(F.col("p"))) == ["user auth token", "pkg utils", "d e f", "main"]


def test_predicate(spark):
    rows = [(1, "en", ["src", "src/a"], None, {"k": "v"}), (2, "de", ["lib"], datetime(2024, 1, 1), {}), (3, "en", ["srcx"], datetime(2030, 1, 1), {"k": "w"})]
    df = spark.createDataFrame(rows, "id int, room string, path_prefixes array<string>, valid_to timestamp, extra map<string,string>")

    def ids(where, **kw):
        p = predicates.predicate(where, df, now="2024-06-01", **kw)
        return [r["id"] for r in (df if p is None else df.where(p)).orderBy("id").collect()]

    where = {"valid_to": "now", "path_prefix": "src"}
    assert ids(where) == [1] and where == {"valid_to": "now", "path_prefix": "src"}
    assert ids({}) == [1, 3] and ids(None, temporal=False) == [1, 2, 3]
    assert ids({"room": ["en", "de"], "k": "w"}) == [3] and ids({"path_prefix": ["lib", "src"]}, temporal=False) == [1, 2]
    with pytest.raises(ValueError):
        predicates.predicate({"valid_to": "2024"}, df)
    assert predicates.predicate(None, df, temporal=False) is None
