import pytest
from memlake.functions import predicates
from memlake.operators import filters, retrieval
from pyspark.sql import functions as F

POINTS = "id long, room string, file_path string, path_prefixes array<string>, extra map<string,string>, valid_to timestamp, text string, vec array<double>"
ROWS = [
    (1, "en", "src/a/x.py", ["src", "src/a", "src/a/x.py"], {"lang": "py"}, None, "red fox", [1.0, 0.0]),
    (2, "de", "src/b.md", ["src", "src/b.md"], {}, None, "red red fox runs", [0.9, 0.1]),
    (3, None, "docs/c.md", ["docs", "docs/c.md"], None, None, "fox", [0.0, 1.0]),
    (4, "en", "docs/d.md", ["docs", "docs/d.md"], {"lang": "md"}, "2024-01-10", "a red hen", [1.0, 1.0]),
]
WHERES = [None, {}, {"room": ["en"]}, {"room": ["en", "de", "en"]}, {"room": ["en"], "path_prefix": ["docs"]}, {"path_prefixes": ["src", "docs"]}, {"lang": ["py"]}, {"room": []}, {"nowhere": ["x"]}, {"valid_to": ["now"], "room": ["de"]}]
NOWS = ["2024-01-05", "2024-02-01"]


@pytest.fixture(scope="module")
def points(spark):
    rows = spark.createDataFrame([(*r[:5], None, *r[6:]) for r in ROWS], POINTS)
    ends = F.when(F.col("id") == 4, F.lit("2024-01-10").cast("timestamp"))
    return rows.withColumn("valid_to", ends)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(i * 10 + j, w, n) for i, w in enumerate(WHERES) for j, n in enumerate(NOWS)]
    q = spark.createDataFrame(rows, f"qid long, where {filters.WHERE}, now string")
    return q.withColumns({"text": F.lit("red fox hen"), "vec": F.array(F.lit(1.0), F.lit(0.5))})


def alone(points, where, now):
    """The points that one query's filter leaves, by the filter of a whole batch."""
    kept = {k: v for k, v in (where or {}).items() if k != "valid_to"}
    named = points if "nowhere" not in kept else points.withColumn("nowhere", F.lit(None).cast("string"))
    if any(v == [] for v in kept.values()):
        return points.where("false")
    return named.where(predicates.predicate(kept, named, now=now))


def test_rules_are_shared(spark, queries):
    q, rules = filters.rules_of(queries, "2024-01-05")
    assert rules.count() == 2 * 9  # null and {} are one
    same = {r["qid"]: r["rule"] for r in q.collect()}
    assert same[0] == same[10] and same[0] != same[1] and len(same) == 20


def test_every_query_sees_what_its_filter_leaves(points, queries):
    q, rules = filters.rules_of(queries, "2024-01-05")
    admits = {r["id"]: set(r["rules"]) for r in filters.admitted(points, rules).collect()}
    for r in q.select("qid", "rule").collect():
        want = {p["id"] for p in alone(points, WHERES[r["qid"] // 10], NOWS[r["qid"] % 10]).collect()}
        assert {i for i, of in admits.items() if r["rule"] in of} == want, r


def test_arms_by_rule_are_those_of_a_corpus_of_its_own(points, queries):
    q, rules = filters.rules_of(queries, "2024-01-05")
    kept = points.join(filters.admitted(points, rules), "id")
    sparse = retrieval.bm25_by_rule(kept, q, 2).collect()
    dense = retrieval.dense_topk(kept, q, 2).collect()
    for qid, where, now in [(i * 10 + j, w, n) for i, w in enumerate(WHERES) for j, n in enumerate(NOWS)]:
        own, one = alone(points, where, now), queries.where(F.col("qid") == qid)
        for got, want in ((sparse, retrieval.bm25_topk(own, one, 2)), (dense, retrieval.dense_topk(own, one, 2))):
            assert sorted(tuple(r) for r in got if r["qid"] == qid) == sorted(map(tuple, want.collect()))


def test_only_now_is_a_value_of_valid_to(spark, points):
    q = spark.createDataFrame([(1, {"valid_to": ["2024-01-01"]})], f"qid long, where {filters.WHERE}")
    with pytest.raises(Exception, match="valid_to takes only"):
        filters.rules_of(q, "2024-01-05")


def test_empty_points_and_queries(spark, points, queries):
    q, rules = filters.rules_of(queries.limit(0), "2024-01-05")
    assert q.count() == 0 and filters.admitted(points, rules).count() == 0
    assert filters.admitted(points.limit(0), filters.rules_of(queries, "2024-01-05")[1]).count() == 0
