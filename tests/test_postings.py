import os
import re

import pytest
from memlake.operators import retrieval
from memlake.operators.postings import Postings, counted
from pyspark.sql import functions as F

QUERIES = [(1, "red fox"), (2, "blue whale deep"), (3, "nothing here"), (4, None), (5, "Fox FOX red")]
FIRST = {1: "red fox runs", 2: "blue sky blue", 3: "a fox, a red fox", 4: None, 5: "", 6: "whale song deep blue"}


def asked(spark):
    return spark.createDataFrame(QUERIES, "qid long, text string")


def docs(spark, texts, kind="long"):
    return spark.createDataFrame(list(texts.items()), f"id {kind}, text string")


def expected(spark, texts, kind="long"):
    return sorted(map(tuple, retrieval.bm25_topk(docs(spark, texts, kind), asked(spark)).collect()))


def found(index, spark):
    return sorted(map(tuple, index.search(asked(spark)).collect()))


def test_batches_give_what_the_current_texts_give(spark, tmp_path):
    index, now = Postings(spark, str(tmp_path / "p"), parts=3), dict(FIRST)
    index.write(docs(spark, now), 0)
    assert found(index, spark) == expected(spark, now)
    change = {2: "red red whale", 4: "a late fox", 7: "deep red"}
    index.write(docs(spark, change), 1, removed=docs(spark, {3: "", 99: ""}))
    now |= change
    del now[3]
    assert found(index, spark) == expected(spark, now)
    index.write(docs(spark, {3: "back again, red fox", 2: "gone blue"}), 2)
    now |= {3: "back again, red fox", 2: "gone blue"}
    assert found(index, spark) == expected(spark, now)
    index.write(docs(spark, {}), 3, removed=docs(spark, dict.fromkeys(now, "")))
    assert found(index, spark) == []


def test_a_batch_written_again_changes_nothing(spark, tmp_path):
    index, change = Postings(spark, str(tmp_path / "p")), {1: "blue fox", 6: "whale"}
    index.write(docs(spark, FIRST), 0)
    index.write(docs(spark, change), 1)
    before = found(index, spark)
    index.write(docs(spark, change), 1)
    assert found(index, spark) == before == expected(spark, FIRST | change)


def test_an_unfinished_batch_is_passed_over(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "p"))
    index.write(docs(spark, FIRST), 0)
    index.write(docs(spark, {1: "entirely other"}), 1)
    os.rename(tmp_path / "p/documents/batch=1", tmp_path / "p/hidden")
    assert index.batches() == [0] and found(index, spark) == expected(spark, FIRST)


def test_text_ids_and_an_empty_index(spark, tmp_path):
    index, texts = Postings(spark, str(tmp_path / "p"), "string"), {"b": "red fox", "a": "red fox", None: "red"}
    assert found(index, spark) == []
    index.write(docs(spark, texts, "string"), 0)
    assert [r[:2] for r in found(index, spark)] == [(1, "a"), (1, "b"), (5, "a"), (5, "b")]


def test_only_folders_of_the_terms_are_read(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "p"), parts=64)
    index.write(docs(spark, {i: f"word{i} common" for i in range(300)}), 0)
    one = index.search(spark.createDataFrame([(1, "word7")], "qid long, text string"))
    assert [r["id"] for r in one.collect()] == [7]
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert spark.read.parquet(f"{index.root}/postings").select("part").distinct().count() > 30
    assert re.search(r"part#\d+ (=|IN|INSET) ", plan)  # a condition on the folders alone


def test_search_takes_the_stored_arm(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "p"))
    index.write(docs(spark, FIRST), 0)
    points = docs(spark, FIRST).withColumns({"vec": F.array(F.lit(1.0), F.col("id").cast("double")), "content_hash": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp"), "valid_from": F.lit(None).cast("timestamp"), "chunker": F.lit("markdown")})
    q = asked(spark).where("text is not null").withColumn("vec", F.array(F.lit(1.0), F.lit(2.0)))
    run = lambda **how: sorted((r["qid"], r["id"], r["score"]) for r in retrieval.search(points, q, now="2024-01-01", **how).collect())
    assert run(sparse=index.search) == run()


@pytest.mark.parametrize("text", ["", "  "])
def test_queries_without_words(spark, tmp_path, text):
    index = Postings(spark, str(tmp_path / "p"))
    index.write(docs(spark, FIRST), 0)
    assert index.search(spark.createDataFrame([(1, text)], "qid long, text string")).count() == 0


def test_words_are_counted_in_their_row(spark):
    words = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, ["x"])], "id long, w array<string>")
    rows = {(r["id"], r["term"], r["tf"], r["dl"]) for r in counted(words).collect()}
    assert rows == {(1, None, None, 4), (1, "a", 1, 4), (1, "b", 3, 4), (2, None, None, 0), (3, None, None, 1), (3, "x", 1, 1)}
