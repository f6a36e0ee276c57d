import numpy as np
import pytest
from memlake.operators import retrieval
from memlake.operators.cells import Cells, choose_centres
from pyspark.sql import functions as F


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, v.tolist(), "even" if i % 2 == 0 else "odd") for i, v in enumerate(x)], "id long, vec array<double>, kind string")


def clustered(rng, groups=20, each=40, dims=16):
    mids = rng.normal(size=(groups, dims))
    return (mids[:, None, :] + 0.15 * rng.normal(size=(groups, each, dims))).reshape(-1, dims)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def data():
    return clustered(np.random.default_rng(5))


def test_exact_and_reads_few_cells(spark, tmp_path, data):
    v = table(spark, data)
    index = Cells(spark, str(tmp_path / "c"))
    index.make(v, 32)
    index.write(v, 0)
    q = v.where("id % 37 = 0").select(F.col("id").alias("qid"), "vec")
    assert rows(index.search(q, 10)) == rows(retrieval.dense_topk(v, q, 10))
    assert index.read < 0.25 * index.pairs
    kept = v.where("kind = 'odd'")
    assert rows(index.search(q, 10, where=F.col("kind") == "odd")) == rows(retrieval.dense_topk(kept, q, 10))
    assert rows(index.search(q, 2000)) == rows(retrieval.dense_topk(v, q, 2000))  # more than there are


def test_batches(spark, tmp_path, data):
    index, (one, two) = Cells(spark, str(tmp_path / "c")), (table(spark, data[:500]), table(spark, -data[500:], 500))
    index.make(one, 8)
    index.write(one, 0)
    index.write(two, 1)
    index.write(two, 1)  # once more
    v = one.unionByName(two)
    q = v.where("id % 90 = 0").select(F.col("id").alias("qid"), "vec")
    assert rows(index.search(q, 7)) == rows(retrieval.dense_topk(v, q, 7))


def test_scattered_ties_zero_and_null_vectors(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(90, 8)), np.ones((15, 8)), np.zeros((3, 8))])
    v = table(spark, x).unionByName(spark.createDataFrame([(999, None, "odd")], "id long, vec array<double>, kind string"))
    index = Cells(spark, str(tmp_path / "c"))
    index.make(v, 6)
    index.write(v, 0)
    q = spark.createDataFrame([(1, [1.0] * 8), (2, [0.0] * 8), (3, x[0].tolist()), (4, None)], "qid long, vec array<double>")
    assert rows(index.search(q, 9)) == rows(retrieval.dense_topk(v, q.where("vec is not null"), 9))


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vec array<double>, kind string")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "qid long, vec array<double>")
    index = Cells(spark, str(tmp_path / "c"))
    assert index.search(q).count() == 0
    index.make(none)
    index.write(none, 0)
    assert index.search(q).count() == 0


def test_centres_are_units():
    c = choose_centres(np.eye(4), 9)
    assert len(c) == 4 and np.allclose(np.linalg.norm(c, axis=1), 1)
