import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from memlake.llm import packing, queries, whitening
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def expected_pieces(docs):
    """(doc_id, start, length, crc, doc_tokens) by the library and the bits of each length."""
    tok, out = Tokenizer.from_file(TOKENIZER), []
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at, rest = 0, len(ids)
        while rest:
            n = min(2048, 1 << (rest.bit_length() - 1))
            out.append((doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at, rest = at + n, rest - n
    return Counter(out)


def test_binary_lengths():
    assert packing.binary_lengths(1) == [1]
    assert packing.binary_lengths(2048) == [2048]
    assert packing.binary_lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    for n in range(1, 5000, 37):
        assert sum(packing.binary_lengths(n)) == n


def test_packing_against_the_library(spark):
    docs = [(1, "a few words"), (2, None), (3, ""), (None, "no id"), (4, "same text here"), (4, "same text here"), (5, "long words of text. " * 9_000), (6, "é\U0001f600 \x00 x" * 50), (7, "<|endoftext|> in a text")]
    df = spark.createDataFrame([(i, t, "x", 3, 4, "y") for i, t in docs], "doc_id long, text string, ids string, bucket int, sequence_id int, file string")
    rows = packing.pack_documents(df, TOKENIZER).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == expected_pieces(docs)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 for r in rows)
    by_number = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert by_number == sorted(by_number)


def test_written_sequences_hold_the_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta " * 300)], "doc_id long, text string")
    path = packing.write_pieces(df, str(tmp_path / "packed"), TOKENIZER)
    back = {}
    for r in packing.read_sequences(spark, path).orderBy("doc_id", "start").collect():
        assert len(r["ids"]) == 2 << r["bucket"]
        back.setdefault(r["doc_id"], []).extend(packing.token_ids(bytes(r["ids"]), 1 << r["bucket"]).tolist())
    tok = Tokenizer.from_file(TOKENIZER)
    assert all(tok.decode(back[i][:-1]) == t and back[i][-1] == 1 for i, t in ((1, "alpha beta gamma"), (2, "delta " * 300)))


def test_packing_empty_table_and_bad_length(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.write_pieces(none, str(tmp_path / "x"), TOKENIZER, most=1000)


def test_packing_query_on_its_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op11_binary_packing(spark, sf).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == expected_pieces(docs)


def test_error_free_steps():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=500) * 10.0 ** rng.integers(-8, 8, 500), rng.normal(size=500)
    for f, exact in ((whitening.two_sum, lambda x, y: x + y), (whitening.two_product, lambda x, y: x * y)):
        high, low = f(a, b)
        assert all(Fraction(h) + Fraction(w) == exact(Fraction(x), Fraction(y)) for h, w, x, y in zip(high, low, a, b, strict=True))
    high, low = whitening.dd_ratio(10**18 + 7, 51_282)
    assert abs(Fraction(high) + Fraction(low) - Fraction(10**18 + 7, 51_282)) < Fraction(1, 10**17)


def exact_covariance(x):
    """The covariance with divisor n in exact fractions."""
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    return [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n for j in range(d)] for i in range(d)]


def test_covariance_keeps_twice_a_doubles_digits(spark):
    rng = np.random.default_rng(2)
    x = (10**15 + rng.integers(-50, 50, (203, 5))).tolist()  # deviations of a 10^13th of the mean
    df = spark.createDataFrame([(r,) for r in x], "x array<long>").repartition(7)
    model = whitening.fit_whitening(df)
    high, low = whitening.outer_sum(df, 5, model.centred)
    exact = exact_covariance(x)
    for i in range(5):
        for j in range(5):
            got = (Fraction(high[i, j]) + Fraction(low[i, j])) / 203
            assert abs(got - exact[i][j]) <= abs(exact[i][i]) * Fraction(1, 10**27)
    assert np.allclose(model.axes.T @ model.axes, np.eye(5), atol=1e-14)


def check_whitened(rows, table, most):
    """Rows of the operator against a plain covariance of exact fractions, with numpy's general eigenvectors."""
    ids, x = [i for i, _ in table], [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in table]
    n, d = len(x), len(x[0])
    cov = np.array([[float(c) for c in r] for r in exact_covariance(x)])
    values, axes = np.linalg.eig(cov)
    order = np.argsort(-values.real)
    values, axes = values.real[order], axes.real[:, order]
    sums = [sum(r[i] for r in x) for i in range(d)]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(r, sums, strict=True)] for r in x])
    want = centred @ axes / np.sqrt(values)
    assert len(rows) == n * min(most, d)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    for c in range(min(most, d)):
        mine = np.array([got[i, c + 1]["whitened"] for i in ids])
        assert min(np.abs(mine - want[:, c]).max(), np.abs(mine + want[:, c]).max()) < 1e-7
        assert abs(got[ids[0], c + 1]["explained"] - values[c] / values.sum()) < 1e-12
    for i, r in zip(ids, x, strict=True):
        assert got[i, 1]["deviation"] == sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True))
        assert got[i, 1]["n"] == n and got[i, 1]["identity_error"] < 1e-9


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.normal(size=6) * np.array([9, 5, 3, 2, 1, 0.5])).tolist()) for i in range(90)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in good + bad], "vec_id long, embedding array<double>, n int, x double").repartition(5)
    check_whitened(whitening.whiten(df, most=4).collect(), good, 4)


def test_whitening_query_on_its_table(spark, sf):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitened(queries.op12_compensated_whitening(spark, sf).collect(), table, 32)


def test_whitening_without_variance_ids_or_rows(spark):
    kind = "vec_id string, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), ("a", [1.0, 2.0]), ("a", [1.0, 2.0])], kind)).collect()
    assert len(one) == 6 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in one)
    flat = whitening.whiten(spark.createDataFrame([(str(i), [float(i), 0.0]) for i in range(9)], kind)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    assert flat[0]["identity_error"] < 1e-12
    huge = whitening.whiten(spark.createDataFrame([("a", [1e38, 1.0]), ("b", [-1e38, 2.0]), ("c", [0.0, 3.0])], kind)).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge if r["vec_id"] in "ab")


def test_fixed_point_floors_and_saturates(spark):
    got = spark.createDataFrame([([0.0, -0.001, 0.5, 1e300, -1e300],)], "v array<double>").select(whitening.fixed_point(F.col("v")).alias("x")).first()["x"]
    assert got == [1_000_000, 999_999, 1_000_032, 2**52 + 1_000_000, -(2**52) + 1_000_000]
