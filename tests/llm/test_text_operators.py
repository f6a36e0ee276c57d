"""Token, copy, PII and near-copy operators against brute force, with the edge cases each docstring defines."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from memlake.llm import bpe, exact_dedup, orc_tokens, parity_join, pii
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, key string, norm string, n int, a long, b long, sha string"

random.seed(5)
WORDS = ["the", "of", "Erst", "ñandú", "über", "d'été", "x1", "###", "it's", "日本", "😀"]


def sentence(n, rng=random):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))


BASE = sentence(60)
TEXTS = {
    1: BASE, 2: BASE, 3: BASE.replace(" ", "\n\t "), 4: BASE + " end", 5: None, 6: "", 7: " \n\x0b", 8: "one", 9: "ONE", 10: "one two", 11: sentence(3000), 12: sentence(5),
    13: "a" * 5000, 14: "a b  c\n\n d \x85 e f", 15: sentence(200), 16: BASE.upper(), 17: "1 2 3 4 5",
}


def frame(spark, texts):
    return spark.createDataFrame([(d, t, None, "s", "k", "n", 1, 2, 3, "x") for d, t in texts.items()], SCHEMA)


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_exact_dedup(spark):
    got = rows(exact_dedup.exact_dedup(frame(spark, TEXTS)))
    norm = {d: re.sub(r"[\x20\x09-\x0D]", "", t or "") for d, t in TEXTS.items()}
    for d, t in TEXTS.items():
        group = [x for x in TEXTS if norm[x] == norm[d]]
        keep = min(group, key=lambda x: (-len(TEXTS[x] or ""), x))
        assert got[d] == {"doc_id": d, "keep_id": keep, "group_size": len(group), "kept": keep == d, "text_sha256": hashlib.sha256(norm[d].encode()).hexdigest()}, t


def test_exact_dedup_hot_group_and_null_id(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 20)
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    df = df.unionByName(spark.createDataFrame([(None, "same"), (None, "longer text"), (-5, "s a m e")], "doc_id long, text string"))
    got = exact_dedup.exact_dedup(df, salts=4).collect()
    same = [r for r in got if r["text_sha256"] == hashlib.sha256(b"same").hexdigest()]
    assert len(got) == 103 and len(same) == 52 and {(r["keep_id"], r["group_size"]) for r in same} == {(-5, 52)} and sum(r["kept"] for r in same) == 1
    alone = [r for r in got if r["doc_id"] is None and r["group_size"] == 1]
    assert [(r["keep_id"], r["kept"]) for r in alone] == [(None, True)]


@pytest.mark.parametrize("hot_rows", [1000, 3])
def test_exact_dedup_tells_contents_of_one_digest_apart(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot_rows)
    texts = {i: ["x y", "xy ", "z", "", "q" * 9][i % 5] for i in range(40)}
    got = rows(exact_dedup.exact_dedup(frame(spark, texts).repartition(3), salts=2, digest=lambda norm: F.when(norm == "z", F.lit(b"1")).otherwise(F.lit(b"2"))))
    norm = {d: t.replace(" ", "") for d, t in texts.items()}
    for d in texts:
        group = [x for x in texts if norm[x] == norm[d]]
        assert (got[d]["keep_id"], got[d]["group_size"]) == (min(group, key=lambda x: (-len(texts[x]), x)), len(group)), d


def test_orc_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = TEXTS | {30: "x <|endoftext|> y", 31: "<|endoftext|>"}
    out = str(tmp_path / "orc")
    orc_tokens.write_tokens(frame(spark, texts), out, path)
    got = rows(orc_tokens.token_index(spark, out))
    assert got[31]["n_tokens"] == 2 and got[30]["n_tokens"] == 5
    start = 0
    for d in sorted(texts):
        ids = tok.encode(texts[d] or "", add_special_tokens=False).ids + [2]
        assert got[d] == {"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)
    assert [r["ids"] for r in orc_tokens.read_tokens(spark, out, [8]).collect()] == [tok.encode("one").ids + [2]]


@pytest.mark.parametrize("special", [False, True])
def test_unit_encoder_matches_library(special):
    enc = orc_tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), special)
    rng = random.Random(3)
    parts = list("abz  éñ\n\t  '.,!?|0129²Ⅷ_-  日😀İ\x1c\x85é") + ["'s", " the", " don't", "<|endoftext|>", "é"]
    assert enc.plain
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert list(np.frombuffer(enc(x), "<u4")) == enc.tok.encode(x, add_special_tokens=False).ids, repr(x)


def test_other_tokenizer_files_go_through_the_library():
    enc = orc_tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not enc.plain
    for x in ("Hello there, World", "a  b<|endoftext|>c", ""):
        assert list(np.frombuffer(enc(x), "<u4")) == enc.tok.encode(x, add_special_tokens=False).ids


def test_orc_files_hold_stripes_indexes_and_bloom_filters(spark, tmp_path):
    """The file's own metadata: run-length encoded integers, a row index a stride, Bloom filters; a pushed-down id reads few rows."""
    out = str(tmp_path / "orc")
    df = spark.range(60_000).select((F.col("id") * 2).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        orc_tokens.write_tokens(df, out, public_tokenizers.path("byte_bpe_50k.json"), stripe_mb=1, stride=1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    (name,) = [f"{out}/{x}" for x in __import__("os").listdir(out) if x.endswith(".orc")]
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getStripes().size() > 1 and reader.getRowIndexStride() == 1000 and reader.getNumberOfRows() == 60_000
    kinds, encodings = set(), set()
    records = reader.rows()
    for i in range(reader.getStripes().size()):
        footer = records.readStripeFooter(reader.getStripes().get(i))
        for j in range(footer.getStreamsCount()):
            kinds.add((footer.getStreams(j).getColumn(), str(footer.getStreams(j).getKind())))
        encodings |= {(j, str(footer.getColumns(j).getKind())) for j in range(footer.getColumnsCount())}
    assert (1, "ROW_INDEX") in kinds and any(c == 1 and k.startswith("BLOOM_FILTER") for c, k in kinds) and {(1, "DIRECT_V2"), (2, "DIRECT_V2"), (3, "DIRECT_V2")} <= encodings
    for ids, want in (([777], 0), ([778], 1)):  # 777 lies in the range but not in the table: only its Bloom filter can tell
        found = orc_tokens.read_tokens(spark, out, ids)
        assert found.count() == want
        plan = found._jdf.queryExecution().executedPlan()
        found._jdf.queryExecution().toRdd().count()
        leaves = plan.collectLeaves()
        read = leaves.apply(0).metrics().apply("numOutputRows").value()
        assert read <= 4000, (ids, read)


@pytest.mark.parametrize("chunk,overlap", [(40, 12), (7, 3), (1000, 100)])
def test_bpe(spark, chunk, overlap):
    texts = TEXTS | {20: TEXTS[11], 21: "a" * 300 + " b" + " " * 200 + "c"}
    got = rows(bpe.bpe_encode(frame(spark, texts), RANKS, PATTERN, chunk=chunk, overlap=overlap))
    for d, t in texts.items():
        ids = bpe._encoding(RANKS, PATTERN).encode_ordinary(t or "")
        assert got[d]["n_tokens"] == len(ids), (d, t)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), d
        assert got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(8, 4), (16, 8), (30, 10), (64, 40)])
def test_cuts_split_as_the_whole_text_does(spark, chunk, overlap):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "bc", " ", "  ", "\n", "'s", "'l", "l", ".", "12", "é", "a" * 30, " " * 20]) for _ in range(rng.randint(0, 200))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    some = 0
    for r in bpe.cut_places(df, PATTERN, chunk, overlap).collect():
        text, cuts = texts[r["key"]], [0, *r["cuts"]]
        assert cuts == sorted(set(cuts)) and set(cuts) <= {0, *bpe.boundaries(text, PATTERN)}, text
        pieces = [text[a:z] for a, z in zip(cuts, [*cuts[1:], len(text)], strict=True)]
        assert [t for p in pieces for t in bpe.regex.findall(PATTERN, p)] == bpe.regex.findall(PATTERN, text)
        some += len(cuts) > 2
    assert some > 5  # the texts are really cut; short overlaps end most chains early


def test_long_texts_null_and_repeated_ids(spark):
    words = [sentence(9_000, random.Random(i)) for i in range(2)]
    texts = [(None, words[0]), (None, words[0]), ("a", words[1]), ("a", "x" * 50_000 + " " + words[1]), ("b", None), ("b", "short")]
    df = spark.createDataFrame([(i, t, 1, "k", [2]) for i, t in texts], "id string, text string, key int, at string, cuts array<int>")
    got = bpe.bpe_encode(df, RANKS, PATTERN, id_col="id", keep_ids=True).collect()
    want = sorted((i or "", bpe._encoding(RANKS, PATTERN).encode_ordinary(t or "")) for i, t in texts)
    assert sorted((r["id"] or "", list(r["ids"])) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


@pytest.mark.parametrize("limit,small", [(500_000, False), (0, False), (500_000, True)])
def test_parity_join(spark, monkeypatch, limit, small):
    monkeypatch.setattr(parity_join, "BROADCAST_IDS", limit)
    if small:  # groups in pairs of blocks, centres given out several times, texts hashed in segments
        for name, value in {"GROUP": 3, "ROWS": 2, "STAR": 2, "HOT_SHARE": 0.0, "LARGE": 1, "SEGMENT": 64}.items():
            monkeypatch.setattr(parity_join, name, value)
    texts = dict(TEXTS)
    rng = random.Random(2)
    for g in range(6):  # groups of near copies, some of which only their base links
        words = sentence(120, rng).split()
        for i in range(12):
            own = list(words)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = f"new{rng.random()}"
            texts[1000 * (g + 1) + i] = " ".join(own)
    for width, num in ((3, 90), (5, 80)):
        got = rows(parity_join.parity_join(frame(spark, texts), width, num, 100))
        want = parity_join.brute_force(texts, width, num, 100)
        assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
        assert len({c for _, c in want.values()}) < len(want)


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    text = " ".join(["a" * 700, "bc", "d" * 64, "e" * 65, *TEXTS[11].split()])
    whole = parity_join.shingle_hashes(text, 3)
    for n in (16, 64, 1000):
        monkeypatch.setattr(parity_join, "SEGMENT", n)
        assert (parity_join.shingle_hashes(text, 3) == whole).all()


def test_parity_join_of_repeated_ids(spark):
    """An id with two texts links wherever one of them does."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(80)) for w in "abc")
    rows_ = [(1, a), (2, a + " end"), (5, a + " fin"), (5, b), (7, b + " end"), (9, c), (9, None), (9, c), (4, c + " x")]
    got = parity_join.parity_join(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 78, 1), (2, 79, 1), (4, 79, 4), (5, 78, 1), (5, 79, 1), (7, 79, 1), (9, 0, 9), (9, 78, 4), (9, 78, 4)]


def test_sketch_distance_bounds_difference():
    rng = np.random.default_rng(1)
    for n in (12, 150, 900):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[n // 20 :], rng.integers(0, 2**63, n // 25).astype(np.uint64)])
        band = int(parity_join.band_of(min(len(a), len(b))))
        words, spare = parity_join.sketch_shape(band, 90, 100)
        full = np.zeros((2, words), np.uint64)
        for row, h in zip(full, (np.unique(a), np.unique(b)), strict=True):
            place, word = parity_join.sketch_words(h, band, 90, 100)
            row[place] = word
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        assert int((full[0] != full[1]).sum()) <= differ < words - spare
        assert set(parity_join.pair_words(np.unique(a), 90, 100).tolist()) & set(parity_join.pair_words(np.unique(b), 90, 100).tolist())


def test_wide_sketches_lose_no_link():
    """Sketches of one size or two never differ in more than the sets, and strangers of many shingles are told apart by the wide ones only."""
    rng = np.random.default_rng(3)
    for n in (1, 8, 9, 1_000, 1_024, 1_025, 2_040, 2_060, 30_000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: -(-len(a) * 9 // 10)], rng.integers(0, 2**63, n // 12).astype(np.uint64)]))
        wide = [parity_join.fold_of(h, parity_join.fold_bits(len(h))) for h in (a, b)]
        assert len(wide[0]) * 8 >= len(a)
        differ = len(np.setxor1d(a, b))
        assert parity_join._differ(*wide) <= differ
        assert parity_join._differ(parity_join.fold_of(a, parity_join.FOLD), parity_join.fold_of(b, 4 * parity_join.FOLD)) <= differ
    stranger = np.unique(rng.integers(0, 2**63, 30_000).astype(np.uint64))
    allowed = (len(a) + len(stranger)) * 20 // 180
    assert parity_join._differ(*(parity_join.fold_of(h, parity_join.FOLD) for h in (a, stranger))) <= allowed
    assert parity_join._differ(*(parity_join.fold_of(h, parity_join.fold_bits(30_000)) for h in (a, stranger))) > allowed


def test_pii(spark):
    texts = {
        1: "mail é me.x+1@mail4.example.com, or a@b.c_d@e.fg! call +1 (509) 555-6973.", 2: "ip 10.0.0.256 192.168.001.7.9 1.2.3.4.5.6.7.8", 3: "card 4111 1111 1111 1111 or 4111111111111112 and 378282246310005",
        4: None, 5: "", 6: "my iban: GB82 WEST 1234 5698 7654 32, ssn 123-45-6789; but this number, which is nothing of the kind: 123-45-6789", 7: "+12 34", 8: "9" * 20000 + " " + "a." * 9000 + "x@" + "y." * 5000, 9: "x@@y.z +1+1 555 5555 55 55",
    }
    got = rows(pii.pii_digest(pii.find_pii(frame(spark, texts))))
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        digits = [int(c) for c in m if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "phone":
            return 8 <= len(digits) <= 15
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0
        return True

    for d, t in texts.items():
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, t or "") if ok(k, m[0])] if d != 8 else []
        if d != 8:
            assert got[d]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (d, base, got[d])
            assert got[d]["spans"].startswith(",".join(base))
    assert got[6]["spans"] == "iban:9:36,ssn:42:53" and got[8]["n_email"] == 1


def test_pii_running_sums(spark):
    df = spark.createDataFrame([(n, [(i * 7) % 11 for i in range(n)]) for n in (1, 2, 3, 8, 9, 10, 101)], "n int, x array<int>")
    for r in df.select("x", F.transform(F.array("x"), pii.running)[0].alias("y")).collect():
        assert r["y"] == np.cumsum(r["x"]).tolist()


def test_pii_many_spans_in_one_text(spark):
    """Places and context right throughout a long text of many spans, in a time far from quadratic."""
    import time

    one = "é😀 write to a.b@c.de now; 1.2.3.4 " + "x" * 31 + " "
    text = one * 20_000
    pii.pii_digest(pii.find_pii(frame(spark, {1: one}))).collect()
    began = time.time()
    got = pii.find_pii(frame(spark, {1: text})).first()["spans"]
    took = time.time() - began
    mail = [(x["s"], x["e"], x["score"]) for x in got if x["kind"] == "email"]
    assert mail == [(i * len(one) + 12, i * len(one) + 20, 95) for i in range(20_000)]
    assert [(x["s"], x["e"]) for x in got if x["kind"] == "ip"] == [(i * len(one) + 26, i * len(one) + 33) for i in range(20_000)]
    assert took < 20, took


@pytest.mark.parametrize("run", [
    lambda df: exact_dedup.exact_dedup(df), lambda df: parity_join.parity_join(df), lambda df: pii.pii_digest(pii.find_pii(df)),
    lambda df: bpe.bpe_encode(df, RANKS, PATTERN), lambda df: orc_tokens.encode_to_orc(df, public_tokenizers.path("byte_bpe_50k.json")),
])
def test_empty_table_and_repeated_rows(spark, run):
    df = frame(spark, {1: "some text here", 2: None})
    assert run(df.limit(0)).count() == 0
    twice = run(df.unionByName(df))
    assert twice.count() == 4 and twice.distinct().count() <= 4
    assert run(df.withColumn("doc_id", F.lit(None).cast("long"))).count() == 2
