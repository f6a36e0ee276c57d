"""Learned operators, vectors, mixtures, pages and the pipeline."""

import random

import numpy as np
import pandas as pd
import pytest
from memlake.llm import language_gru, mixing, pu_quality, queries, site_tree, vector_graph
from memlake.llm.common import components
from pyspark.sql import functions as F


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_gru_gradients():
    rng = np.random.default_rng(0)
    m = language_gru.new_model(["a", "b"], hidden=3, seed=1)
    for name in ("table", "inner"):
        setattr(m, name, [a.astype(np.float64) for a in getattr(m, name)])
    x, y = rng.integers(1, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, grads = language_gru.loss_and_gradients(m, x, y)
    for a, g in zip(m.arrays(), grads, strict=True):
        for at in [tuple(rng.integers(0, n) for n in a.shape) for _ in range(6)]:
            at = (at[0], int(rng.integers(1, 5))) if a.shape[1] == 256 else at
            old, e = a[at], 1e-2
            a[at] = old + e
            up = language_gru.loss_and_gradients(m, x, y)[0]
            a[at] = old - e
            down = language_gru.loss_and_gradients(m, x, y)[0]
            a[at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 2e-3


def test_language_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = queries.op4_language_gru(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[0] > 0.95 and got[1] > 100


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (None, "the of and", None), (5, "der die und " * 9000, "de"), (5, "der die und " * 9000, "de"), (6, "the of and that", "en")], "doc_id long, text string, lang string")
    model = language_gru.fit_language(df.withColumn("lang_pred", F.lit("zz")), rounds=60)
    got = language_gru.score_language(df, model).collect()
    assert [(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1, 2, 3)] == [("und", 0.0)] * 3
    assert [r["lang_pred"] for r in got if r["doc_id"] == 5] == ["de", "de"] and len(got) == 7
    assert language_gru.fit_language(df.where("lang is null")) is None
    assert language_gru.score_language(df.limit(0), model).count() == 0
    kept = language_gru.keep_recognised(df, model, 0.4)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {None, 5, 6}


def test_quality_held_out(spark, sf):
    sf = sf.replace("0.001", "0.1")
    got = queries.op1_pu_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = got["score"].rank()
    pos = got["quality"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95 and (got["predicted"] == got["quality"]).mean() > 0.93


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_risk_gradients(shift):
    """Both branches of the non-negative risk against differences; the second is stepped upwards."""
    rng = np.random.default_rng(2)
    g, n, prior = np.concatenate([rng.normal(shift, 1, 7), rng.normal(-shift, 1, 9)]), 7, 0.4
    soft = lambda x: np.logaddexp(0, x).mean()
    rest = lambda g: soft(g[n:]) - prior * soft(g[:n])
    risk, step = pu_quality.risk_step(g, n, prior)
    assert (rest(g) >= 0) == (shift == 0.0) and np.isclose(risk, prior * soft(-g[:n]) + max(0, rest(g)))
    goal = (lambda g: prior * soft(-g[:n]) + rest(g)) if rest(g) >= 0 else (lambda g: -rest(g))
    eye = 1e-6 * np.eye(len(g))
    assert np.allclose(step, [(goal(g + e) - goal(g - e)) / 2e-6 for e in eye], atol=1e-7)


def test_quality_edges(spark):
    df = spark.createDataFrame([(i, f"text number {i} is here", 1) for i in range(40)] + [(None, "x", 1), (90, None, 1), (91, "", 1), (91, "", 1), (92, "very long " * 200_000, 1), (92, "very long " * 200_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = pu_quality.classify_quality(df, labels, rounds=40).collect()
    assert len(got) == 46 and all(0 <= r["score"] <= 1 for r in got)
    assert all(len({r["score"] for r in got if r["doc_id"] == i}) == 1 for i in (91, 92))
    assert {r["score"] for r in pu_quality.classify_quality(df, labels.limit(0)).collect()} == {0.5}
    assert pu_quality.classify_quality(df.limit(0), labels).count() == 0


def test_prior_estimate():
    rng = np.random.default_rng(4)
    p = rng.normal(0, 1, (1500, pu_quality.WIDTH)).astype(np.float32)
    u = np.concatenate([rng.normal(0, 1, (1400, pu_quality.WIDTH)), rng.normal(2, 1, (600, pu_quality.WIDTH))]).astype(np.float32)
    assert abs(pu_quality.estimate_prior(p, u, 400, 1) - 0.7) < 0.12


def _vectors(rng):
    x = rng.normal(size=(900, 16))
    x = np.concatenate([x, x[:60] + rng.normal(scale=0.08, size=(60, 16)), x[:5], np.repeat(x[5:6], 300, 0) + rng.normal(scale=0.06, size=(300, 16))])
    labels = rng.integers(0, 2, len(x))
    labels[900:960] = labels[:60]
    labels[960:965] = labels[:5]
    labels[965:] = labels[5]
    return x.astype(np.float32), labels


def test_vector_graph(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 300)
    x, labels = _vectors(np.random.default_rng(3))
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [1.0, None], 1), (5004, x[0].tolist(), None), (5005, [1.0], 1), (None, x[1].tolist(), 1), (5006, [float("inf")] * 16, 0), (5007, [], 0)]
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels, strict=True))] + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in vector_graph.near_duplicates(df.withColumns({"rep": F.lit(1), "links": F.lit(2), "id": F.lit(3)})).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(links, False)
    exact = links.sum(1)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= exact).all() and found.sum() >= 0.95 * exact.sum()
    comp = np.arange(len(x))
    while True:
        new = np.array([min([comp[i], *comp[links[i]]]) for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    assert np.mean([got[i]["component_id"] == comp[i] for i in range(len(x))]) > 0.98
    for i in (5000, 5001, 5002, 5003, 5004, 5005, 5006, 5007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert vector_graph.near_duplicates(df.limit(0)).count() == 0


def test_water_fill_and_allot():
    assert mixing.water_fill(10, [1, 1, 2], [1, 100, 100]) == pytest.approx([1, 3, 6])
    assert mixing.water_fill(10, [1, 0], [4, 100]) == pytest.approx([4, 6])
    have = {("a", "en", "s"): 10, ("a", "en", "t"): 100, ("a", "de", "s"): 1000, ("b", "en", "s"): 1000}
    got = mixing.allot(have, 400, {"a": 0.5, "b": 0.5}, {"a": {"en": 0.5, "de": 0.5}, "b": {"en": 1}}, {}, 1)
    # s falls short of 50 by 40, which its sibling t takes; nothing reaches de or b
    assert got == {("a", "en", "s"): 10, ("a", "en", "t"): 90, ("a", "de", "s"): 100, ("b", "en", "s"): 200}
    got = mixing.allot(have, 800, {"a": 0.5, "b": 0.5}, {"a": {"en": 0.5, "de": 0.5}, "b": {"en": 1}}, {}, 1)
    assert got == {("a", "en", "s"): 10, ("a", "en", "t"): 100, ("a", "de", "s"): 290, ("b", "en", "s"): 400}
    assert sum(mixing.allot(have, 10**6, {"a": 1}, {}, {}, 2).values()) == 2 * 2110


def test_mix_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(9001, None, None, None, 0), (9002, "", "en", "src0", 0), (9003, "x y z", "xx", "zzz", 5), (9003, "x y z", "xx", "zzz", 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    for share, epochs in ((0.3, 1), (0.75, 2), (1.6, 2)):
        got = mixing.mix(docs, queries.domain_of(F.col("source")), queries.DOMAINS, queries.LANGS, share=share, epochs=epochs, seed=3)
        assert got.columns == [*docs.columns, "mix_"]
        got = sorted((r["doc_id"], r["mix_"]["epoch"], r["mix_"]["take"]) for r in got.collect())
        rows = docs.select("doc_id", mixing.count_tokens(F.col("text")).alias("n"), queries.domain_of(F.col("source")).alias("d"), F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"), *(F.xxhash64(F.lit(3), F.lit(e).cast("long"), "doc_id").alias(f"h{e}") for e in range(3))).collect()
        leaves = {}
        for r in rows:
            leaves.setdefault((r["d"], r["l"], r["s"]), []).append(r)
        have = {k: sum(r["n"] for r in v) for k, v in leaves.items()}
        want = []
        for k, budget in mixing.allot(have, int(share * sum(have.values())), queries.DOMAINS, queries.LANGS, {}, epochs).items():
            for e in range(3):
                for r in sorted(leaves[k], key=lambda r: ((r[f"h{e}"] % 2**64) >> 54, r[f"h{e}"], r["doc_id"])):
                    if budget > 0:
                        want.append((r["doc_id"], e, min(budget, r["n"])))
                        budget -= r["n"]
        assert sorted(w for w in want if w[2]) == [g for g in got if g[2]]
    assert mixing.mix(docs.limit(0), F.lit("web"), {"web": 1}, {}).count() == 0


def test_mix_edges(spark):
    """Clashing names, string ids, ids that are all null or repeated, very long texts, wholly alike rows."""
    rows = [(None, "a b c", "en", "src0", 777, "x", "y")] * 5 + [(None, "d e f g", "en", "src0", 777, "x", "y"), ("k", "w " * 200_000, "de", "src0", 1, "x", "y"), ("k", None, "de", "src0", 1, "x", "y"), ("k", "z", "de", "src0", 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, mix_n long, d string, row string").repartition(3)
    for share in (0.1, 0.5, 0.9, 1.0, 1.7):
        got = mixing.mix(docs, F.lit("web"), {"web": 1}, {"web": {"en": 1, "de": 1}}, share=share, epochs=2, seed=3)
        assert got.columns == [*docs.columns, "mix_"]
        got = got.collect()
        assert sum(r["mix_"]["take"] for r in got) == int(share * 200_020) and {r["mix_n"] for r in got} <= {777, 1} and {r["d"] for r in got} <= {"x"}
        assert all(0 <= r["mix_"]["take"] <= r["mix_"]["tokens"] for r in got)
        copies = {}
        for r in got:
            copies[r["text"], r["mix_"]["epoch"]] = copies.get((r["text"], r["mix_"]["epoch"]), 0) + 1
        assert all(n <= (5 if t == "a b c" else 1) for (t, _), n in copies.items())
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("MIX_", F.lit(1)), F.lit("web"), {"web": 1}, {})


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="ad">Buy</div>
<article class="post"><h1>Title &amp; &#233;</h1><p><b>First <i>one</i>\n two<br><p>Second &lt;x&gt;&nbsp;y<!-- c --> 1 < 2</p><ul><li>item a<li>item b</ul><form><input value=3>search</form><aside>side</aside><div class="reader-comments"><p>nice!</p></div><table><tr><td>c1<td>c2</table></article><footer>&copy; f</footer></body></html>"""


def test_main_text():
    assert site_tree.main_text(PAGE) == "Title & é\nFirst one two\nSecond <x> y 1 < 2\nitem a\nitem b\nc1\nc2"
    assert site_tree.main_text(None) == site_tree.main_text("") == site_tree.main_text("<nav>x</nav>") == ""
    assert site_tree.main_text("plain  text") == "plain text"
    assert site_tree.main_text("<p>" * 3000 + "deep") == "deep"
    assert site_tree.main_text("<div>" * 3000 + "deep") == "deep"
    assert site_tree.main_text('<p a="unclosed>x</p><p>y') in ("x\ny", "y")


@pytest.mark.parametrize("limit", [10**6, 0])
def test_style_tree_drops_repeated_branches(spark, monkeypatch, limit):
    monkeypatch.setattr(site_tree, "BROADCAST_PATHS", limit)
    rows = [(i, f"http://h.example/{i}", f"<body><div class='top'>Same words</div><div class='main'><p>own text {i} {i * 7}</p><p>more {i * 31}</p></div><div class='end'><p>Contact</p></div></body>") for i in range(30)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://other.example", "<div class='top'>Only</div>"), (102, "http://other.example", "<div class='top'>Only</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "paths": F.lit(2)})
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in site_tree.extract_pages(df).collect()]
    assert len(got) == len(rows)
    for i, text, n in got:
        assert n == len(text)
        if i < 30:
            assert text == f"own text {i} {i * 7}\nmore {i * 31}"
    assert sorted(t for i, t, _ in got if i >= 100) == ["", "", "Only", "Only"]
    assert site_tree.extract_pages(df.limit(0)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline
    from memlake.llm import bpe, parity_join

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    one = corpus_pipeline.by_language(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    ids = {r["doc_id"] for r in one.select("doc_id").collect()}
    assert len(ids) > 0.9 * len(docs)
    groups = {}
    for d in ids:
        groups.setdefault("".join(docs[d]["text"].split()), []).append(d)
    kept = {min(g, key=lambda d: (-len(docs[d]["text"]), d)) for g in groups.values()}
    near = parity_join.brute_force({d: docs[d]["text"] for d in kept}, 5, 80, 100)
    kept = {d for d, (_, c) in near.items() if c == d}
    two = corpus_pipeline.without_copies(spark, one, sf)
    three = corpus_pipeline.without_near_copies(spark, two, sf)
    assert {r["doc_id"] for r in three.select("doc_id").collect()} == kept and three.columns == one.columns
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} <= kept and len(out) > 0
    enc = bpe._encoding(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    assert all(r["n_tokens"] == len(enc.encode_ordinary(docs[r["doc_id"]]["text"])) for r in out)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as c

    rows = [(1, "the of and that", "en", "src0", 1), (1, "the of and that", "en", "src0", 1), (2, "the of  and that", None, None, None), (None, "no id here at all", "en", "src1", 2), (3, None, "en", "src1", None), (4, "", "en", "src1", 0), (5, "der die und das ist", "de", "src2", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in c.STAGES[:-1]:
            frame = stage(spark, frame, "")
            assert frame.columns == docs.columns
        assert "ids_sha256" in c.STAGES[-1][1](spark, frame, "").columns
    assert sorted(str(r["doc_id"]) for r in c.without_copies(spark, docs, "").collect()) == ["2", "3", "5", "None"]
    assert sorted(str(r["doc_id"]) for r in c.without_near_copies(spark, c.without_copies(spark, docs, ""), "").collect()) == ["2", "3", "5", "None"]


def _tight(rng, n_tight, n_other, dim=16, noise=0.045):
    """A tight group of different vectors among random ones, and their exact links at 0.93."""
    mid = rng.normal(size=dim)
    x = np.concatenate([mid / np.linalg.norm(mid) + noise * rng.normal(size=(n_tight, dim)), rng.normal(size=(n_other, dim))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x, (unit @ unit.T >= 0.93).sum(1) - 1


def test_vector_graph_counts_a_split_dense_group(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 150)
    monkeypatch.setattr(vector_graph, "BLOCK", 60)
    x, exact = _tight(np.random.default_rng(4), 500, 1000)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vector_graph.near_duplicates(df).collect()}
    assert exact[:500].min() > 300
    assert [got[i]["n_links"] for i in range(500)] == exact[:500].tolist()
    assert {got[i]["component_id"] for i in range(500)} == {0}


@pytest.mark.parametrize("alone", [16, 2])
def test_vector_graph_of_repeated_ids_and_many_regions(spark, monkeypatch, alone):
    """Rows as many as came in; different vectors of one id apart; blocks meet by regions."""
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 40)
    monkeypatch.setattr(vector_graph, "BLOCK", 30)
    monkeypatch.setattr(vector_graph, "ALONE", alone)
    rng = np.random.default_rng(7)
    x, _ = _tight(rng, 120, 200)
    ids = [*range(len(x)), 3, 3, 250, 900, 900]
    x = np.concatenate([x, x[3:4], x[250:251], x[5:6], x[300:301], -x[300:301]])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int")
    got = vector_graph.near_duplicates(df).collect()
    assert len(got) == len(ids)
    nodes = {(i, tuple(v)) for i, v in zip(ids, x.tolist(), strict=True)}
    unit = {n: np.array(n[1]) / np.linalg.norm(n[1]) for n in nodes}
    links = {n: [m for m in nodes if m[1] == n[1] and m != n or m[1] != n[1] and unit[n] @ unit[m] >= 0.93] for n in nodes}
    comp = {n: n[0] for n in nodes}
    for _ in range(50):
        comp = {n: min([comp[n], *(comp[m] for m in links[n])]) for n in nodes}
    want = sorted((i, len(links[i, tuple(v)]), comp[i, tuple(v)]) for i, v in zip(ids, x.tolist(), strict=True))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want


def test_vector_graph_goes_exact_where_the_graph_falls_short(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 150)
    monkeypatch.setattr(vector_graph, "_search", lambda threshold, beam: lambda key, pdf: pdf.assign(links=0, root=pdf["rep"])[["rep", "links", "root"]][pdf["own"]])
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x + 0.05 * rng.normal(size=x.shape)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.arange(600) % 300 % 20 == 0
    links = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None])
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vector_graph.near_duplicates(df).collect()}
    assert [got[i]["n_links"] for i in range(600)] == (links.sum(1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(300, 600)] == [min(np.flatnonzero(links[i])) for i in range(300, 600)]
    assert got[0]["audit_recall"] == 1.0


def _texts(spark, pages, **kw):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in site_tree.extract_pages(df, **kw).collect()}


def test_style_tree_decides_inside_and_beside_articles(spark):
    inside = [f"<body><main><div class='lede'>own {i} {i * 7}</div><div class='house'>Call us today</div></main><div class='strap'>Same line</div></body>" for i in range(20)]
    assert _texts(spark, inside) == {i: f"own {i} {i * 7}" for i in range(20)}
    beside = [f"<body><div class='content'><p>long text {i}</p><p>more {i * 31}</p></div><article>teaser {i}</article><div class='strap'>Same line</div></body>" for i in range(20)]
    assert _texts(spark, beside) == {i: f"long text {i}\nmore {i * 31}\nteaser {i}" for i in range(20)}

def _tree_by_hand(sources, least_pages=2, threshold=0.3):
    """The unimportant style paths of one site, from plain sets of pages and no Spark."""
    held = {}
    for source in set(sources):
        page = site_tree.Page(source)
        for path, (parent, children, inside) in page.styles.items():
            held.setdefault((path, parent, inside, 0, repr(children)), set()).add(source)
        for path, text in page.texts:
            parent, _, inside = page.styles.get(path, (0, [], False))
            held.setdefault((path, parent, inside, 1, text), set()).add(source)
    nodes = {}
    for (path, parent, inside, kind, _), found in held.items():
        node = nodes.setdefault((path, parent), {"path": path, "parent": parent, "marked": 0, 0: [], 1: []})
        node["marked"] |= int(inside)
        node[kind].append(len(found))
    rare = [parent for (_, parent), n in nodes.items() if sum(n[0]) < least_pages]
    rows = []
    for n in nodes.values():
        pages = sum(n[0])
        if pages >= least_pages:
            share = [sum(c * np.log(c) for c in n[k]) / (max(1, sum(n[k])) * np.log(max(2, pages))) for k in (0, 1)]
            rows.append((n["path"], n["parent"], n["marked"], pages, rare.count(n["path"]), 1 - share[0], min(1.0, share[1]) if n[1] else np.nan))
    table = pd.DataFrame(rows, columns=["path", "parent", "marked", "pages", "rare", "style_entropy", "text_entropy"])
    return {p for p, (_, most) in site_tree.importance(table, least_pages=least_pages).items() if most < threshold}


def test_style_tree_against_one_by_hand(spark):
    """Sites of random templates: the tree changes texts, and as the one by hand does."""
    rng = random.Random(3)
    sites = {}
    for h in range(6):
        lines = [f"line {h} {j}" for j in range(4)]
        sites[f"h{h}.example"] = [
            "<body>" + "".join(f"<div class='{c}'>{rng.choice(lines[:n]) if n else f'own {h} {i} {c}'}</div>" for c, n in (("strap", 1), ("tip", 2), ("story", 0), ("end", 4)) if rng.random() < 0.9)
            + f"<main><p>body {i} {h}</p><div class='house'>{rng.choice(lines[:2])}</div></main></body>" for i in range(3 + 5 * h)
        ]
    rows = [(i, f"http://{h}/{i}", p) for h, pages in sites.items() for i, p in enumerate(pages)]
    got = {r["url"]: r["text"] for r in site_tree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    low = {h: _tree_by_hand(pages) for h, pages in sites.items()}
    assert got == {url: site_tree.main_text(p, low[url.split("/")[2]]) for _, url, p in rows}
    assert sum(got[url] != site_tree.main_text(p) for _, url, p in rows) > len(rows) / 2


def test_style_tree_of_deep_layouts_and_small_sites(spark):
    deep = [f"<body>{'<div>' * 15}<div class='text'>own {i}</div><div class='house'>Call us today</div>" for i in range(12)]
    assert _texts(spark, deep) == {i: f"own {i}" for i in range(12)}
    assert _texts(spark, deep[:2]) == {i: f"own {i}" for i in range(2)}
    assert _texts(spark, deep[:1]) == {0: "own 0\nCall us today"}
    very = [f"<body>{'<div>' * 3000}<div class='text'>own {i}</div><div class='house'>Call us today</div>" for i in range(3)]
    assert _texts(spark, very) == {i: f"own {i}" for i in range(3)}


def test_audit_is_not_outweighed_by_a_dense_group(spark):
    rng = np.random.default_rng(6)
    mid, single = rng.normal(size=16), rng.normal(size=(20, 16))
    x = np.concatenate([mid + 0.01 * rng.normal(size=(40, 16)), single, single + 0.001])
    reps = spark.createDataFrame([(1, 16, v.tolist(), i, 1) for i, v in enumerate(x)], "label int, dim int, embedding array<double>, rep long, copies long")
    found = spark.createDataFrame([(i, 39 if i < 40 else 0) for i in range(80)], "rep long, links long")
    assert vector_graph._audit(reps, found, 0.93) == pytest.approx(0.5)


def test_copy_stages_with_repeated_and_missing_ids(spark):
    import corpus_pipeline as c

    rows = [(1, "alpha one two three four"), (1, "quite another text of this id"), (1, "beta  gamma delta"), (2, "beta   gamma   delta"), (None, "no id here"), (None, "no  id  here"), (None, "no id here"), (3, "beta gamma delta")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [("1", "alpha one two three four"), ("1", "quite another text of this id"), ("2", "beta   gamma   delta"), ("None", "no  id  here")]
    one = c.without_copies(spark, docs, "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in one.collect()) == want and one.columns == docs.columns
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in "abc"]
    near = [(1, long[0]), (1, long[1]), (None, long[2]), (None, long[2] + " end"), (7, long[1] + " end")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in near], "doc_id long, text string, lang string, source string, n_chars long")
    got = c.without_near_copies(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"][:2]) for r in got) == [("1", "a0"), ("7", "b0"), ("None", "c0")]


def test_every_language_is_learned(spark, monkeypatch):
    langs = ["zz", "yy", "xx", "bb", "aa"]
    df = spark.createDataFrame([(i, f"text {i}", langs[i % 5]) for i in range(50)], "doc_id long, text string, lang string").repartition(7)
    wins, labels, found = language_gru.training_windows(df, 600, 8, 7)
    assert found == sorted(langs) and len(wins) == 50
    monkeypatch.setattr(language_gru, "TEXTS", 13)
    wins, labels, found = language_gru.training_windows(df, 600, 8, 7)
    assert found == sorted(langs) and np.bincount(labels).tolist() == [2] * 5
    monkeypatch.setattr(language_gru, "TEXTS", 4)
    with pytest.raises(ValueError):
        language_gru.training_windows(df, 600, 8, 7)


def test_rare_nodes_count_at_their_parent():
    """The tree without nodes of one page, but with their number at the parent, decides as the whole tree does."""
    import pandas as pd

    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(2, 40))
        parent = [0] + [int(rng.integers(1, i + 1)) for i in range(1, n)]
        pages = [int(rng.integers(1, 6))]
        for p in parent[1:]:
            pages.append(int(rng.integers(1, pages[p - 1] + 1)))
        whole = pd.DataFrame({"path": range(1, n + 1), "parent": parent, "pages": pages, "style_entropy": rng.random(n), "text_entropy": [float("nan") if x < 0.5 else x for x in rng.random(n)], "marked": rng.integers(0, 2, n)})
        few = whole[whole.pages < 2]
        kept = whole[whole.pages >= 2].assign(rare=lambda d: [int((few.parent == p).sum()) for p in d.path])
        a, b = site_tree.importance(whole), site_tree.importance(kept)
        assert {k: pytest.approx(a[k]) for k in b} == b
