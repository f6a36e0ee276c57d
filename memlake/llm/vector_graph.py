"""Near-duplicate vectors by a robust-pruned flat graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, components, cut, seeded_share

#: Rows that a shard should hold; how many shards a vector belongs to; shards in all (bounds the broadcast centroids).
SHARD_ROWS, OVERLAP, MAX_SHARDS = 2_000, 4, 65_536
#: Vectors that the shard centroids are fitted on, at least; at most two a shard.
FIT_ROWS = 16_384
#: Candidates and kept neighbours of a node, long edges beside them, least near ones, and how eagerly close neighbours displace others.
CANDIDATES, DEGREE, LONG, FILL, ALPHA = 48, 24, 6, 8, 1.2
#: Nodes that the greedy search keeps open; how far below the threshold a node may lie and still be expanded.
BEAM, SLACK = 24, 0.04
#: Vectors of a block of the exact passes; shards of a group up to which each is a region of its own.
BLOCK, ALONE = 2_000, 16
#: Queries of the recall audit.
AUDIT = 1_024


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    x = x.astype(np.float32)
    for _ in range(rounds):
        at = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Kept candidates (n, degree) of each own row, -1 where there are fewer; cand is sorted by falling similarity.

    The closest candidate stays and displaces those it is alpha times closer to than the
    node is, and so on. A node left with fewer than FILL gets its closest ones back, so
    that the members of a tight group do not all hang on its middle alone.
    """
    n, c = cand.shape
    between = 1 - np.matmul(x[cand], x[cand].transpose(0, 2, 1))
    dist = 1 - sims
    alive = (cand >= 0) & (cand != own[:, None])
    kept, count = np.full((n, degree), -1, np.int64), np.zeros(n, np.int64)
    rows = np.arange(n)
    some = alive.copy()
    for j in range(c):
        take = alive[:, j] & (count < degree)
        some[:, j] &= ~take
        kept[rows[take], count[take]] = cand[take, j]
        count += take
        alive[:, j + 1 :] &= ~(take[:, None] & (alpha * between[:, j, j + 1 :] <= dist[:, j + 1 :]))
    for j in range(c):
        take = some[:, j] & (count < FILL)
        kept[rows[take], count[take]] = cand[take, j]
        count += take
    return kept


def build_graph(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Adjacency lists of one shard's unit vectors: robust-pruned nearest candidates, random long edges, reverse edges."""
    s = len(x)
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    c = min(CANDIDATES, s - 1)
    heads, tails = [], []
    for i in range(0, s if c else 0, 256):
        own = np.arange(i, min(s, i + 256))
        sim = x[own] @ x.T
        sim[np.arange(len(own)), own] = -2
        cand = np.argpartition(-sim, c - 1, axis=1)[:, :c]
        value = np.take_along_axis(sim, cand, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        cand, value = np.take_along_axis(cand, order, axis=1), np.take_along_axis(value, order, axis=1)
        near = robust_prune(x, own, cand, value, DEGREE, ALPHA)
        both = np.concatenate([near, rng.integers(0, s, (len(own), LONG))], axis=1)
        at, to = np.repeat(own, both.shape[1]), both.ravel()
        good = (to >= 0) & (to != at)
        heads.append(at[good])
        tails.append(to[good])
    if not heads:
        return [np.zeros(0, np.int64)] * s
    h, t = np.concatenate(heads), np.concatenate(tails)
    out = np.unique(h * s + t)
    pairs = np.unique(np.concatenate([out, t * s + h]))
    h, t = pairs // s, pairs % s
    # a list that grew too long keeps its own edges and those to the nodes that fewest lists name
    rare = np.bincount(t, minlength=s)[t] - np.where(np.isin(pairs, out), 4 * s, 0)
    start = np.searchsorted(h, np.arange(s + 1))
    return [t[a:b] if b - a <= 3 * DEGREE else np.sort(t[a:b][np.argsort(rare[a:b], kind="stable")[: 3 * DEGREE]]) for a, b in zip(start[:-1], start[1:], strict=True)]


def medoids(x: np.ndarray, n: int = 12) -> np.ndarray:
    """The vector nearest to the centre, and vectors far from it and from each other."""
    first = int((x @ x.mean(axis=0)).argmax())
    out, best = [first], x @ x[first]
    for _ in range(min(n, len(x)) - 1):
        out.append(int(best.argmin()))
        best = np.maximum(best, x @ x[out[-1]])
    return np.unique(out)


def range_search(x: np.ndarray, lists: list[np.ndarray], starts: np.ndarray, q: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Nodes found with similarity of about threshold or more: greedy from the medoids, then every node in range is expanded."""
    seen = np.zeros(len(x), bool)
    done = np.zeros(len(x), bool)
    sim = np.full(len(x), -2, np.float32)
    seen[starts] = True
    sim[starts] = x[starts] @ q
    pool = starts
    while True:
        open_ = pool[~done[pool]]
        if not len(open_):
            break
        best = open_[sim[open_].argsort()[::-1][:3]]
        done[best] = True
        near = np.concatenate([lists[b] for b in best])
        near = np.unique(near[~seen[near]])
        if len(near):
            seen[near] = True
            sim[near] = x[near] @ q
            pool = np.concatenate([pool, near])
            if len(pool) > beam:
                pool = pool[np.argpartition(-sim[pool], beam - 1)[:beam]]
    while True:
        wave = np.flatnonzero(seen & ~done & (sim >= threshold - SLACK))
        if not len(wave):
            return np.flatnonzero(sim >= threshold - 1e-4)
        done[wave] = True
        near = np.concatenate([lists[b] for b in wave])
        near = np.unique(near[~seen[near]])
        seen[near] = True
        sim[near] = x[near] @ q


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    ids = pdf["rep"].to_numpy()
    lists = build_graph(_unit(pdf["embedding"]), seed=int(key[2]))
    return pd.DataFrame({"rep": ids, "near": [ids[a] for a in lists]})


def _search(threshold: float, beam: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        ids, count, primary = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["own"].to_numpy()
        exact = _unit(pdf["embedding"])
        x = exact.astype(np.float32)
        lists = []
        for a in pdf["near"]:
            a = np.asarray(a, np.int64)
            at = np.minimum(np.searchsorted(ids, a), len(ids) - 1)
            lists.append(at[ids[at] == a])
        starts = medoids(x)
        root = np.arange(len(ids))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = np.zeros(len(ids), np.int64)
        touched = np.zeros(len(ids), bool)
        for i in np.flatnonzero(primary):
            got = range_search(x, lists, starts, x[i], threshold, beam)
            got = got[got != i]
            got = got[exact[got] @ exact[i] >= threshold]
            links[i] = count[got].sum()
            if len(got):
                touched[got] = touched[i] = True
                for j in got[root[got] != root[i]]:
                    a, b = find(i), find(int(j))
                    root[max(a, b)] = min(a, b)
        out = np.flatnonzero(primary | touched)
        return pd.DataFrame({"rep": ids[out], "links": np.where(primary[out], links[out], -1), "root": [ids[find(int(i))] for i in out]})

    return run


def _audit(reps: DataFrame, found: DataFrame, threshold: float) -> float | None:
    """Mean share of a vector's links that were found, over those of a bounded seeded sample that have links, held against all rows in blocks; None if none has."""
    sample = reps.where(seeded_share(F.col("rep"), AUDIT, reps.count(), 5)).orderBy(F.xxhash64(F.lit(5), "rep"), "rep").limit(AUDIT).collect()
    if not sample:
        return None
    groups: dict[tuple, tuple[list[int], np.ndarray]] = {}
    for key in {(r["label"], r["dim"]) for r in sample}:
        own = [r for r in sample if (r["label"], r["dim"]) == key]
        groups[key] = ([r["rep"] for r in own], _unit([r["embedding"] for r in own]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, part in b.groupby(["label", "dim"]):
                if key in groups:
                    ids, q = groups[key]
                    n = (q @ _unit(part["embedding"]).T >= threshold) @ part["copies"].to_numpy()
                    yield pd.DataFrame({"rep": ids, "n": n})

    exact = reps.select("label", "dim", "embedding", "copies").mapInPandas(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    # a vector is no link of its own
    return exact.join(found, "rep").where("n > 1").agg(F.avg(F.col("links") / (F.col("n") - 1))).first()[0]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, least_recall: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Link vectors of the same label whose cosine is threshold or more, in double precision.

    Returns (id_col, n_links, component_id, kept, audit_recall): other vectors linked
    directly, the smallest id reachable by links, whether the row is that one, and the
    mean share of a vector's links that were found, as audited (null if no vector of the
    audit has a link).

    Equal vectors go on as one with a count. Centroids fitted on a bounded sample make
    shards. Vectors as near to their centroid as the threshold are the shard's core: all
    links with a core vector are counted exactly, over all shards whose bound on the angle
    lets them hold partners, in matrix products of blocks whose counts are added up. So a
    tight group may be split over many shards. All other vectors join their OVERLAP
    nearest shards. Every shard builds a robust-pruned graph of them; the adjacency lists
    of a vector's shards are united. Each is then searched once, in its nearest shard,
    over the united lists: greedily from the shard's medoids, then through everything in
    range; what is found is verified. Links are counted and united inside the task, so
    pairs of a dense group are never emitted. The audit holds a seeded sample against all
    rows; below least_recall the graph is built anew with twice the overlap, and where
    that does not help, all blocks that can hold partners are multiplied exactly.

    Vectors that are null, empty, zero or hold null or non-finite components, and those
    with a null label, link with nothing: n_links 0, their own component, kept. So do
    vectors of different lengths. Rows with a null id are no vectors: n_links 0, null
    component, not kept. Rows that repeat an id and vector count once; different vectors of
    one id are vectors of their own. An empty table
    gives no rows; other columns are ignored.
    """
    arrow_batches(vectors.sparkSession, 4096)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    usable = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
              & F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"))
    good = rows.where(usable).withColumn("dim", F.size("embedding"))
    reps = cut(good.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("first"), F.count_distinct("vec_id").alias("copies")))
    twice = cut(reps.groupBy("first").agg(F.count("*").alias("n")).where("n > 1").select("first", F.lit(True).alias("again")))
    repeats = not twice.isEmpty()
    if repeats:  # different vectors of one id are nodes of their own, under numbers above all ids
        made = F.shiftrightunsigned(F.xxhash64("label", "dim", "embedding"), 2) + F.lit(1 << 62)
        reps = cut(reps.join(twice, "first", "left").withColumn("rep", F.when(F.col("again"), made).otherwise(F.col("first"))).drop("again"))
    else:
        reps = reps.withColumn("rep", F.col("first"))
    overlap, beam = OVERLAP, BEAM
    while True:
        found = cut(_links(reps, threshold, overlap, beam))
        own = _totals(reps, found)
        recall = _audit(reps, own, threshold)
        if recall is None or recall >= least_recall or overlap >= 4 * OVERLAP:
            break
        overlap, beam = 2 * overlap, 2 * beam
    if recall is not None and recall < least_recall:
        found = cut(_every_link(reps, threshold, overlap))
        own = _totals(reps, found)
        recall = _audit(reps, own, threshold)
    whole = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_rep = reps.join(own, "rep").join(whole, F.col("rep") == F.col("id"), "left").select("label", "dim", "embedding", "first", "links", F.coalesce("component", "rep").alias("component"))
    if repeats:
        least = per_rep.groupBy("component").agg(F.min("first").alias("least"))
        per_rep = per_rep.join(least, "component").withColumn("component", F.col("least")).drop("least")
    linked = good.join(per_rep, ["label", "dim", "embedding"]).select("vec_id", "links", "component")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return linked.unionByName(alone).select(F.col("vec_id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"))


def _totals(reps: DataFrame, found: DataFrame) -> DataFrame:
    """(rep, links): what the passes found of a vector, added up, and its own copies."""
    base = reps.select("rep", (F.col("copies") - 1).alias("links"))
    return base.unionByName(found.where("links >= 0").select("rep", "links")).groupBy("rep").agg(F.sum("links").alias("links"))


def _centres(reps: DataFrame, overlap: int) -> tuple[set, dict[tuple, np.ndarray]]:
    """The groups larger than a shard, and their centroids."""
    total = reps.count()
    # only groups larger than a shard need centroids, so at most MAX_SHARDS of them are counted here
    size = max(SHARD_ROWS, math.ceil(total * overlap / MAX_SHARDS))
    large = {(r["label"], r["dim"]): r["count"] for r in reps.groupBy("label", "dim").count().where(F.col("count") > size).collect()}
    wanted = {key: math.ceil(n * overlap / size) for key, n in large.items()}
    fit = max(FIT_ROWS, min(2 * MAX_SHARDS, 2 * sum(wanted.values())))
    centres: dict[tuple, np.ndarray] = {}
    if large:
        sample = reps.where(seeded_share(F.col("rep"), fit, total, 9)).orderBy(F.xxhash64(F.lit(9), "rep"), "rep").limit(fit).select("label", "dim", "embedding").toArrow()
        at: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(sample["label"].to_pylist(), sample["dim"].to_pylist(), strict=True)):
            at.setdefault(key, []).append(i)
        for key, k in wanted.items():
            if key in at:
                own = sample["embedding"].take(at[key]).combine_chunks()
                centres[key] = kmeans(_unit(own.flatten().to_numpy().reshape(-1, key[1])), k, seed=1)
    return set(large), centres


def _kinds(sim: np.ndarray, threshold: float) -> np.ndarray:
    """2 for the core (similarity to the nearest centroid of threshold or more), 1 for what may link with a core, else 0.

    With an angle a of the threshold, a partner of a core vector is within 2a of that
    core's centroid, so the nearest centroid of the partner is within 2a as well.
    """
    reach = 2 * threshold * threshold - 1 if threshold > 0 else -1.0
    return np.where(sim >= threshold, 2, np.where(sim >= reach - 1e-5, 1, 0))


def _links(reps: DataFrame, threshold: float, overlap: int, beam: int) -> DataFrame:
    """(rep, links, root): links found of a vector (-1 for none searched), to be added up, and the smallest id of a part it belongs to.

    Links with a vector of a core are counted exactly by blocks, all others by the graph.
    """
    large, centres = _centres(reps, overlap)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, part in b.groupby(["label", "dim"], sort=False):
                c = centres.get(key)
                if c is None:
                    yield part.assign(shard=0, own=True)
                    continue
                m = min(overlap, len(c))
                sim = _unit(part["embedding"]).astype(np.float32) @ c.T
                rest = _kinds(sim.max(axis=1), threshold) < 2
                part, near = part[rest], np.argsort(-sim[rest], axis=1, kind="stable")[:, :m]
                for j in range(m):
                    yield part.assign(shard=near[:, j], own=j == 0)

    schema = f"label {reps.schema['label'].dataType.simpleString()}, dim int, embedding array<double>, rep long, copies long, shard int, own boolean"
    placed = reps.select("label", "dim", "embedding", "rep", "copies").mapInPandas(place, schema)
    lists = placed.groupBy("label", "dim", "shard").applyInPandas(_build, "rep long, near array<long>").groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = placed.join(lists, "rep").groupBy("label", "dim", "shard").applyInPandas(_search(threshold, beam), "rep long, links long, root long")
    regions = _regions(centres)
    return graph.unionByName(_products(_blocks(reps, centres, regions, large, threshold, False), regions, threshold, False)) if centres else graph


def _every_link(reps: DataFrame, threshold: float, overlap: int) -> DataFrame:
    """(rep, links, root) by exact products of all blocks that can hold partners."""
    large, centres = _centres(reps, overlap)
    regions = _regions(centres)
    return _products(_blocks(reps, centres, regions, large, threshold, True), regions, threshold, True)


def _regions(centres: dict[tuple, np.ndarray]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Of each group: the middles of its regions, and the region of every shard; about as many as the root of its shards."""
    out = {}
    for key, c in centres.items():
        if len(c) <= ALONE:
            out[key] = (c.astype(np.float64), np.arange(len(c)))
            continue
        mid = kmeans(c, math.ceil(math.sqrt(len(c))), seed=2).astype(np.float64)
        mid /= np.maximum(np.linalg.norm(mid, axis=1, keepdims=True), 1e-12)
        out[key] = (mid, (c @ mid.T).argmax(axis=1))
    return out


def _angle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def _blocks(reps: DataFrame, centres: dict[tuple, np.ndarray], regions: dict, large: set, threshold: float, every: bool) -> DataFrame:
    """Blocks of about BLOCK vectors of a shard and kind, packed, with the middle and the angle that holds all, and how far that is from the region's middle; lone ones make up a whole group."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, part in b.groupby(["label", "dim"], sort=False):
                c = centres.get(key)
                if c is None:
                    if every:
                        yield part.assign(shard=0, kind=0, lone=key not in large)
                    continue
                sim = _unit(part["embedding"]).astype(np.float32) @ c.T
                part = part.assign(shard=sim.argmax(axis=1), kind=_kinds(sim.max(axis=1), threshold), lone=False)
                yield part if every else part[part["kind"] > 0]

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        x = _unit(pdf["embedding"])
        mid = x.mean(axis=0)
        norm = np.linalg.norm(mid)
        mid = mid / norm if norm > 1e-9 else x[0]
        wide = float(np.arccos(np.clip((x @ mid).min(), -1, 1)))
        region, far = 0, math.pi
        if key[:2] in regions:
            middles, of = regions[key[:2]]
            region = int(of[key[2]])
            far = float(_angle(mid[None], middles[region : region + 1])[0, 0]) + wide
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "block": [int(pdf["rep"].iloc[0])], "kind": [key[3]], "lone": [key[5]], "region": [region], "far": [far], "mid": [mid], "wide": [wide], "x": [x.tobytes()], "reps": [pdf["rep"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()]})

    label = reps.schema["label"].dataType.simpleString()
    dealt = reps.select("label", "dim", "embedding", "rep", "copies").mapInPandas(deal, f"label {label}, dim int, embedding array<double>, rep long, copies long, shard int, kind int, lone boolean")
    key = ["label", "dim", "shard", "kind"]
    sizes = dealt.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = dealt.join(F.broadcast(sizes.where("parts > 1")), key, "left").withColumn("part", F.pmod(F.xxhash64(F.lit(11), "rep"), F.coalesce("parts", F.lit(1))))
    return cut(dealt.select(*key, "part", "lone", "embedding", "rep", "copies").groupBy(*key, "part", "lone").applyInPandas(pack, f"label {label}, dim int, block long, kind int, lone boolean, region int, far double, mid array<double>, wide double, x binary, reps binary, copies binary"))


def _within_reach(blocks: DataFrame, regions: dict, angle: float) -> DataFrame:
    """(label, dim, region, other) of regions that can hold partners of each other, each pair once.

    Two can if the angle of their middles is at most that of the threshold and both their
    reaches. A group has about as many regions as the root of its shards, so there are about
    as many pairs as shards.
    """
    reach = {(r["label"], r["dim"], r["region"]): r["far"] for r in blocks.groupBy("label", "dim", "region").agg(F.max("far").alias("far")).collect() if (r["label"], r["dim"]) in regions}
    pairs = []
    for key, (middles, _) in regions.items():
        far = np.array([reach.get((*key, g), -np.inf) for g in range(len(middles))])
        near = _angle(middles, middles) <= far[:, None] + far[None, :] + angle + 1e-6
        pairs += [(*key, int(g), int(h)) for g, h in zip(*np.nonzero(near), strict=True) if g <= h]
    label = blocks.schema["label"].dataType.simpleString()
    return blocks.sparkSession.createDataFrame(pairs, f"label {label}, dim int, region int, other int")


def _parts(hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of every connected part of a table of links; a row is expanded once."""
    left = hit.any(axis=1)
    while left.any():
        rows = new = np.array([left.argmax()])
        left[rows] = False
        cols = np.zeros(hit.shape[1], bool)
        while len(new):
            fresh = hit[new].any(axis=0) & ~cols
            cols |= fresh
            new = np.flatnonzero(left & hit[:, fresh].any(axis=1))
            left[new] = False
            rows = np.concatenate([rows, new])
        yield rows, np.flatnonzero(cols)


def _products(blocks: DataFrame, regions: dict, threshold: float, every: bool) -> DataFrame:
    """(rep, links, root) of every pair of blocks that can hold partners; unless every is set, one of the two is a core.

    Two blocks can if the angle of their middles is at most both their widths and that of
    the threshold. Each pair is met once and credits both sides. A task adds up what it
    finds of a vector, so rows follow vectors and tasks, never links.
    """
    angle = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # block -> ids, links, roots
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while root.get(i, i) != i:
                root[i] = i = root.get(root[i], root[i])
            return i

        for b in batches:
            for r in b.itertuples():
                side = []
                for at, x, reps, copies in ((r.block, r.x, r.reps, r.copies), (r.block_b, r.x_b, r.reps_b, r.copies_b)):
                    ids = np.frombuffer(reps, np.int64)
                    known.setdefault(at, (ids.copy(), np.zeros(len(ids), np.int64), ids.copy()))
                    side.append((np.frombuffer(x, np.float64).reshape(len(ids), -1), np.frombuffer(copies, np.int64), known[at]))
                (xa, na, (_, la, ra)), (xb, nb, (_, lb, rb)) = side
                same = r.block == r.block_b
                # only vectors that can reach the other block are multiplied
                ia = np.flatnonzero(np.arccos(np.clip(xa @ np.asarray(r.mid_b), -1, 1)) <= r.wide_b + angle)
                ib = ia if same else np.flatnonzero(np.arccos(np.clip(xb @ np.asarray(r.mid), -1, 1)) <= r.wide + angle)
                hit = xa[ia] @ xb[ib].T >= threshold
                if same:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                la[ia] += hit @ nb[ib]
                if not same:
                    lb[ib] += hit.T @ na[ia]
                for rows, cols in _parts(hit):
                    rows, cols = ia[rows], ib[cols]
                    names = np.unique(np.concatenate([ra[rows], rb[cols]]))
                    tops = {find(int(i)) for i in names}
                    least = min(tops)
                    for i in tops:
                        root[i] = least
                    ra[rows] = least
                    rb[cols] = least
        for ids, links, roots in known.values():
            some = links > 0
            if some.any():
                yield pd.DataFrame({"rep": ids[some], "links": links[some], "root": [find(int(i)) for i in roots[some]]})

    cols = ["block", "mid", "wide", "x", "reps", "copies"]
    many = blocks.where("not lone").drop("far", "lone")
    tiles = _within_reach(blocks, regions, angle)
    tile = ["label", "dim", "region", "other"]
    # a block goes to the tiles of its region and the regions in its reach, and meets there only what is in the same tile
    one = many.join(tiles, ["label", "dim", "region"])
    two = many.withColumnsRenamed({"region": "other", "kind": "kind_b", **{c: f"{c}_b" for c in cols}}).join(tiles, ["label", "dim", "other"])
    dot = F.aggregate(F.zip_with("mid", "mid_b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    near = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) <= F.col("wide") + F.col("wide_b") + F.lit(angle)
    once = (F.col("region") < F.col("other")) | (F.col("block") <= F.col("block_b"))
    met = once & near if every else once & near & (F.greatest("kind", "kind_b") == 2)
    pairs = one.join(two, tile).where(met).select(*cols, *(f"{c}_b" for c in cols))
    if every:
        pairs = pairs.unionByName(blocks.where("lone").select(*cols, *(F.col(c).alias(f"{c}_b") for c in cols)))
    return pairs.mapInPandas(run, "rep long, links long, root long")
