"""A stored dense index: vectors in folders by the nearest of a fixed set of centres, searched exactly without reading them all.

centres/            (cell, centre): fixed when the index is made, from a bounded sample
vectors/batch=B/cell=C/   (id, vec, and columns to filter by)
extents/batch=B/    (cell, n, widest): how many vectors a batch put into a cell, and the
                    greatest angle between one of them and the centre; written last

A vector of a cell is at most `widest` away from its centre, so its angle to a query is at
least the centre's angle less that. A search reads the cells around each query until they
hold n vectors, and then only those that could still hold a better one than the n-th found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.retrieval import QUERY_BLOCK, ROW_BLOCK, Best, _unit, ranked
from memlake.shared import cut

#: Vectors that centres are chosen from, at most, and rounds of that choice.
SAMPLE, ROUNDS = 20_000, 8
#: What rounding may add to an angle or a score.
SLACK = 1e-6


def choose_centres(x: np.ndarray, count: int, seed: int = 0) -> np.ndarray:
    """Unit centres of unit vectors by spherical k-means, started from different vectors; fewer where there are fewer."""
    x = np.unique(x[np.linalg.norm(x, axis=1) > 0], axis=0)
    if not len(x):
        return np.zeros((0, x.shape[1]))
    centres = x[np.random.default_rng(seed).choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-300), centres)
    return centres


class Cells:
    """The index below a root; ids and filter columns keep the types of the first write."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        #: Of the last search: pairs of a query and a cell that were read, and all pairs.
        self.read, self.pairs = 0, 0

    def _centres(self) -> np.ndarray:
        rows = sorted(self.spark.read.parquet(f"{self.root}/centres").collect(), key=lambda r: r["cell"])
        return np.array([r["centre"] for r in rows])

    def make(self, vectors: DataFrame, count: int = 64, seed: int = 0) -> None:
        """Choose the centres from at most SAMPLE of vectors (id, vec). Their number bounds what a search's driver holds."""
        some = vectors.where("vec is not null").select("vec", F.xxhash64(F.lit(seed), "id").alias("o"), F.col("id").alias("i")).orderBy("o", "i").limit(SAMPLE)
        x = [r["vec"] for r in some.collect()]
        centres = choose_centres(_unit(x), count, seed) if x else np.zeros((0, 0))
        rows = [(i, c.tolist()) for i, c in enumerate(centres)] or [(0, [])]
        self.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centres")

    def write(self, vectors: DataFrame, batch: int) -> None:
        """Enter vectors (id, vec, and columns to filter by) as one batch; written again, a batch replaces itself. Null vectors are left out."""
        centres = self._centres()
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema), "angle double, cell int"])

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near = _unit(b["vec"]) @ centres.T if centres.shape[1] else np.zeros((len(b), 1))
                    yield b.assign(angle=np.arccos(np.clip(near.max(axis=1), -1, 1)), cell=near.argmax(axis=1).astype(np.int32))

        placed = vectors.where("vec is not null").mapInPandas(place, schema)
        path = f"{self.root}/vectors/batch={batch}"
        # a cell's vectors lie together, and a frequent cell in as many files as its size asks for
        placed.hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(path)
        there = self.spark.read.schema("angle double, cell int").parquet(path)
        there.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/extents/batch={batch}")

    def search(self, queries: DataFrame, n: int = 20, digits: int = 6, where: Column | None = None) -> DataFrame:
        """(qid, id, score, rk): what dense_topk gives for queries (qid, vec) over the rows of `where`, exactly.

        Queries come in blocks; each block reads cells twice, the second time those that the
        first time's scores leave open. The filter and the cells' folders reach the scan.
        """
        try:
            extents = self.spark.read.schema("cell int, n long, widest double, batch long").parquet(f"{self.root}/extents")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            extents = self.spark.createDataFrame([], "cell int, n long, widest double, batch long")
        done = {r["batch"] for r in extents.select("batch").distinct().collect()}
        size = extents.groupBy("cell").agg(F.sum("n").alias("n"), F.max("widest").alias("widest")).orderBy("cell").collect()
        number = np.array([r["cell"] for r in size], np.int64)
        held, widest = np.array([r["n"] for r in size]), np.array([r["widest"] for r in size])
        stored, out = None, None
        if len(number):
            stored = self.spark.read.parquet(f"{self.root}/vectors").where(F.col("batch").isin(list(done)))
            stored = stored if where is None else stored.where(where)
        kinds = dict(queries.dtypes) | (dict(stored.dtypes) if stored is not None else {"id": "long"})
        schema = f"qid {kinds['qid']}, id {kinds['id']}, score double"
        self.read = self.pairs = 0
        rows = queries.where("vec is not null").select("qid", "vec").orderBy("qid").toLocalIterator()
        centres = self._centres()[number] if len(number) else None
        while len(number) and (block := list(islice(rows, QUERY_BLOCK))):
            q, ids = _unit([r["vec"] for r in block]), [r["qid"] for r in block]
            least = np.maximum(0, np.arccos(np.clip(q @ centres.T, -1, 1)) - widest) if centres.shape[1] else np.zeros((len(q), len(number)))
            order = np.argsort(least, axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            first = np.zeros(least.shape, bool)
            np.put_along_axis(first, order, before < n, axis=1)
            one = cut(self._best(stored, q, ids, number, first, n, digits, schema))
            last = {r["qid"]: r["s"] for r in ranked(one, n).where(F.col("rk") == n).select("qid", F.col("score").alias("s")).collect()}
            floor = np.array([last.get(i, -np.inf) for i in ids])
            second = ~first & (np.cos(least) + SLACK >= floor[:, None])
            found = one.unionByName(self._best(stored, q, ids, number, second, n, digits, schema)) if second.any() else one
            self.read, self.pairs = self.read + int(first.sum() + second.sum()), self.pairs + first.size
            out = found if out is None else out.unionByName(found)
        return ranked(self.spark.createDataFrame([], schema) if out is None else out, n)

    def _best(self, stored: DataFrame, q: np.ndarray, ids: list, number: np.ndarray, wanted: np.ndarray, n: int, digits: int, schema: str) -> DataFrame:
        asks = {int(number[c]): np.flatnonzero(wanted[:, c]) for c in np.flatnonzero(wanted.any(axis=0))}

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = Best(len(ids), n)
            for b in batches:
                for cell, of in b.groupby("cell"):
                    who = asks[cell]
                    for i in range(0, len(of), ROW_BLOCK):
                        part = of.iloc[i : i + ROW_BLOCK]
                        sims = np.full((len(ids), len(part)), -np.inf)
                        sims[who] = np.round(q[who] @ _unit(part["vec"]).T, digits)
                        kept.add(sims, part["id"].to_numpy())
            at, score, own = kept.rows()
            if len(at):
                yield pd.DataFrame({"qid": [ids[i] for i in at], "id": own, "score": score})

        return stored.where(F.col("cell").isin(list(asks))).select("cell", "id", "vec").mapInPandas(best, schema)
