"""A stored sparse index: postings kept with a collection, brought up to date by batches, and searched without its texts.

Everything is Parquet that Spark writes and prunes. Below a root lie, each with a folder a batch:

postings/   (term, id, tf, dl) in folders by a hash of the term, so that a search reads only the
            folders that its terms fall into; a frequent term has as many files as its size asks for;
            a folder of its own has one row a document, with its length
terms/      (term, docs) in the same folders: by how much the batch changed the number of
            documents with a term
totals/     (docs, words): by how much it changed the number of documents and of words
ended/      (id, old): versions of earlier batches that it replaced or took away
documents/  (id, dl): its own versions, written last; a document that was taken away has no dl

A batch that is written again replaces its own folders and looks only at batches before it,
so it can be repeated after a failure; until its documents are there, readers pass it over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import scalars as S
from memlake.operators.retrieval import K1, TERM_LIMIT, B, ranked
from memlake.shared import cut, small


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: The folder of the documents' lengths; those of terms count from 0.
LENGTHS = -1
#: What a posting is made of, and rows of one batch of them.
NAMES, OUT_ROWS = ["id", "dl", "term", "tf"], 100_000


def counted(words: DataFrame) -> DataFrame:
    """(id, dl, term, tf) of documents (id, w), w all words of one: counted in its batch, without a shuffle.

    Every document has one row without a term besides, so that one pass gives its length too.
    """
    return words.select("id", "w").mapInArrow(_counts, f"id {dict(words.dtypes)['id']}, dl int, term string, tf int")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = pc.list_value_length(b.column("w")).to_numpy(zero_copy_only=False)
        coded = b.column("w").flatten().dictionary_encode()
        many = max(1, len(coded.dictionary))
        key, tf = np.unique(np.repeat(np.arange(len(size)), size) * many + coded.indices.to_numpy(), return_counts=True)
        row, code = np.divmod(key, many)
        ids, dl = b.column("id"), pa.array(size, pa.int32())
        yield pa.RecordBatch.from_arrays([ids, dl, pa.nulls(len(ids), coded.dictionary.type), pa.nulls(len(ids), pa.int32())], NAMES)
        for i in range(0, len(key), OUT_ROWS):  # a document has far more terms than rows
            at = pa.array(row[i : i + OUT_ROWS])
            yield pa.RecordBatch.from_arrays([ids.take(at), dl.take(at), coded.dictionary.take(pa.array(code[i : i + OUT_ROWS])), pa.array(tf[i : i + OUT_ROWS], pa.int32())], NAMES)


class Postings:
    """The index below a root; ids are of one Spark type, and terms fall into a fixed number of folders a batch."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "long", parts: int = 16) -> None:
        self.spark, self.root, self.id_type, self.parts = spark, root.rstrip("/"), id_type, parts
        self.posting = f"term string, id {id_type}, tf int, dl int, part int"

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.parts)).cast("int").alias("part")

    def _table(self, name: str, columns: str, before: int | None) -> DataFrame:
        rows = _read(self.spark, f"{self.root}/{name}", f"{columns}, batch long")
        return rows if before is None else rows.where(F.col("batch") < before)

    def batches(self, before: int | None = None) -> list[int]:
        """Finished batches."""
        rows = self._table("documents", f"id {self.id_type}, dl int", before).select("batch").distinct()
        return sorted(r["batch"] for r in rows.collect())

    def current(self, before: int | None = None) -> DataFrame:
        """(id, dl, batch): the newest version of every document that is still there."""
        rows = self._table("documents", f"id {self.id_type}, dl int", before)
        newest = rows.groupBy("id").agg(F.max_by(F.struct("dl", "batch"), "batch").alias("v"))
        return newest.select("id", "v.dl", "v.batch").where("dl is not null")

    def postings(self, before: int | None = None, done: list[int] | None = None) -> DataFrame:
        """(term, id, tf, dl, part, batch) of finished batches, ended versions included."""
        return self._finished(self._table("postings", self.posting, before), before, done).where(F.col("part") != LENGTHS)

    def ended(self, before: int | None = None, done: list[int] | None = None) -> DataFrame:
        """(id, batch) of versions that a later batch replaced or took away."""
        rows = self._finished(self._table("ended", f"id {self.id_type}, old long", before), before, done)
        return rows.select("id", F.col("old").alias("batch"))

    def _finished(self, rows: DataFrame, before: int | None, done: list[int] | None = None) -> DataFrame:
        return rows.where(F.col("batch").isin(self.batches(before) if done is None else done))

    def write(self, docs: DataFrame, batch: int, removed: DataFrame | None = None) -> None:
        """Enter docs (id, text), new or changed, and take out the documents of removed (id), as one batch.

        Every id comes once at most, in one of the two. A null text is one without words; a null id is left out.
        """
        words = docs.where("id is not null").select("id", S.words(F.coalesce("text", F.lit(""))).alias("w"))
        rows = counted(words).select("term", "id", "tf", "dl", F.when(F.col("term").isNull(), LENGTHS).otherwise(self._part()).alias("part"))
        self._put(rows.hint("rebalance", F.col("part")).sortWithinPartitions("part", "term"), "postings", batch, "part")
        written = _read(self.spark, f"{self.root}/postings/batch={batch}", self.posting)
        own = written.where(F.col("part") == LENGTHS).select("id", "dl")
        if removed is not None:
            own = own.unionByName(removed.select("id", F.lit(None).cast("int").alias("dl")))
        own = cut(own)
        old = cut(self.current(batch).join(own.select("id"), "id", "left_semi"))
        change = written.where(F.col("part") != LENGTHS).select("part", "term", F.lit(1).alias("by"))
        totals = own.where("dl > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))
        if not old.isEmpty():
            gone = self.postings(batch).join(small(old.select("id", "batch")), ["id", "batch"], "left_semi")
            change = change.unionByName(gone.select("part", "term", F.lit(-1).alias("by")))
            lost = old.where("dl > 0").agg((-F.count("*")).alias("docs"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("words"))
            totals = totals.unionByName(lost).agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
        self._put(change.groupBy("part", "term").agg(F.sum("by").cast("long").alias("docs")).where("docs <> 0").hint("rebalance", F.col("part")), "terms", batch, "part")
        self._put(totals.coalesce(1), "totals", batch)
        self._put(old.select("id", F.col("batch").alias("old")), "ended", batch)
        self._put(own, "documents", batch)

    def _put(self, rows: DataFrame, name: str, batch: int, *by: str) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}/batch={batch}")

    def search(self, queries: DataFrame, n: int = 20, digits: int = 6) -> DataFrame:
        """(qid, id, score, rk): the n best by BM25 of queries (qid, text), as bm25_topk gives them over the current texts.

        Only folders that a term of the queries falls into are read. Terms are broadcast
        while they are few; more are joined by a shuffle. The words of the corpus are not
        looked at again.
        """
        terms = cut(queries.select("qid", F.explode(F.array_distinct(S.words(F.col("text")))).alias("term")))
        wanted = small(terms.select("term").distinct().select("term", self._part()), TERM_LIMIT)
        touched = F.col("part").isin([r["part"] for r in wanted.select("part").distinct().collect()])  # at most as many as there are folders
        done = self.batches()
        total = self._finished(self._table("totals", "docs long, words long", None), None, done).agg(F.sum("docs").alias("n"), F.sum("words").alias("words")).first()
        count, words = total["n"] or 0, total["words"] or 0
        changes = self._finished(self._table("terms", "term string, docs long, part int", None), None, done).where(touched)
        df = changes.join(wanted, ["part", "term"]).groupBy("part", "term").agg(F.sum("docs").alias("df")).where("df > 0")
        idf = F.log((F.lit(float(count)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        each = cut(terms.join(small(df, TERM_LIMIT), "term").select("part", "term", "qid", idf.alias("idf")))
        found, ended = self.postings(done=done).where(touched), self.ended(done=done)
        found = found if ended.isEmpty() else found.join(small(ended), ["id", "batch"], "left_anti")
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(words / max(count, 1))))
        # the part of a document's weight that all queries share is worked out once a posting
        hit = found.select("part", "term", "id", part.alias("weight")).join(small(each, TERM_LIMIT), ["part", "term"])
        return ranked(hit.groupBy("qid", "id").agg(F.round(F.sum(F.col("idf") * F.col("weight")), digits).alias("score")), n)
