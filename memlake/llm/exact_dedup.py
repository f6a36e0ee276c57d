"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut

#: A digest with more rows than this, and than this share of the table, is hot: its copies get salts and its winner is
#: broadcast. At most 1 / HOT_SHARE digests can be hot, which bounds that broadcast.
HOT_ROWS, HOT_SHARE = 1_000, 1 / 20_000
#: 2^64 and 2^63: a winner's rank is its length times the first minus its id; no id (null) counts as the second.
WHOLE, HALF = 2**64, 2**63


def _sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """Group texts that are identical without white space; one row per input row.

    Returns (id_col, keep_id, group_size, kept, text_sha256). The row with the most
    code points in its original text stays, then the one with the smallest id.

    1. Each map task combines its own rows by (digest, salt, content): the partial
       aggregation compares whole contents, so a group of copies leaves a task as one row.
    2. Groups are combined across tasks, by digest, salt and whole content. Only hot
       digests have more than one salt, so all other groups are complete here.
    3. The salt winners of hot digests are combined globally, by digest and whole content.

    Digests are a way to meet and never decide: where the contents of a digest turn out to
    differ, its rows are grouped and joined by their whole contents. All other members get
    their winner by digest, those of hot digests from a broadcast of bounded size.

    Null text counts as empty. A null id sorts after all others. Rows that repeat an id
    and a text cannot be told apart and are marked alike. An empty table gives no rows.
    Other columns are ignored, whatever their names. `digest` is a parameter for tests.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, WHITE, "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(norm).alias("sha"), norm.alias("norm"), F.length(text).alias("n"))
    ids = cut(rows.select("doc_id", "sha"))
    total = ids.agg((F.count("*") * HOT_SHARE).alias("share"))
    hot = cut(ids.groupBy("sha").agg(F.count("*").alias("c")).where(F.col("c") > HOT_ROWS).join(F.broadcast(total), F.col("c") > F.col("share")).select("sha", F.lit(True).alias("hot")))

    # longest text, then smallest id, as one number: the winner is found by plain hash aggregation
    rank = (F.col("n").cast("decimal(12,0)") * F.expr(f"cast({WHOLE} as decimal(20,0))")
            - F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.expr(f"cast({HALF} as decimal(20,0))")))
    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0))
    salted = (rows.join(F.broadcast(hot), "sha", "left").withColumn("salt", salt).withColumn("hot", F.coalesce("hot", F.lit(False)))
              .groupBy("sha", "hot", "salt", "norm").agg(F.max(rank).alias("best"), F.count("*").alias("size")))
    # groups without salts are whole: each is a content of its own, so they are counted and their text stays behind
    content = F.when(F.col("hot"), F.col("norm"))
    whole = salted.groupBy("sha", "hot", content.alias("content")).agg(F.max("best").alias("best"), F.sum("size").alias("size"), F.count("*").alias("parts"))
    winners = cut(whole.groupBy("sha", "hot").agg(F.sum(F.when(F.col("hot"), 1).otherwise(F.col("parts"))).alias("contents"), F.max("best").alias("best"), F.sum("size").alias("group_size")))

    one = winners.where("contents = 1")
    heavy, light = one.where("hot").select("sha", "best", "group_size"), one.where("not hot").select("sha", "best", "group_size")
    members = ids.join(F.broadcast(heavy), "sha").unionByName(ids.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(light, "sha"))
    clash = winners.where("contents > 1").select("sha")
    if not clash.isEmpty():
        apart = rows.join(clash, "sha", "left_semi")
        groups = apart.groupBy("sha", "norm").agg(F.max(rank).alias("best"), F.count("*").alias("group_size"))
        members = members.unionByName(apart.select("doc_id", "sha", "norm").join(groups, ["sha", "norm"]).drop("norm"))

    longest = F.expr(f"(best + cast({HALF} as decimal(38,0))) div cast({WHOLE} as decimal(20,0))")
    ident = F.expr(f"cast({WHOLE} as decimal(20,0))") * longest.cast("decimal(12,0)") - F.col("best")
    keep = F.when(ident < F.expr(f"cast({HALF} as decimal(38,0))"), ident.cast("long"))
    return members.withColumn("keep_id", keep).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
