"""Filters as data: a batch of queries, each with its own conditions and its own moment.

Queries carry `where`, a map of keys to lists of values, and `now`. Different queries with
the same two share a rule. Conditions are rows (rule, key, value) that meet the points'
attributes (id, key, value) in one equi-join; a point is admitted to a rule if as many
different keys met as the rule asks for and its time is right. So a batch needs one pass
over the points, however many filters it has, and no filter becomes part of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scalars as S
from memlake.functions.predicates import LISTS, live
from memlake.shared import cut, small

WHERE = "map<string,array<string>>"
#: Conditions (a few short strings each) that may be broadcast; more are joined by a shuffle.
CONDITIONS = 200_000


def _attribute(points: DataFrame, key: str) -> Column:
    """The values of a key as an array of strings: of a column, of a list column, of the path's prefixes, or of the map `extra`."""
    if key == "path_prefix":
        return F.col("path_prefixes") if "path_prefixes" in points.columns else S.path_prefixes(F.col("file_path"))
    if key in LISTS:
        return F.col(key)
    value = F.col(key) if key in points.columns else F.col("extra")[key] if "extra" in points.columns else F.lit(None)
    return F.array(value.cast("string"))


def rules_of(queries: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(queries with their rule, (rule, where, now)): rules are numbered from 0 in the order of their conditions.

    A null where has no conditions, a null now is the given one. `valid_to` takes only
    "now", which the temporal condition already means; anything else raises. One row a
    different rule of the batch meets in one task.
    """
    kept = F.map_filter(F.coalesce("where", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))), lambda k, v: k != "valid_to")
    bad = F.coalesce(F.exists(F.col("where")["valid_to"], lambda x: x != "now"), F.lit(False))
    where = F.when(bad, F.raise_error(F.lit('valid_to takes only "now"')).cast(WHERE)).otherwise(kept)
    rows = queries.withColumn("where", where).withColumn("now", F.coalesce(F.col("now"), F.lit(now)).cast("timestamp") if "now" in queries.columns else F.lit(now).cast("timestamp"))
    order = F.array_sort(F.transform(F.map_entries("where"), lambda e: F.struct(e["key"].alias("k"), F.array_sort(F.array_distinct(e["value"])).alias("v"))))
    rows = rows.withColumn("rule_key", F.to_json(F.struct(order.alias("c"), F.unix_micros("now").alias("at"))))
    rules = rows.groupBy("rule_key").agg(F.first("where").alias("where"), F.first("now").alias("now"))
    rules = cut(rules.withColumn("rule", (F.row_number().over(Window.orderBy("rule_key")) - 1).cast("int")))
    return rows.join(small(rules.select("rule_key", "rule")), "rule_key").drop("rule_key"), rules.select("rule", "where", "now")


def admitted(points: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(key, rules array<int>): of every point that some rule admits, the rules that do.

    A rule without conditions admits what is live at its moment. Keys that points have
    nowhere are null, and meet no condition.
    """
    keys = sorted(r["k"] for r in rules.select(F.explode(F.map_keys("where")).alias("k")).distinct().collect())
    listed = rules.select("rule", F.explode("where").alias("k", "values")).select("rule", "k", F.explode(F.array_distinct("values")).alias("v"))
    anyone = rules.where(F.size("where") == 0).select("rule", F.lit("").alias("k"), F.lit("").alias("v"))
    conditions = listed.unionByName(anyone).join(small(rules.select("rule", "now", F.greatest(F.size("where"), F.lit(1)).alias("need"))), "rule")
    pair = lambda k, values: F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.struct(F.lit(k).alias("k"), v.alias("v")))
    have = F.concat(F.array(F.struct(F.lit("").alias("k"), F.lit("").alias("v"))), *(F.coalesce(pair(k, _attribute(points, k)), F.array().cast("array<struct<k:string,v:string>>")) for k in keys))
    rows = points.select(key, "valid_to", F.explode(F.array_distinct(have)).alias("a")).select(key, "valid_to", "a.k", "a.v")
    met = rows.join(small(conditions, CONDITIONS), ["k", "v"]).where(live(F.col("valid_to"), F.col("now")))
    # a key counts once, however many of its values met
    whole = met.groupBy(key, "rule", "need", "k").agg(F.lit(1).alias("one")).groupBy(key, "rule", "need").agg(F.count("*").alias("n")).where("n = need")
    return whole.groupBy(key).agg(F.sort_array(F.collect_list("rule")).alias("rules"))
