"""Health panels of a collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scalars as S

# Bonuses of a snapshot by what a point's path contains.
SNAPSHOT_BONUSES = (("docs/adr/", 0.30), ("/decision", 0.30), (".claude/insights/", 0.15), (".claude/rules/", 0.05))


def room_histogram(points: DataFrame, rooms: Sequence[str]) -> DataFrame:
    """(room, n) for every configured room, empty ones too, and for points without a room (null)."""
    spark = points.sparkSession
    known = spark.createDataFrame([(r,) for r in rooms] + [(None,)], "room string")
    # no more groups than the configured rooms, so the broadcast is bounded by them
    n = points.where(F.col("room").isNull() | F.col("room").isin(*rooms)).groupBy("room").count()
    return known.join(F.broadcast(n), known["room"].eqNullSafe(n["room"]), "left").select(known["room"], F.coalesce("count", F.lit(0)).alias("n"))


def temporal_panel(points: DataFrame, now: Column, retention_days: float, stale_days: float = 7.0) -> DataFrame:
    """One row: live, superseded, future and expired counts, the range of starts, and whether the newest is stale."""
    ended = F.col("valid_to").isNotNull() & (F.col("valid_to") <= now)
    newest = F.max("valid_from")
    return points.agg(
        F.count_if(~ended).alias("live"), F.count_if(ended).alias("superseded"), F.count_if(F.col("valid_from") > now).alias("future"),
        F.count_if(ended & (S.age_days(F.col("valid_to"), now) > retention_days)).alias("awaiting_gc"),
        F.min("valid_from").alias("oldest"), newest.alias("newest"), F.round(S.age_days(newest, now), 6).alias("age_days"), (S.age_days(newest, now) > stale_days).alias("stale"),
    )


def snapshot_rank(points: DataFrame, now: Column, bonuses: Sequence[tuple[str, float]] = SNAPSHOT_BONUSES, scan: int = 512, top: int = 80) -> DataFrame:
    """The top points of the first `scan` live ones by id: recency plus the first matching path's bonus."""
    live = points.where(F.col("valid_to").isNull() | (F.col("valid_to") > now)).orderBy("id").limit(scan)
    bonus = F.lit(0.0)
    for part, value in reversed(bonuses):
        bonus = F.when(F.col("file_path").contains(part), value).otherwise(bonus)
    age = F.greatest(S.age_days(F.coalesce("updated_at", "valid_from"), now), F.lit(0.0))
    score = F.round(F.exp(-age / 30.0) + F.coalesce(bonus, F.lit(0.0)), 9)
    return live.withColumn("score", score).orderBy(F.desc("score"), "id").limit(top)


def snapshot_cut(ranked: DataFrame, tokens: int = 3000, lines: int = 500) -> DataFrame:
    """snapshot_budget of a snapshot's rows (rk, text, ...): the first ones, blank ones left out, up to the one that either budget ends.

    A snapshot is some dozens of rows, so one task may see them in order.
    """
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = ranked.withColumn("text", text).where("text <> ''")
    upto = Window.orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    height = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 2
    cut_ = rows.withColumn("used_", F.sum(S.token_estimate(F.col("text"))).over(upto)).withColumn("height_", F.sum(height).over(upto))
    return cut_.where((F.col("used_") <= tokens) & (F.col("height_") <= lines)).drop("used_", "height_")


def snapshot_budget(ranked: list[tuple[str, str]], tokens: int = 3000, lines: int = 500) -> list[tuple[str, str]]:
    """The ranked (path, document) rows that fit both budgets, blank ones skipped; the first that does not fit ends it.

    A fold on the driver over a snapshot's few dozen rows: unlike a search's budget, not even the first row is exempt.
    """
    out, used, written = [], 0, 0
    for path, document in ranked:
        text = document.strip()
        if not text:
            continue
        cost, height = max(1, len(text) // 4), text.count("\n") + 2
        if used + cost > tokens or written + height > lines:
            break
        out.append((path, text))
        used, written = used + cost, written + height
    return out
