"""Conversation transcripts: pairing of turns, tool statuses, and the last relevant positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Event types that are not part of a turn.
SKIPPED = ("system", "summary", "file-history-snapshot", "queue-operation")


def turn_pairs(events: DataFrame, session: str = "session", pos: str = "pos", kind: str = "type") -> DataFrame:
    """(session, turn_index, user_pos, assistant_pos): each user event with the assistants up to the next one.

    Side chains and skipped types are left out, assistants before the first user dropped,
    and a last user without an answer kept.
    """
    kept = events.where(~F.col(kind).isin(*SKIPPED))
    if "isSidechain" in events.columns:
        kept = kept.where(~F.coalesce("isSidechain", F.lit(False)))
    upto = Window.partitionBy(session).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    pair = F.sum(F.when(F.col(kind) == "user", 1).otherwise(0)).over(upto)
    grouped = kept.withColumn("pair_", pair).where("pair_ > 0").groupBy(session, "pair_")
    return grouped.agg(F.min(F.when(F.col(kind) == "user", F.col(pos))).alias("user_pos"), F.array_sort(F.collect_list(F.when(F.col(kind) == "assistant", F.col(pos)))).alias("assistant_pos")).select(session, (F.col("pair_") - 1).alias("turn_index"), "user_pos", "assistant_pos")


def tool_statuses(uses: DataFrame, results: DataFrame) -> DataFrame:
    """uses (session, turn_index, tool_id) with the status that the next turn's results give (session, turn_index, tool_id, is_error)."""
    after = results.select("session", (F.col("turn_index") - 1).alias("turn_index"), "tool_id", "is_error")
    return uses.join(after, ["session", "turn_index", "tool_id"], "left").withColumn("status", F.when(F.col("is_error"), "error").otherwise("ok")).drop("is_error")


def recent_search(events: DataFrame, session: str = "session", pos: str = "pos") -> DataFrame:
    """(session, allowed): whether a search (is_search) came after the last user event (is_user)."""
    last = events.groupBy(session).agg(F.max(F.when(F.col("is_search"), F.col(pos))).alias("s"), F.max(F.when(F.col("is_user"), F.col(pos))).alias("u"))
    return last.select(session, F.coalesce(F.col("s") > F.coalesce("u", F.lit(-1)), F.lit(False)).alias("allowed"))


def last_user_text(events: DataFrame, most: int = 400) -> DataFrame:
    """(session, task): the last user message, at most 400 code points."""
    return events.where("type = 'user' and trim(text) <> ''").groupBy("session").agg(F.substring(F.max_by("text", "pos"), 1, most).alias("task"))
