"""The edit hook over batches of edits: queries from paths, the filter chain, what is injected, shadow queries, the journal."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.config import Config
from memlake.functions import scalars as S
from memlake.shared import cut, small

#: What a chunk may be dropped for, in the chain's order; repeats inside one fetch are not counted by the journal.
REASONS = ("foreign", "floor", "stale", "deduped", "repeat", "limit")


def relative(path: Column, root: str) -> Column:
    """A path below the root without it; any other path as it is."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, F.lit(len(top) + 1), F.length(path))).otherwise(path)


def last_task(edits: DataFrame, messages: DataFrame, most: int = 400) -> DataFrame:
    """Edits (session, ts, ...) with task: the session's last user message with text up to then, at most 400 code points.

    messages: (session, ts, text). One ordered pass a session: both sides are laid in one
    line and the last message is carried on to the edits after it.
    """
    told = messages.where(F.trim("text") != "").select("session", "ts", F.substring(F.trim("text"), 1, most).alias("said"), F.lit(None).cast(edits.select(F.struct("*")).schema[0].dataType).alias("edit"))
    asked = edits.select("session", "ts", F.lit(None).cast("string").alias("said"), F.struct("*").alias("edit"))
    upto = Window.partitionBy("session").orderBy("ts", F.col("edit").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return told.unionByName(asked).withColumn("task", F.coalesce(F.last("said", ignorenulls=True).over(upto), F.lit(""))).where("edit is not null").select("edit.*", "task")


def edit_queries(edits: DataFrame, messages: DataFrame | None, root: str, globs: Sequence[str] | None = None) -> DataFrame:
    """(qid, channel, query) of edits (qid, session, ts, path): a query from the path, and a shadow query that puts the last task before it.

    Edits of files that are no code, and paths that say nothing, ask nothing.
    """
    rel = relative(F.col("path"), root)
    asked = edits.withColumn("query", S.derive_query(rel)).where(S.is_code_target(rel, globs) & (F.col("query") != ""))
    hook = asked.select("qid", F.lit("hook").alias("channel"), "query")
    if messages is None:
        return hook
    shadow = last_task(asked, messages).where("task <> ''").select("qid", F.lit("shadow").alias("channel"), F.concat_ws(" ", "task", "query").alias("query"))
    return hook.unionByName(shadow)


def filter_chain(hits: DataFrame, seen: DataFrame, files: DataFrame, root: str, min_score: float = 0.0, inject_k: int = 5) -> DataFrame:
    """Hits with drop_reason (null: injected) and key.

    hits: (qid, channel, session, rk, source, text, rerank_score). Sources outside the root
    go first, then reranked scores under the floor, sources that do not exist (files: path),
    chunks that the session saw before (seen: session, key), repeats inside the fetch, and
    what is left beyond the first inject_k. Of files and seen only what the hits name is
    shuffled, as long as the hits are few enough to be broadcast.
    """
    out = cut(hits.withColumn("key", S.chunk_key(F.col("source"), F.col("text"))).withColumn("place_", relative(F.col("source"), root)))
    named, keys = small(out.select("place_").distinct()), small(out.select("session", "key").distinct())
    there = files.select(relative(F.col("path"), root).alias("place_")).join(named, "place_", "left_semi").distinct().withColumn("there_", F.lit(True))
    known = seen.select("session", "key").join(keys, ["session", "key"], "left_semi").distinct().withColumn("seen_", F.lit(True))
    out = out.join(there, "place_", "left").join(known, ["session", "key"], "left")
    low = F.lit(min_score > 0) & F.coalesce(F.col("rerank_score") < min_score, F.lit(False))
    early = F.when(~S.in_project(F.col("source"), root), "foreign").when(low, "floor").when(F.col("there_").isNull(), "stale").when(F.col("seen_"), "deduped")
    out = out.withColumn("early_", early)
    per = ["qid", "channel"]
    again = F.row_number().over(Window.partitionBy(*per, "key", F.col("early_").isNull()).orderBy("rk")) > 1
    out = out.withColumn("early_", F.coalesce("early_", F.when(again, "repeat")))
    place = F.row_number().over(Window.partitionBy(*per, F.col("early_").isNull()).orderBy("rk"))
    return out.withColumn("drop_reason", F.coalesce("early_", F.when(place > inject_k, "limit"))).drop("early_", "seen_", "there_", "place_")


def run_hook(edits: DataFrame, search: Callable[[DataFrame], DataFrame], seen: DataFrame, files: DataFrame, root: str, messages: DataFrame | None = None, config: Config | None = None, globs: Sequence[str] | None = None) -> DataFrame:
    """One journal row an edit: (qid, session, ts, target, query, chunks, empty, deduped, dropped, shadow).

    search takes (qid, text) and gives at least fetch_k hits (qid, rk, source, text, score,
    rerank_score) each; both channels are searched in one batch. Only the hook's own
    chunks are injected; the shadow's pass the same filters and are written beside them.
    """
    c = config or Config()
    asked = cut(edit_queries(edits, messages, root, globs))
    name = F.to_json(F.struct("qid", "channel"))
    hits = search(asked.select(name.alias("qid"), F.col("query").alias("text"))).where(F.col("rk") <= c.fetch_k)
    hits = hits.select(F.col("qid").alias("name_"), "rk", "source", "text", "score", "rerank_score").join(asked.select(name.alias("name_"), "qid", "channel"), "name_").drop("name_")
    tagged = filter_chain(hits.join(edits.select("qid", "session"), "qid"), seen, files, root, c.min_score, c.inject_k)
    kept = F.col("drop_reason").isNull()
    chunk = F.struct("rk", F.struct("source", F.round("score", 4).alias("score"), F.lit(True).alias("exists"), S.cyrillic(F.col("text")).alias("lang")).alias("chunk"))
    count = lambda why: F.count_if(F.col("drop_reason") == why).cast("int").alias(why)
    per = tagged.groupBy("qid", "channel").agg(F.transform(F.array_sort(F.collect_list(F.when(kept, chunk))), lambda x: x["chunk"]).alias("chunks"), count("deduped"), F.struct(count("stale"), count("floor"), count("foreign")).alias("dropped"))
    side = lambda channel: asked.where(F.col("channel") == channel).join(per, ["qid", "channel"], "left")
    none = F.array().cast(per.schema["chunks"].dataType)
    zero = F.struct(*(F.lit(0).alias(x) for x in ("stale", "floor", "foreign")))
    hook = side("hook").select("qid", "query", "chunks", "deduped", "dropped")
    shadow = side("shadow").select("qid", F.struct("query", F.coalesce("chunks", none).alias("chunks")).alias("shadow"))
    out = edits.select("qid", "session", "ts", F.col("path").alias("target")).join(hook, "qid", "left").join(shadow, "qid", "left")
    return out.select("qid", "session", "ts", "target", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("chunks", none).alias("chunks"), (F.coalesce(F.size("chunks"), F.lit(0)) < 1).alias("empty"),
                      F.coalesce("deduped", F.lit(0)).alias("deduped"), F.coalesce("dropped", zero).alias("dropped"), "shadow")
