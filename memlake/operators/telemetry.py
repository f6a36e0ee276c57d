"""Usage analytics over the audit log and the injection journal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scalars as S
from memlake.shared import cut


def _key() -> Column:
    return F.concat_ws(":", F.coalesce("kind", F.lit("?")), F.coalesce(F.col("source").cast("string"), F.lit("?")))


def usage_rollup(audit: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Per kind:source (or the columns `by`): count, token moments, mean; null tokens are 0, a missing kind or source is ?.

    All are sums, counts and extremes, so partial results merge: this is also the streaming aggregate.
    """
    t = F.coalesce("tokens", F.lit(0)).cast("long")
    keys = [_key().alias("key")] if by is None else list(by)
    return audit.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(t).alias("tokens"), F.sum(t * t).alias("sumsq"), F.min(t).alias("least"), F.max(t).alias("most"), F.round(F.avg(t), 6).alias("mean"))


def placed_values(df: DataFrame, by: str, x: str) -> DataFrame:
    """(by, x, lo, upto, n): the distinct values of each key with the places lo to upto - 1 that they take in its order.

    Values are counted, then ordered within parts of an octave's sixteenth, whose sizes say
    where a part begins. So no key is gathered or sorted in one task, however many rows it has.
    """
    part = lambda c: F.floor(16 * (F.log2(c) + 1100))
    values = df.where(F.col(x).isNotNull()).groupBy(by, F.col(x).cast("double").alias("x")).agg(F.count("*").alias("c"))
    values = cut(values.withColumn("part", F.when(F.col("x") > 0, part(F.col("x"))).when(F.col("x") < 0, -part(-F.col("x"))).otherwise(F.lit(0)).cast("long")))
    sizes = values.groupBy(by, "part").agg(F.sum("c").alias("size"))
    key = Window.partitionBy(by)
    sizes = sizes.withColumn("base", F.sum("size").over(key.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("n", F.sum("size").over(key)).drop("size")
    order = Window.partitionBy(by, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.join(sizes, [by, "part"]).withColumn("upto", F.col("base") + F.sum("c").over(order))
    return placed.select(by, "x", (F.col("upto") - F.col("c")).alias("lo"), "upto", "n")


def _at(place: Column) -> Column:
    """The value at a place of a key's order, as an aggregate over placed_values."""
    return F.max(F.when((F.col("lo") <= place) & (place < F.col("upto")), F.col("x")))


def indexed_percentile(p: float) -> Column:
    """The value at index round-half-even(p * (n - 1)); no interpolation."""
    return _at(F.rint(F.lit(p) * (F.col("n") - 1)))


def linear_percentile(p: float) -> Column:
    """Interpolated between the two nearest places."""
    at = F.lit(p) * (F.col("n") - 1)
    low, high = _at(F.floor(at)), _at(F.ceil(at))
    return low + F.max(at - F.floor(at)) * (high - low)


def usage_percentiles(df: DataFrame, by: str, x: str) -> DataFrame:
    """The definitions of percentiles that reports use: indexed, interpolated, median and nearest rank, and plain cuts of the sorted list.

    Keys without values have 0 for the indexed ones and null for the others.
    """
    n = F.col("n")
    found = placed_values(df, by, x).groupBy(by).agg(
        indexed_percentile(0.5).alias("p50_indexed"), indexed_percentile(0.95).alias("p95_indexed"),
        F.round(linear_percentile(0.5), 6).alias("p50_linear"), F.round(linear_percentile(0.95), 6).alias("p95_linear"),
        F.round(linear_percentile(0.5), 6).alias("median"), _at(F.ceil(F.lit(0.95) * n) - 1).alias("p95_rank"),
        _at(F.floor(n / 2)).alias("p50_cut"), _at(F.floor(F.lit(0.9) * n)).alias("p90_cut"),
    )
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("p50_indexed", "p95_indexed")}
    return df.select(by).distinct().join(found, by, "left").withColumns(zero)


def audit_report(audit: DataFrame) -> DataFrame:
    """Per kind:source: calls, tokens, mean tokens, and the indexed 50th and 95th percentile of the latency; nulls count as 0, a missing kind or source as ?."""
    rows = audit.select(_key().alias("key"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("latency_ms", F.lit(0.0)).cast("double").alias("ms"))
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 6).alias("mean"))
    late = placed_values(rows, "key", "ms").groupBy("key").agg(indexed_percentile(0.5).alias("p50"), indexed_percentile(0.95).alias("p95"))
    return sums.join(late, "key")


def latency_tail(df: DataFrame, by: str, x: str, order: list[str], last: int = 100) -> DataFrame:
    """Median and exclusive 95th percentile of the last samples of each key; the maximum under 20 samples."""
    rn = F.row_number().over(Window.partitionBy(by).orderBy(*(F.desc(o) for o in order)))
    tail = df.withColumn("rn", rn).where(F.col("rn") <= last)
    n, values = F.count("*"), F.array_sort(F.collect_list(x))
    at = F.lit(0.95) * (n + 1)
    low = F.greatest(F.lit(1), F.least(F.floor(at).cast("int"), (n - 1).cast("int")))
    p95 = F.element_at(values, low) + (at - low) * (F.element_at(values, low + 1) - F.element_at(values, low))
    return tail.groupBy(by).agg(n.alias("n"), F.round(F.median(x), 6).alias("p50"), F.round(F.when(n < 20, F.max(x)).otherwise(p95), 6).alias("p95"))


def window_filter(ts: Column, show: str, today: Column) -> Column:
    """today is the same day, week the eight days up to it, all everything."""
    if show == "all":
        return F.lit(True)
    return F.to_date(ts) == today if show == "today" else F.to_date(ts) >= F.date_sub(today, 7)


def used_later(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """Journal chunks (session, ts, source) that a later event of the session touches (session, ts, path, text).

    Both sides meet on the session and the file name: an event either works on the path or
    mentions the name. Of all events of a session on one path, or with one name, only the
    latest time matters, so what meets a chunk are different paths, however many events
    there are; a time that is missing counts as later than all. A chunk is kept once.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    asked = chunks.withColumn("base", base(F.col("source"))).where("base <> ''")
    touched = events.where("path is not null").select("session", F.col("ts").alias("ets"), "path", base(F.col("path")).alias("base"))
    last = F.when(F.count_if(F.col("ets").isNull()) == 0, F.max("ets")).alias("ets")
    c, e = asked.alias("c"), touched.groupBy("session", "base", "path").agg(last).alias("e")
    met = (F.col("c.session") == F.col("e.session")) & (F.col("c.base") == F.col("e.base"))
    later = F.col("c.ts").isNull() | F.col("e.ets").isNull() | (F.col("e.ets") > F.col("c.ts"))
    by_path = c.join(e, met & later & S.same_target(F.col("e.path"), F.col("c.source")), "left_semi")
    # words that could be a file name are cut out of the texts, so mentions are an equi-join too
    named = events.where("text is not null").select("session", F.col("ts").alias("ets"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)([\w.-]+)"), F.lit(1)))).alias("base"))
    by_name = c.join(named.groupBy("session", "base").agg(last).alias("e"), met & later, "left_semi")
    return by_path.unionByName(by_name).distinct().drop("base")


def hook_stats(rows: DataFrame, used: DataFrame, shadow_used: DataFrame) -> DataFrame:
    """The usefulness measures of the hook channel in one aggregation.

    rows: (row_id, chunks array<struct<source,score,exists,lang>>, deduped, stale, target_is_code,
    shadow_chunks); used and shadow_used: row_id of rows with a chunk used later. Rates with
    an empty denominator are 0.
    """
    flag = lambda df, name: df.select("row_id").distinct().withColumn(name, F.lit(True))
    r = rows.join(flag(used, "used"), "row_id", "left").join(flag(shadow_used, "shadow_used"), "row_id", "left")
    count = lambda c: F.coalesce(F.try_to_number(c.cast("string"), F.lit("999999999")).cast("long"), F.lit(0))
    some, dd, st = F.coalesce(F.size("chunks") > 0, F.lit(False)), count(F.col("deduped")), count(F.col("stale"))
    candidate = some | (dd > 0) | (st > 0)
    rate = lambda a, b, d=4: F.round(F.when(b > 0, a / b).otherwise(0.0), d)
    n, ne, ca = F.count("*"), F.count_if(some), F.count_if(candidate)
    u = F.count_if(some & F.coalesce("used", F.lit(False)))
    sh = F.count_if(F.coalesce(F.size("shadow_chunks") > 0, F.lit(False)))
    return r.agg(
        n.alias("rows"), ne.alias("non_empty"), ca.alias("candidates"), rate(ne, n).alias("injection_rate"), rate(u, ne).alias("use_rate"), rate(100 * u, n, 2).alias("useful_per_100_edits"),
        rate(F.count_if(some & (dd > 0)), ne).alias("repeat_rate"), rate(F.count_if(some & F.exists("chunks", lambda x: ~x["exists"])), ne).alias("stale_rate"),
        rate(F.count_if(some & F.col("target_is_code") & F.exists("chunks", lambda x: x["lang"] == "ru")), ne).alias("lang_mismatch_rate"),
        rate(F.count_if(candidate & (dd > 0)), ca).alias("dedup_suppressed_rate"), rate(F.count_if(candidate & (st > 0)), ca).alias("stale_dropped_rate"),
        rate(F.count_if(F.coalesce("shadow_used", F.lit(False))), sh).alias("shadow_use_rate"), u.alias("used_events"), sh.alias("shadow_rows"),
    )


def journal_stats(journal: DataFrame, events: DataFrame, now: Column, days: float = 7.0) -> DataFrame:
    """hook_stats of a journal's window, and the search channel's own summary as the struct mcp.

    journal: (row_id, ts timestamp, session, target, kind, chunks, deduped, dropped.stale,
    shadow.chunks); events as for used_later. Rows without a readable time are left out, and
    rows of the search channel do not count for the hook's rates.
    """
    rows = journal.where(F.col("ts") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400)))
    hook = rows.where(F.coalesce("kind", F.lit("")) != "mcp")
    flat = lambda chunks: hook.select("row_id", "session", "ts", F.explode(chunks).alias("c")).select("row_id", "session", "ts", F.col("c.source").alias("source"))
    shaped = hook.select("row_id", "chunks", "deduped", F.col("dropped.stale").alias("stale"), S.is_code_target(F.col("target")).alias("target_is_code"), F.col("shadow.chunks").alias("shadow_chunks"))
    stats = hook_stats(shaped, used_later(flat(F.col("chunks")), events), used_later(flat(F.col("shadow.chunks")), events))
    return stats.join(F.broadcast(channel_summary(rows.where("kind = 'mcp'")).select(F.struct("*").alias("mcp"))))


def tag_drops(chunks: DataFrame, in_project: Column, min_score: float, exists: Column, seen: DataFrame) -> DataFrame:
    """Each chunk's first reason to go, in the chain's order: foreign, floor, stale, deduped; null if it stays.

    chunks has (session, ts, pos, key, rerank_score); seen has the (session, key) known before.
    """
    known = seen.select("session", "key").distinct().withColumn("seen_", F.lit(True))
    below = F.lit(min_score > 0) & F.col("rerank_score").isNotNull() & (F.col("rerank_score") < min_score)
    early = F.when(~in_project, "foreign").when(below, "floor").when(~exists, "stale")
    out = chunks.withColumn("early_", early).join(known, ["session", "key"], "left")
    again = F.row_number().over(Window.partitionBy("session", "key", F.col("early_").isNull()).orderBy("ts", "pos"))
    return out.withColumn("again_", again).withColumn("drop_reason", F.coalesce("early_", F.when(F.coalesce("seen_", F.lit(False)) | (F.col("again_") > 1), "deduped"))).drop("early_", "seen_", "again_")


def session_dedup(rows: DataFrame, gap_hours: int = 24) -> DataFrame:
    """The first row of each key within a session's run; a run ends after a gap of gap_hours without any row."""
    order = Window.partitionBy("session").orderBy("ts", "id")
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) > gap_hours * 3_600_000_000, F.lit(True))
    run = rows.withColumn("new_", new).withColumn("run", F.sum(F.col("new_").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.row_number().over(Window.partitionBy("session", "run", "key").orderBy("ts", "id"))
    return run.withColumn("first_", first).where("first_ = 1").drop("first_", "new_")


def migrate_aggregates(raw: DataFrame) -> DataFrame:
    """(key, sum, sumsq, n, least, most) of aggregates in JSON (key, value): a plain number of the old form counts for itself."""
    v = F.try_parse_json("value")
    old = F.try_variant_get(v, "$", "long")
    part = lambda name: F.try_variant_get(v, f"$.{name}", "long")
    return raw.select("key", F.coalesce(part("sum"), old).alias("sum"), F.coalesce(part("sumsq"), old * old).alias("sumsq"), F.coalesce(part("count"), old).alias("n"), F.coalesce(part("min"), old).alias("least"), F.coalesce(part("max"), old).alias("most"))


def golden_queries(used: DataFrame) -> DataFrame:
    """(query, repo, positives, channels, lang) mined from used events (query, repo, source, channel, lang, ts): one row a query and repository."""
    return used.groupBy("query", "repo").agg(F.array_sort(F.collect_set("source")).alias("positives"), F.array_sort(F.collect_set("channel")).alias("channels"), F.min_by("lang", F.struct("ts", "source")).alias("lang"))


def channel_summary(rows: DataFrame) -> DataFrame:
    """searches, those with chunks, all chunks and the Russian share of the search channel (chunks array<struct<lang,...>>)."""
    n = F.coalesce(F.size("chunks"), F.lit(0))
    ru = F.coalesce(F.size(F.filter("chunks", lambda c: c["lang"] == "ru")), F.lit(0))
    total = F.sum(n)
    return rows.agg(F.count("*").alias("searches"), F.count_if(n > 0).alias("with_chunks"), F.coalesce(total, F.lit(0)).alias("chunks_total"), F.round(F.when(total > 0, F.sum(ru) / total).otherwise(0.0), 4).alias("ru_share"))


def pointer_lines(chunks: DataFrame, root: str, most: int = 2000, sentence: int = 160) -> DataFrame:
    """(session, block): a line a chunk (session, pos, source, header, score, text), the last ones left out until the block fits."""
    rel = F.when(F.col("source").startswith(root.rstrip("/") + "/"), F.substring("source", F.lit(len(root.rstrip("/")) + 2), F.length("source"))).otherwise(F.col("source"))
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    first = F.substring(F.regexp_extract(flat, r"^(.*?[.!?])(?:\s|$)|^(.*)$", 0), 1, sentence)
    head = F.when(F.coalesce(F.col("header"), F.lit("")) != "", F.concat(F.lit(" § "), F.col("header"))).otherwise(F.lit(""))
    line = F.concat(F.lit("- "), rel, head, F.lit(" ("), F.format_string("%.2f", F.col("score")), F.lit(") "), F.trim(first))
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1
    kept = chunks.withColumn("line", line).withColumn("upto", upto).where(F.col("upto") <= most)
    return kept.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x")).select("session", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("block"))
