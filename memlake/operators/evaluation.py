"""Ranking metrics, comparisons, gates and samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scalars as S
from memlake.operators import chunkers
from memlake.registry import lookup
from memlake.shared import cut, small


def doc_run(hits: DataFrame) -> DataFrame:
    """(qid, docid, score): of several hits of a document the last, lowest-ranked one counts."""
    return hits.groupBy("qid", "docid").agg(F.max_by("score", "rk").alias("score"))


def ir_metrics(qrels: DataFrame, run: DataFrame, ks: Sequence[int] = (1, 5, 10, 20), by: Sequence[str] = ()) -> DataFrame:
    """recall@k, MRR and nDCG@10 as means over all queries of qrels; queries without a run count as zero.

    qrels (qid, docid, rel, *by), run (qid, docid, score). Ties order by falling docid, as
    the usual scorer of such runs does.
    """
    ranks = run.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("docid")))).select("qid", "docid", "rank")
    good = qrels.where("rel > 0").join(ranks, ["qid", "docid"], "left")
    gain = F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    n = F.count("*")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    per = good.groupBy("qid", *by).agg(*((F.count_if(F.col("rank") <= k) / n).alias(f"recall_at_{k}") for k in ks), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"), (F.sum(gain) / ideal).alias("ndcg_at_10"))
    names = [*(f"recall_at_{k}" for k in ks), "mrr", "ndcg_at_10"]
    out = per.groupBy(*by) if by else per
    return out.agg(F.count("*").alias("queries"), *(F.round(F.avg(x), 6).alias(x) for x in names))


def chunk_recall(gold: DataFrame, run: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of gold chunks (qid, gold array) among the first k; 0 without gold."""
    top = run.where(F.col("rk") <= k).groupBy("qid").agg(F.collect_set("id").alias("top"))
    share = F.size(F.array_intersect(F.array_distinct("gold"), F.coalesce("top", F.array().cast(gold.schema["gold"].dataType)))) / F.size(F.array_distinct("gold"))
    return gold.join(top, "qid", "left").select("qid", F.round(F.when(F.size("gold") > 0, share).otherwise(0.0), 6).alias("recall"))


def chunk_run(hits: DataFrame) -> DataFrame:
    """(qid, id, score, rk) of chunk hits (qid, chunk_id, score, rk): each chunk once, at its first rank, with its last score.

    Hits without a chunk id are skipped; chunks of one document all stay.
    """
    per = hits.where("chunk_id is not null").groupBy("qid", F.col("chunk_id").alias("id")).agg(F.max_by("score", "rk").alias("score"), F.min("rk").alias("first"))
    return per.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("first"))).drop("first")


def gold_chunks(gold: DataFrame, files: DataFrame, chunker: str = "markdown") -> DataFrame:
    """(path, chunk_id) of the files (path, text) that gold (path) names, chunked anew: ids match an ingested corpus."""
    kept = files.join(gold.select("path").distinct(), "path", "left_semi")
    parts = chunkers.chunk_documents(kept, chunker, min_tokens=0)
    return parts.select("path", S.bench_chunk_id(F.col("path"), F.col("document")).alias("chunk_id")).distinct()


def joined_top(hits: DataFrame, k: int = 5) -> DataFrame:
    """(qid, blob): the texts of the first k hits in order."""
    return hits.where(F.col("rk") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", "text"))).alias("x")).select("qid", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("blob"))


def substring_recall(required: Column, blob: Column) -> Column:
    """The share of required substrings that the blob holds; 0 without any."""
    return F.when(F.size(required) > 0, F.size(F.filter(required, lambda s: blob.contains(s))) / F.size(required)).otherwise(0.0)


def heuristic_recall(answer: Column, blob: Column) -> Column:
    """The share of the answer's words of four letters or more in the blob; without any, whether it holds the whole answer."""
    low, text = F.lower(blob), F.lower(answer)
    tokens = F.filter(F.split(text, r"\s+"), lambda t: F.length(t) >= 4)
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: low.contains(t))) / F.size(tokens)).otherwise(low.contains(text).cast("double"))


def tokens_per_correct(tokens: Column, recall: Column) -> Column:
    return F.when(recall > 0, tokens / recall).otherwise(tokens.cast("double"))


def axis_means(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means by axis; nulls drop out of their metric, a group of nulls is 0."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in metrics))


def gate(scores: DataFrame, floors: DataFrame, epsilon: float = 0.01, baseline: DataFrame | None = None) -> DataFrame:
    """(metric, value, bound, ok): values may not fall under their floor, latencies not exceed it.

    With a baseline, its value less (or plus) epsilon is the bound instead. Null values and
    metrics without a bound are skipped.
    """
    late = F.split("metric", r"\.")[F.size(F.split("metric", r"\.")) - 1].startswith("latency_")
    bounds = floors if baseline is None else baseline.withColumn("bound", F.when(late, F.col("bound") + epsilon).otherwise(F.col("bound") - epsilon))
    return scores.where("value is not null").join(bounds, "metric").withColumn("ok", F.when(late, F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound")))


def baseline_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """(metric, delta) for the metrics whose values are numbers on both sides."""
    a, b = new.select("metric", F.expr("try_cast(value as double)").alias("x")), old.select("metric", F.expr("try_cast(value as double)").alias("y"))
    return a.join(b, "metric").where("x is not null and y is not null").select("metric", F.round(F.col("x") - F.col("y"), 6).alias("delta"))


def stratified_quota(df: DataFrame, by: Sequence[str], target: int) -> DataFrame:
    """(by, n, quota): a share of the target by size, at least 1, at most the bucket."""
    n = cut(df.groupBy(*by).agg(F.count("*").alias("n")))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select(*by, "n", F.least(F.col("n"), F.greatest(F.lit(1), F.rint(F.lit(float(target)) * F.col("n") / F.col("total")).cast("long"))).alias("quota"))


def stratified(df: DataFrame, by: Sequence[str], target: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """A sample of exactly target rows (or all, if fewer): each bucket's quota by a seeded hash, then trimmed or padded.

    A window with a limit finds a bucket's first rows, so no bucket is sorted as a whole.
    """
    h = seeded_order(seed, F.col(id_col))
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(h, id_col))
    placed = df.withColumn("rn_", rn).where(F.col("rn_") <= target).join(small(stratified_quota(df, by, target).drop("n")), list(by))
    return placed.orderBy((F.col("rn_") > F.col("quota")).cast("int"), "rn_", h, id_col).limit(target).drop("rn_", "quota")


def seeded_order(seed: int, *of: Column) -> Column:
    """A hash to order or draw by that any engine can recompute: the MD5 of seed and values joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in of)))


def smoke_subset(records: DataFrame, per_axis: int = 2, seed: int = 0, axis: str = "axis", id_col: str = "id") -> DataFrame:
    """(id, axis) of a few records of each axis, the first by a seeded hash; smaller axes go in whole."""
    rn = F.row_number().over(Window.partitionBy(axis).orderBy(seeded_order(seed, F.col(id_col)), id_col))
    return records.withColumn("rn_", rn).where(F.col("rn_") <= per_axis).select(F.col(id_col).alias("id"), F.col(axis).alias("axis")).orderBy("axis", "id")


def paired_samples(peer: DataFrame, own: DataFrame, keys: Sequence[str] = ("axis", "col", "metric", "qid")) -> DataFrame:
    """(*keys, a, b): values of queries that both sides answered, a the peer's and b the own."""
    return peer.select(*keys, F.col("value").alias("a")).join(own.select(*keys, F.col("value").alias("b")), list(keys))


#: Bounds of a uniform variable from which a Poisson variable of mean 1 is at least 1, 2, 3, ...
POISSON = [math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def paired_bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(delta, ci_lower, ci_upper, verdict) of a - b over (qid, a, b), by a Poisson bootstrap from a seeded hash.

    A query counts in a resample as often as a Poisson variable of mean 1 says, which a
    hash of both decides. So resamples are sums that merge: every task adds up its own
    queries' shares, and no list of differences is ever held. A resample without any query
    has no mean. Bounds are interpolated percentiles; delta is exact.
    """
    draws = pairs.select("qid", (F.col("a") - F.col("b")).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("id"))
    u = F.conv(F.substring(seeded_order(seed, F.col("id"), F.col("qid")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    times = draws.select("id", "d", sum((u >= c).cast("int") for c in POISSON).alias("w"))
    means = times.groupBy("id").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")).alias("m"))
    ci = means.agg(F.percentile("m", 0.025).alias("ci_lower"), F.percentile("m", 0.975).alias("ci_upper"))
    mean = pairs.agg(F.avg(F.col("a") - F.col("b")).alias("delta"))
    return mean.join(F.broadcast(ci)).withColumn("verdict", verdict(F.col("ci_lower"), F.col("ci_upper")))


def verdict(lower: Column, upper: Column) -> Column:
    """win where the whole interval is above 0, loss where it is below, else tie."""
    return F.when(lower > 0, "win").when(upper < 0, "loss").otherwise("tie")


# The cells that the rules read, and the steps and limits of what they propose.
CELLS = {"r1": "decision_rationale.own.recall_at_1", "r5": "decision_rationale.own.recall_at_5", "ndcg": "code_fact.combined.ndcg_at_10", "late": "code_fact.combined.latency_ms_p95", "r20": "code_fact.combined.recall_at_20", "r5c": "code_fact.combined.recall_at_5"}
PREFETCH_STEP, PREFETCH_CAP, TOP_N_STEP, TOP_N_FLOOR, COSINE_STEP, COSINE_FLOOR, DEPTH_DELTA = 10, 80, 10, 20, 0.02, 0.90, 0.25


def diagnose(cells: DataFrame, *, arm_n: int = 50, rerank_n: int = 50, dedup: bool = False, dedup_cosine: float = 0.97) -> DataFrame:
    """(field, value) of settings to change, from cells (metric, value, bound). A missing value meets no rule; a missing bound holds.

    First-place recall under its floor while recall at 5 holds: fetch more an arm. nDCG
    under its floor with the latency within its ceiling: let depth follow the query. Latency over its
    ceiling: rerank fewer. Recall at 20 under its floor while recall at 5 holds: drop near copies, or
    more of them where they are dropped already.
    """
    at = lambda name, what: F.max(F.when(F.col("metric") == CELLS[name], F.col(what)))
    row = cells.agg(*(at(c, w).alias(f"{c}_{w}") for c in CELLS for w in ("value", "bound")))
    no = F.lit(False)
    below = lambda c: F.coalesce(F.col(f"{c}_value") < F.col(f"{c}_bound"), no)
    holds = lambda c: F.col(f"{c}_value").isNotNull() & F.coalesce(F.col(f"{c}_value") >= F.col(f"{c}_bound"), F.lit(True))
    room = F.col("late_value").isNotNull() & F.coalesce(F.col("late_value") <= F.col("late_bound"), F.lit(True))
    over = F.coalesce(F.col("late_value") > F.col("late_bound"), no)
    change = lambda cond, field, value: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(str(value).lower()).alias("value")))
    poor, deep, thin = below("r1") & holds("r5"), below("ndcg") & room, below("r20") & holds("r5c")
    rules = F.array(
        change(poor, "arm_n", min(arm_n + PREFETCH_STEP, PREFETCH_CAP)), change(deep, "adaptive", True), change(deep, "adaptive_delta", DEPTH_DELTA), change(over, "rerank_n", max(rerank_n - TOP_N_STEP, TOP_N_FLOOR)),
        change(thin, "dedup_cosine", round(max(COSINE_FLOOR, dedup_cosine - COSINE_STEP), 6)) if dedup else change(thin, "content_dedup", True),
    )
    return row.select(F.explode(F.array_compact(rules)).alias("r")).select("r.*")


def response_variance(runs: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(max - min) / mean of each metric over runs; 0 where the mean is 0."""
    spread = lambda m: F.round(F.when(F.avg(m) != 0, (F.max(m) - F.min(m)) / F.avg(m)).otherwise(0.0), 6)
    return runs.groupBy(*by).agg(*(spread(m).alias(m) for m in metrics))


def regression_breaches(row: DataFrame, recall: float = 0.60, tokens: float = 4000, p95: float = 500) -> DataFrame:
    """row (recall, tokens, p95) with the list of limits that it breaks."""
    checks = F.array(F.when(F.col("recall") < recall, "recall"), F.when(F.col("tokens") > tokens, "tokens"), F.when(F.col("p95") > p95, "p95"))
    return row.withColumn("breaches", F.array_compact(checks))


def record_metrics(records: DataFrame) -> DataFrame:
    """Of records (qid, question, contexts array, answer, recall): the tokens that go in (question and contexts), tokens a
    correct answer, the contexts' tokens to those of the answer, and the cost of writing. Judged metrics need a model and are null."""
    t = S.token_estimate
    inside = F.aggregate(F.transform("contexts", lambda c: t(F.coalesce(c, F.lit("")))), F.lit(0).cast("long"), lambda a, x: a + x)
    total, answer = t(F.col("question")) + inside, t(F.col("answer"))
    none = F.lit(None).cast("double")
    return records.select("qid", total.alias("in_tokens"), F.round(tokens_per_correct(total, F.col("recall")), 6).alias("tokens_per_correct"), F.round(inside / answer, 6).alias("compression"), (total + answer).cast("double").alias("write_cost"),
                          none.alias("context_precision"), none.alias("context_recall"), none.alias("answer_relevance"))


def collapse_envelope(cells: DataFrame) -> DataFrame:
    """(axis, metric, own, other, combined): an axis that only one corpus has takes its own column as the combined one."""
    return cells.withColumn("combined", F.when(F.col("other").isNull(), F.col("own")).otherwise(F.col("combined")))


def citations(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of decision records (path, text): (path, question, gold) and the cited paths that files (path) lack, (path, cited).

    The question is the first paragraph of the problem; gold holds the record itself and
    each existing path that its decision cites. Records without a problem are left out.
    """
    problem, decision = (F.regexp_extract("text", p, 1) for p in (S.PROBLEM_SECTION, S.DECISION_SECTION))
    rows = records.withColumn("problem", F.trim(problem)).where("problem <> ''").select("path", F.trim(F.split("problem", "\n\n")[0]).alias("question"), F.array_distinct(F.regexp_extract_all(decision, F.lit(S.CITED_PATH), F.lit(1))).alias("cited"))
    cited = rows.select("path", F.explode("cited").alias("cited"))
    there = files.select(F.col("path").alias("cited")).distinct()
    found = cited.join(there, "cited", "left_semi").groupBy("path").agg(F.collect_set("cited").alias("found"))
    gold = rows.join(found, "path", "left").select("path", "question", F.array_sort(F.array_distinct(F.concat(F.array("path"), F.coalesce("found", F.array().cast("array<string>"))))).alias("gold"))
    return gold, cited.join(there, "cited", "left_anti").select("path", "cited")


def within_after_limit(hits: DataFrame, names: DataFrame, k: int, on: str = "repo") -> DataFrame:
    """The first k hits of each query, and only then those of the named repositories: a peer's limit comes before the filter."""
    return hits.where(F.col("rk") <= k).join(names.select(on).distinct(), on, "left_semi")


@dataclass(frozen=True)
class Suite:
    """What a run evaluates: qrels (qid, docid, rel, axis), and a run (qid, docid, score) made by a function of a backend's name."""

    qrels: DataFrame
    run: Callable[[str], DataFrame]
    floors: Mapping[str, float]


def run_suite(suite: Suite | str, backend: str = "tuned_hybrid", axis: str = "axis") -> tuple[DataFrame, DataFrame]:
    """A report (axis, metric, value) with the axis `overall`, and its gate (metric, value, bound, ok) against the suite's floors."""
    suite = lookup("suite", suite)() if isinstance(suite, str) else suite
    found, spark = cut(suite.run(backend)), suite.qrels.sparkSession
    wide = ir_metrics(suite.qrels, found, by=(axis,)).unionByName(ir_metrics(suite.qrels, found).withColumn(axis, F.lit("overall")))
    names = [c for c in wide.columns if c not in (axis, "queries")]
    report = wide.select(F.col(axis).alias("axis"), F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in names)), F.array(*names))).alias("metric", "value"))
    floors = spark.createDataFrame(sorted(suite.floors.items()), "metric string, bound double")
    return report, gate(report.select(F.concat_ws(".", "axis", "metric").alias("metric"), "value"), floors)
