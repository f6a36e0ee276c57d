"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, cut

#: Bits of the seeded order's parts whose token sums are added up: a leaf's cut falls into one of 1,024, and there again.
BITS = 10
#: Leaves that the tree may have; their sums go to the driver and the plan back as a broadcast.
MAX_LEAVES = 100_000

Leaf = tuple[str, str, str]


def count_tokens(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def water_fill(target: float, weights: list[float], caps: list[float]) -> list[float]:
    """Shares of a target by weight, none above its cap; what a full one leaves goes to the others by weight.

    Children without weight get something only after all weighted ones are full, in proportion to their caps.
    """
    out = [0.0] * len(weights)
    for ws in (weights, [c if not w else 0.0 for w, c in zip(weights, caps, strict=True)]):
        open_ = {i for i, w in enumerate(ws) if w > 0 and caps[i] > out[i]}
        while open_ and target > 1e-9:
            total = sum(ws[i] for i in open_)
            full = [i for i in open_ if target * ws[i] / total >= caps[i] - out[i]]
            if not full:
                for i in open_:
                    out[i] += target * ws[i] / total
                return out
            for i in full:
                target -= caps[i] - out[i]
                out[i] = caps[i]
                open_.discard(i)
    return out


def allot(available: Mapping[Leaf, int], total: int, domains: Mapping[str, float], langs: Mapping[str, Mapping[str, float]], sources: Mapping[str, float], epochs: int) -> dict[Leaf, int]:
    """Token budgets of the leaves of the domain-language-source tree.

    Weights propagate from the root; names that a level does not list weigh nothing,
    except at the source level, where they weigh 1. A leaf holds at most `epochs` times
    its tokens and an inner node what its leaves hold, so what a leaf cannot fill goes to
    its siblings, and only what all of them cannot fill to its parent's siblings.
    """
    tree: dict[str, dict[str, dict[str, int]]] = {}
    for (d, lang, s), n in sorted(available.items()):
        tree.setdefault(d, {}).setdefault(lang, {})[s] = n * epochs
    caps = {d: {lang: sum(x.values()) for lang, x in y.items()} for d, y in tree.items()}
    ds = list(tree)
    exact: dict[Leaf, float] = {}
    for d, share in zip(ds, water_fill(total, [domains.get(d, 0.0) for d in ds], [sum(caps[d].values()) for d in ds]), strict=True):
        ls = list(tree[d])
        for lang, part in zip(ls, water_fill(share, [langs.get(d, {}).get(x, 0.0) for x in ls], [caps[d][x] for x in ls]), strict=True):
            ss = list(tree[d][lang])
            for s, budget in zip(ss, water_fill(part, [sources.get(x, 1.0) for x in ss], [tree[d][lang][x] for x in ss]), strict=True):
                exact[d, lang, s] = budget
    out = {k: int(v + 1e-6) for k, v in exact.items()}
    left = min(total, sum(n * epochs for n in available.values())) - sum(out.values())
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k)):
        if left > 0 and out[k] < available[k] * epochs:
            out[k] += 1
            left -= 1
    return out


def mix(docs: DataFrame, domain: Column, domains: Mapping[str, float], langs: Mapping[str, Mapping[str, float]], sources: Mapping[str, float] | None = None, share: float = 0.75, epochs: int = 2, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", info_col: str = "mix_") -> DataFrame:
    """The chosen rows with all their columns, and a struct column info_col<epoch, domain, tokens, take>.

    The budget is `share` of all tokens; allot() deals it to the leaves. Each leaf orders
    its documents anew in every epoch by a seeded hash of the id and takes tokens from the
    front: whole epochs, then a prefix of the next one. `take` is what the budget covers of
    a document's tokens: all of them but for the one that the prefix ends in.

    A prefix is found without sorting a leaf, on rows without their texts: token sums of
    hash buckets give the bucket where it ends, and sums of that bucket's buckets the part
    (a millionth of the leaf) whose rows are ordered. All rows are then decided where they
    are read, so texts are not shuffled.

    Null languages and sources are leaves of their own, named ''. Null and empty texts have
    no tokens; texts are counted whole, however long. Ids may have any type. Null and
    repeated ids share one place in the order; rows of one place follow each other by a
    hash of all their columns, and rows that are wholly alike are taken as often as the
    budget covers them. An empty table gives no rows. The table's own columns may have any
    names but info_col, which raises an error, as do more than MAX_LEAVES leaves.
    """
    if info_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table has a column {info_col}")
    spark, leaf = docs.sparkSession, ["d", "l", "s"]
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(domain, F.lit("")).alias("d"), F.coalesce(F.col(lang_col), F.lit("")).alias("l"),
        F.coalesce(F.col(source_col), F.lit("")).alias("s"), F.col(id_col).alias("id"), F.xxhash64(*plain).alias("sig"),
    )
    tokens = count_tokens(F.col("row").getField(text_col))
    narrow = cut(rows.select(*leaf, "id", "sig", tokens.alias("n")))
    sums = narrow.groupBy(*leaf).agg(F.sum("n").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    available = {(r["d"], r["l"], r["s"]): r["n"] for r in sums}
    total = int(share * sum(available.values()))
    budget = allot(available, total, domains, langs, sources or {}, epochs)
    plan = [(*k, b // available[k] if available[k] else 0, b % available[k] if available[k] else 0) for k, b in budget.items()]
    plan_df = spark.createDataFrame(plan, "d string, l string, s string, full long, rest long")

    def placed(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(plan_df), leaf).withColumn("h", F.xxhash64(F.lit(seed), "full", "id")).withColumn("b1", F.shiftrightunsigned("h", 64 - BITS))

    def first_full(df: DataFrame, order: list[str]) -> DataFrame:
        """Of each leaf the first place in this order where its prefix is full, and the tokens before it."""
        upto = F.sum("n").over(Window.partitionBy(*leaf).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
        found = df.groupBy(*leaf, "rest", "before", *order).agg(F.sum("n").alias("n")).withColumn("upto", upto)
        return found.where("upto >= rest and upto - n < rest").select(*leaf, *order, (F.col("upto") - F.col("n")).alias("before"))

    open_ = placed(narrow).where("rest > 0").withColumn("b2", F.shiftrightunsigned("h", 64 - 2 * BITS)).withColumn("before", F.lit(0).cast("long"))
    for part in ("b1", "b2"):
        open_ = open_.drop("before").join(F.broadcast(first_full(open_, [part])), [*leaf, part])
    ends = [(r["d"], r["l"], r["s"], r["h"], r["sig"], r["before"]) for r in first_full(open_, ["h", "sig"]).collect()]
    ends_df = spark.createDataFrame(ends, "d string, l string, s string, end_h long, end_sig long, before long")
    marked = placed(rows).join(F.broadcast(ends_df), leaf, "left")

    none = F.array().cast("array<long>")
    end_b = F.shiftrightunsigned("end_h", 64 - BITS)
    inside = (F.col("b1") < end_b) | ((F.col("b1") == end_b) & ((F.col("h") < F.col("end_h")) | ((F.col("h") == F.col("end_h")) & (F.col("sig") < F.col("end_sig")))))
    full = F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).otherwise(none)
    more = F.when((F.col("rest") > 0) & inside, F.array("full")).otherwise(none)
    sure = marked.withColumn("epoch", F.explode(F.concat(full, more))).select("row", "epoch", "d", tokens.alias("n")).withColumn("take", F.col("n"))
    # the place that the prefix ends in: one row, or rows that are wholly alike
    last = marked.where("rest > 0 and h = end_h and sig = end_sig").groupBy(*leaf).agg(F.first("row").alias("row"), F.first("full").alias("epoch"), F.first(F.col("rest") - F.col("before")).alias("left"))
    last = last.withColumn("n", tokens).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("left") / F.col("n")) - 1)))
    edge = last.select("row", "epoch", "d", "n", F.least(F.col("n"), F.col("left") - F.col("i") * F.col("n")).alias("take"))
    info = F.struct("epoch", F.col("d").alias("domain"), F.col("n").alias("tokens"), "take")
    return sure.unionByName(edge).select("row.*", info.alias(info_col))
