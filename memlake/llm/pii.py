"""Personal data: proposed by regular expressions, confirmed by checksums, scored by context.

Everything runs inside the JVM as SQL expressions; there is no Python on the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_EDGE = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Patterns, in Java's syntax. Possessive repeats and the look-behinds keep matching linear in the
#: text and free of recursion; they leave the matches of the plain patterns unchanged.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _EDGE[0] + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?" + _EDGE[1],
    "ssn": _EDGE[0] + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _EDGE[1],
}
#: Kinds of the base contract; the others are what checksums and context add.
BASE = ("email", "ip", "card", "phone")
#: Score in percent of a confirmed span, what a context word adds, and the words.
SCORES = {"email": (90, 5), "ip": (60, 20), "card": (80, 15), "phone": (60, 25), "iban": (80, 15), "ssn": (40, 45)}
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social security|tax id",
}
#: Code points before a span in which context words count, and the score in percent that a further kind needs.
NEAR, LEAST = 40, 50
#: Code points of the parts that a text is cut into, so that context is looked up without walking the whole text.
PART = 1024


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): spans array<struct<kind,s,e,score>> by kind as listed in PATTERNS, then start.

    Matches are leftmost and do not overlap within a kind; places count code points and
    ends are exclusive. Null and empty texts have no spans; null and repeated ids are
    kept, a row each; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    parts: list[Column] = []
    # matches first, the pieces between them and the text's parts only where there are matches
    df = df.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in PATTERNS.items()))
    some = F.greatest(*(F.size(f"m_{k}") for k in PATTERNS)) > 0
    df = df.withColumn("parts", F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))))
    none = "cast(array() as array<struct<kind:string,s:int,e:int,score:int>>)"
    for k, p in PATTERNS.items():
        parts.append(F.when(F.size(f"m_{k}") > 0, _spans_of(k, p)).otherwise(F.expr(none)))
    return df.select(F.col("doc_id").alias(id_col), F.concat(*parts).alias("spans"))


def running(sizes: Column) -> Column:
    """Running sums of an array of integers, added up block by block.

    Appending to an array copies it, so blocks hold about the square root of the array: the
    work grows with n^1.5 instead of n^2.
    """
    none, last = F.array().cast("array<int>"), lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    sums = lambda xs: F.aggregate(xs, none, lambda a, x: F.concat(a, F.array((last(a) + x).cast("int"))))
    block = F.ceil(F.sqrt(F.size(sizes))).cast("int")
    starts = F.sequence(F.lit(1), F.size(sizes), block)
    inner = F.transform(starts, lambda i: sums(F.slice(sizes, i, block)))
    upto = F.transform(F.array(inner), lambda x: F.struct(x.alias("x"), sums(F.transform(x, lambda a: F.element_at(a, -1))).alias("ends")))[0]
    return F.flatten(F.transform(F.array(upto), lambda u: F.flatten(F.transform(u["x"], lambda a, i: F.transform(a, lambda v: (v + F.when(i > 0, F.get(u["ends"], i - 1)).otherwise(0)).cast("int"))))))


def _spans_of(kind: str, pattern: str) -> Column:
    m, p = F.col(f"m_{kind}"), F.split("text", pattern, -1)
    both = F.zip_with(m, F.slice(p, F.lit(1), F.size(m)), lambda a, b: F.length(a) + F.length(b))
    ends = F.transform(F.array(both), running)[0]
    placed = F.zip_with(m, ends, lambda a, e: F.struct((e - F.length(a)).alias("s"), e.alias("e"), a.alias("m")))
    base, more = SCORES[kind]

    def score(x: Column) -> Column:
        since = F.greatest(x["s"] - NEAR, F.lit(0))
        part = F.floor(since / PART).cast("int")
        near = F.concat(F.get(F.col("parts"), part), F.coalesce(F.get(F.col("parts"), part + 1), F.lit("")))
        before = F.lower(F.substring(near, since - part * PART + 1, x["s"] - since))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), (F.lit(base) + F.when(before.rlike(CONTEXT[kind]), more).otherwise(0)).alias("score"))

    scored = F.transform(F.filter(placed, lambda x: _check(kind, x["m"])), score)
    return scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= LEAST)


def _check(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(f"^{_OCTET}([.]{_OCTET}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "iban":
        packed = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(packed).between(15, 34), mod97(packed)).otherwise(False)
    return F.lit(True)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def add(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, spans as text and the SHA-256 of the base spans, from find_pii's rows."""

    def written(keep: Column | None = None) -> Column:
        hits = F.col("spans") if keep is None else F.filter("spans", lambda x: x["kind"].isin(*BASE))
        return F.array_join(F.transform(hits, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    return found.select(
        id_col,
        *(F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE),
        F.sha2(written(F.lit(True)), 256).alias("base_sha256"),
        written().alias("spans"),
        F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


#: DuckDB's form: plain patterns (its engine is linear), the same confirmations and scores.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}


def oracle() -> str:
    """The query's rows in DuckDB's SQL."""
    sql = "with d as (select doc_id, coalesce(text, '') as text from documents)"
    for k, p in _PLAIN.items():
        digits = "regexp_replace(m, '[^0-9]', '', 'g')"
        check = {
            "ip": f"regexp_matches(m, '^{_OCTET}([.]{_OCTET}){{3}}$')",
            "phone": f"length({digits}) between 8 and 15",
            "card": f"length({digits}) between 16 and 19 and list_sum(list_transform(range(1, length({digits}) + 1), lambda i: case when i % 2 = 1 then {digits}[-i]::int when {digits}[-i]::int > 4 then 2 * {digits}[-i]::int - 9 else 2 * {digits}[-i]::int end)) % 10 = 0",
            "iban": "length(replace(m, ' ', '')) between 15 and 34 and list_reduce(list_prepend(0::bigint, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: case when c between '0' and '9' then c::bigint else ascii(c)::bigint - 55 end)), lambda a, v: (a * (case when v > 9 then 100 else 10 end) + v) % 97) = 1",
        }.get(k, "true")
        base, more = SCORES[k]
        least = f"where score >= {LEAST}" if k not in BASE else ""
        sql += f""",
{k}_m as (select doc_id, text, regexp_extract_all(text, '{p}') as ms, string_split_regex(text, '{p}') as ps from d),
{k}_s as (select doc_id, text, ms[i] as m, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::bigint as s
  from (select *, unnest(range(1, len(ms) + 1)) as i from {k}_m where len(ms) > 0)),
{k}_k as (select * from (select doc_id, '{k}' as kind, {list(_PLAIN).index(k)} as o, s, s + length(m) as e,
  {base} + case when regexp_matches(lower(substr(text, greatest(s - {NEAR}, 0) + 1, s - greatest(s - {NEAR}, 0))), '{CONTEXT[k]}') then {more} else 0 end as score
  from {k}_s where {check}) {least})"""
    union = " union all ".join(f"select * from {k}_k" for k in _PLAIN)
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)
    names = ", ".join(f"'{k}'" for k in BASE)
    return sql + f""",
al as ({union}),
g as (select doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' order by o, s) filter (kind in ({names})) as b,
  string_agg(kind || ':' || s || ':' || e, ',' order by o, s) as spans, string_agg(score::varchar, ',' order by o, s) as scores from al group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in BASE)}, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores
from d left join g on d.doc_id = g.doc_id"""
