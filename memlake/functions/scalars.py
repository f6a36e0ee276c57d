"""Scalar functions as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the tokenizer's pattern, for regexp_extract_all.
WORD = r"([\p{L}\p{N}_]+)"
# Weights and scales of the complexity score.
COMPLEXITY = {"tokens": (0.40, 64), "clauses": (0.25, 3), "filters": 0.15, "identifiers": (0.20, 2)}


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def path_parts(path: Column) -> Column:
    """Segments of a path; a leading ./ or / and empty or single-dot segments go, leading dots of names stay."""
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def path_prefixes(path: Column) -> Column:
    """The accumulated prefixes of a path: src, src/a, src/a/b.py."""
    parts = path_parts(path)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def room(path: Column, rooms: Mapping[str, Sequence[str]]) -> Column:
    """The first room, in order, one of whose keywords is a whole segment of the path; else null."""
    parts = path_parts(path)
    found = [F.when(F.arrays_overlap(parts, F.array(*(F.lit(k) for k in keys))), F.lit(name)) for name, keys in rooms.items() if keys]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def glob_pattern(glob: str) -> str:
    """A case-sensitive glob as a regular expression; * and ? cross slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = re.sub(r"([\[\\&])", r"\\\1", glob[i + 1 : end])
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def excluded(path: Column, globs: Sequence[str]) -> Column:
    """Whether any glob matches the whole path."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chunk_key(source: Column, text: Column) -> Column:
    """The first 16 digits of the SHA-256 of source and text joined by a bar."""
    return F.substring(sha256(F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(text, F.lit("")))), 1, 16)


def bench_chunk_id(doc: Column, text: Column) -> Column:
    """doc#, and the first 12 digits of the text's SHA-1."""
    return F.concat(doc, F.lit("#"), F.substring(F.sha1(text.cast("binary")), 1, 12))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(path: Column, idx: Column, content_hash: Column) -> Column:
    return uuid5(F.concat(path, F.lit("#chunk="), idx.cast("string"), F.lit("#hash="), content_hash))


def message_point_id(session: Column, message: Column, idx: Column) -> Column:
    """Every piece of a message has its own index, so none overwrites another."""
    return uuid5(F.concat(session, F.lit("#message="), message, F.lit("#chunk="), idx.cast("string")))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens, at most 64, or untitled."""
    s = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 64)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("untitled")).otherwise(s)


def cyrillic(text: Column) -> Column:
    """ru if more than 30 % of the letters are Cyrillic, else en."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    own = F.length(F.regexp_replace(text, r"[^\p{IsCyrillic}]", ""))
    return F.when((letters > 0) & (own > 0.3 * letters), F.lit("ru")).otherwise(F.lit("en"))


def preview(text: Column, cap: int) -> Column:
    """The first cap - 1 code points and an ellipsis where the text is longer than cap; cap 0 is the whole text."""
    return text if cap == 0 else F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap - 1), F.lit("…"))).otherwise(text)


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def complexity(text: Column, has_filter: Column) -> Column:
    """How demanding a query is, from 0 to 1: its length, clauses, filters and code identifiers."""
    low = F.lower(text)
    clauses = occurrences(text, "?") + occurrences(low, " and ") + occurrences(low, " or ") + occurrences(text, ";") + occurrences(text, ":")
    ids = F.regexp_count(text, F.lit(r"[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+")) + occurrences(text, "::") + occurrences(text, ".py") + F.floor(occurrences(text, "`") / 2)
    one = F.lit(1.0)
    part = lambda n, of: F.least(one, n / F.lit(float(of)))
    c = COMPLEXITY
    return (c["tokens"][0] * part(token_estimate(text), c["tokens"][1]) + c["clauses"][0] * part(clauses, c["clauses"][1])
            + F.when(has_filter, F.lit(c["filters"])).otherwise(F.lit(0.0)) + c["identifiers"][0] * part(ids, c["identifiers"][1]))


def effective_k(k: int, score: Column, delta: float, k_max: int) -> Column:
    """k grown by the query's complexity, at most k_max and never under k."""
    return F.greatest(F.lit(k), F.least(F.lit(k_max), F.floor(F.lit(float(k)) * (1 + delta * score)).cast("int")))


def age_days(ts: Column, now: Column) -> Column:
    """Days from ts to now; null for a null time."""
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)


def parse_time(text: Column) -> Column:
    """An ISO time, Z or offset allowed; without one it counts as UTC. Null where it cannot be read."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def recency(ts: Column, now: Column, boost: float = 0.1, days: float = 30.0) -> Column:
    """1 + boost * exp(-age / days); 1 without a time."""
    return F.when(ts.isNotNull(), 1 + boost * F.exp(-F.greatest(age_days(ts, now), F.lit(0.0)) / days)).otherwise(F.lit(1.0))


def decay(ts: Column, now: Column, alpha: float = 0.7, half_life: float = 14.0) -> Column:
    """alpha + (1 - alpha) * 0.5 ^ (age / half life); 1 without a time."""
    return F.when(ts.isNotNull(), alpha + (1 - alpha) * F.pow(F.lit(0.5), F.greatest(age_days(ts, now), F.lit(0.0)) / half_life)).otherwise(F.lit(1.0))


# Path words that say nothing, and stems that need their directory.
PATH_NOISE = ("src", "tests", "test", "app", "api", "v1", "fastapi_service", "nuxt_app", "infrastructure", "application", "domain", "shared", "entities", "features", "widgets", "pages", "__init__")
GENERIC_STEMS = ("models", "model", "service", "services", "handler", "handlers", "repository", "repositories", "endpoint", "endpoints", "route", "routes", "schema", "schemas", "utils", "helpers", "main", "index")


def derive_query(path: Column, most: int = 3) -> Column:
    """Lower-case words of a file's stem, after its directory's where the stem is generic; distinct, without noise, at most three."""
    parts = path_parts(F.lower(path))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    parent = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    full = F.when(stem.isin(*GENERIC_STEMS, *PATH_NOISE), F.concat_ws("/", parent, stem)).otherwise(stem)
    words_ = F.filter(F.split(full, r"[_\-/.]+"), lambda x: (x != "") & ~x.isin(*PATH_NOISE))
    return F.array_join(F.slice(F.array_distinct(words_), 1, most), " ")


def mentions(text: Column, base: Column) -> Column:
    """Whether a file name stands in a text between characters that cannot be part of one."""
    quoted = F.concat(F.lit(r"(?U)(?<![\w.-])\Q"), base, F.lit(r"\E(?![\w.-])"))
    return F.expr("true") & F.regexp_like(text, quoted)


def same_target(a: Column, b: Column) -> Column:
    """Two absolute paths are the same if equal; else one may be the other's end, at a slash."""
    both = a.startswith("/") & b.startswith("/")
    return F.when(both, a == b).otherwise((a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a)))


#: Suffixes of files that are not code.
NOT_CODE = (".md", ".json", ".yaml", ".yml", ".toml", ".env", ".cfg", ".ini", ".lock")


def is_code_target(path: Column, globs: Sequence[str] | None = None) -> Column:
    """A path under src/ or tests/ (or one of the globs) that has no suffix of text or settings."""
    text = path.rlike("(?<=[^/])(" + "|".join(re.escape(s) for s in NOT_CODE) + ")$")
    inside = excluded(path, globs) if globs else path.rlike("(^|/)(src|tests)/")
    return ~text & inside


#: Prompts that ask for a change.
EDIT_INTENT = (
    r"(?i)\b(fix|refactor|rename|implement|add|remove|delete|update|migrate)\b",
    r"(?i)\b(write|create|build|extract|introduce)\s+(a|the|new)?\b",
    r"(?i)\bchange\b",
)


def looks_edit_bound(prompt: Column) -> Column:
    return F.coalesce(prompt.rlike(EDIT_INTENT[0]) | prompt.rlike(EDIT_INTENT[1]) | prompt.rlike(EDIT_INTENT[2]), F.lit(False))


def in_project(source: Column, root: str) -> Column:
    """Relative sources belong; absolute ones under the root do; missing ones do not."""
    return F.coalesce(~source.startswith("/") | (source == root) | source.startswith(root.rstrip("/") + "/"), F.lit(False))


# Patterns of identifiers, of cited paths, and of the sections of a decision record.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_\.]+[A-Za-z0-9_]"
CITED_PATH = r"`([^`]+/[^`]+\.(?:py|ts|md))`"
PROBLEM_SECTION = r"(?ms)^##\s+(?:Problem|Why|Context)\s*\n+(.+?)(?:\n##|\z)"
DECISION_SECTION = r"(?ms)^##\s+Decision\s*\n+(.+?)(?:\n##|\z)"


def identifiers(text: Column, least: int = 4) -> Column:
    """Distinct identifier-like words of at least that many characters, in the order of their first place."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1)), lambda t: F.length(t) >= least))


def required_substrings(answer: Column, most: int = 5, least: int = 4) -> Column:
    """The first identifiers of an answer, at most five."""
    return F.slice(identifiers(answer, least), 1, most)


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def first_sentence(text: Column, most: int = 160) -> Column:
    """Up to the first ., ! or ? before white space, at most that many code points."""
    return F.trim(F.substring(F.regexp_extract(collapsed(text), r"^(.*?[.!?])(?:\s|$)|^(.*)$", 0), 1, most))


def session_name(session: Column) -> Column:
    """A session id as a file name: anything but letters, digits, _, . and - becomes _."""
    return F.regexp_replace(session, "[^A-Za-z0-9_.-]", "_")


def redacted(text: Column, secrets: Mapping[str, str]) -> Column:
    """Every secret value in a text as <NAME_REDACTED>; blank values are no secrets."""
    for name, value in secrets.items():
        if value.strip():
            text = F.replace(text, F.lit(value.strip()), F.lit(f"<{name}_REDACTED>"))
    return text


def settings_hash(value: object, digits: int | None = None) -> str:
    """SHA-256 of settings written as JSON in their own order, as the order of rooms and layers decides."""
    h = hashlib.sha256(json.dumps(value, default=str).encode()).hexdigest()
    return h if digits is None else h[:digits]


def append_distinct(a: Column, b: Column) -> Column:
    """a, then what b adds to it, each value once."""
    return F.array_distinct(F.concat(a, b))


#: Key of an overlay that replaces a value instead of merging into it.
REPLACE = "__replace__"


def deep_merge(base: dict, over: dict) -> dict:
    """base with over merged in: objects key by key, lists by appending what is new, all else replaced."""
    out = dict(base)
    for key, new in over.items():
        old = out.get(key)
        if isinstance(new, dict) and new.get(REPLACE) is True:
            out[key] = new.get("value")
        elif isinstance(old, dict) and isinstance(new, dict):
            out[key] = deep_merge(old, new)
        elif isinstance(old, list) and isinstance(new, list):
            out[key] = [*old, *(x for i, x in enumerate(new) if x not in old and x not in new[:i])]
        else:
            out[key] = new
    return out


def merge_json(base: Column, over: Column) -> Column:
    """deep_merge of two JSON texts, keys sorted; a null side is an empty object."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(deep_merge(json.loads(x or "{}"), json.loads(y or "{}")), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(base, over)
