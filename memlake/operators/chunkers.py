"""Chunkers: one document to many chunks. Headers and paths split in the JVM; lengths and code in Python UDTFs."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.registry import lookup, register

# Limits in tokens and code points.
SOFT_MAX, SIZE, OVERLAP, MIN_TOKENS = 250, 800, 80, 20
DRAWER_MAX, DRAWER_SIZE, DRAWER_OVERLAP, TOOL_MAX = 600, 2000, 160, 2000
CODE_MAX, CODE_MERGE = 512, 8
_HEADER = re.compile(r"^#{1,3}\s+\S")
_FENCE = re.compile(r"^(`{3,}|~{3,})(.*)$")


def tokens(text: str) -> int:
    return max(1, len(text) // 4)


def split_length(text: str, size: int, overlap: int, seps: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most size code points, cut at the coarsest separator that works, with overlap carried over."""
    sep = next((s for s in seps if s in text), "")
    parts = text.split(sep) if sep else list(text)
    finer = seps[seps.index(sep) + 1 :] if sep in seps and sep else ()
    out: list[str] = []
    held: list[str] = []
    length = 0
    for p in parts:
        if len(p) > size and finer:
            if held:
                out.append(sep.join(held))
                held, length = [], 0
            out += split_length(p, size, overlap, finer)
            continue
        if held and length + len(sep) + len(p) > size:
            out.append(sep.join(held))
            while held and (length > overlap or length + len(sep) + len(p) > size):
                length -= len(held.pop(0)) + (len(sep) if held else 0)
        length += len(p) + (len(sep) if held else 0)
        held.append(p)
    if held:
        out.append(sep.join(held))
    return [x.strip() for x in out if x.strip()]


def chunk_markdown(text: str | None, soft_max: int = SOFT_MAX, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Sections between headers of levels 1 to 3, headers left out; long ones split by length. Fenced lines are no headers."""
    body = (text or "").strip()
    if not body:
        return []
    sections: list[list[str]] = [[]]
    fence = ""
    for line in body.split("\n"):
        mark = _FENCE.match(line.strip())
        if mark and (not fence or line.strip().startswith(fence)):
            fence = "" if fence else mark[1][:3]
        if not fence and not mark and _HEADER.match(line):
            sections.append([])
        else:
            sections[-1].append(line)
    found = [s for s in ("\n".join(x).strip() for x in sections) if s] or [body]
    out: list[str] = []
    for s in found:
        out += split_length(s, size, overlap) if tokens(s) > soft_max else [s]
    return out


def protect_fences(text: str) -> tuple[str, list[str]]:
    """The text with each fenced block replaced by a placeholder, and the blocks.

    A fence that opens again inside itself, or never closes, raises ValueError.
    """
    out, blocks, held, mark = [], [], [], ""
    for line in text.split("\n"):
        m = _FENCE.match(line.strip())
        if not mark and m:
            mark, held = m[1], [line]
        elif mark:
            held.append(line)
            if m and m[1][0] == mark[0] and len(m[1]) >= len(mark):
                if m[2].strip():
                    raise ValueError("a fence opens inside a fence")
                out.append(f"\x00{len(blocks)}\x00")
                blocks.append("\n".join(held))
                mark = ""
        else:
            out.append(line)
    if mark:
        raise ValueError("a fence is not closed")
    return "\n".join(out), blocks


def restore_fences(text: str, blocks: list[str]) -> str:
    return re.sub("\x00(\\d+)\x00", lambda m: blocks[int(m[1])], text)


def _written(value: object, *, plain: bool = False) -> str:
    return value if isinstance(value, str) and plain else json.dumps(value, ensure_ascii=plain)


def render_blocks(content: object, tool_max: int = TOOL_MAX) -> str:
    """Message content, a string or a list of blocks, as text; tool inputs over tool_max code points are elided."""
    if isinstance(content, str):
        return content
    out = []
    for b in content if isinstance(content, list) else []:
        kind = b.get("type") if isinstance(b, dict) else None
        if kind == "text":
            out.append(b.get("text", ""))
        elif kind == "thinking":
            out.append(f"[thinking]\n{b.get('text', b.get('thinking', ''))}\n[/thinking]")
        elif kind == "image":
            out.append("[image]")
        elif kind == "tool_use":
            given = _written(b.get("input", {}))
            given = given if len(given) <= tool_max else f"…({max(1, len(given) // 1024)}kB elided)"
            out.append(f"[tool_use:{b.get('name', '')} id={b.get('id', '')} input={given}]")
        elif kind == "tool_result":
            out.append(f"[tool_result id={b.get('tool_use_id', '')}{' is_error=true' if b.get('is_error') else ''}]\n{_written(b.get('content', ''), plain=True)}")
    return "\n".join(out)


def chunk_drawer(user: object, assistants: list[object], soft_max: int = DRAWER_MAX, tool_max: int = TOOL_MAX) -> list[str]:
    """A turn as one chunk, or split by length outside its fenced blocks."""
    text = "\n\n".join([f"### User\n{render_blocks(user, tool_max)}", *(f"### Assistant\n{render_blocks(a, tool_max)}" for a in assistants)])
    if tokens(text) <= soft_max:
        return [text]
    plain, blocks = protect_fences(text)
    return [restore_fences(x, blocks) for x in split_length(plain, DRAWER_SIZE, DRAWER_OVERLAP)]


def chunk_python(source: str | None, most: int = CODE_MAX) -> list[str]:
    """Definitions as chunks: a class is its header and its methods, functions fall into paragraphs.

    Every other statement, and every line of comment between them, is a chunk of its own;
    neighbours are joined by a blank line while both sides are tiny. A source that does not
    parse is chunked as markdown.
    """
    text = source or ""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return chunk_markdown(text)
    lines = text.split("\n")

    def cut(a: int, b: int) -> str:
        return "\n".join(lines[a - 1 : b]).strip("\n")

    def first(node: ast.AST) -> int:
        return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])

    def paragraphs(body: str) -> list[str]:
        return [p.strip("\n") for p in re.split(r"\n[ \t]*\n", body) if p.strip()]

    def loose(nodes: list[ast.stmt], at: int, end: int) -> list[tuple[str, bool]]:
        ends: dict[int, int] = {}
        for n in nodes:  # of statements that share a line the last one's end counts
            ends[first(n)] = max(n.end_lineno, ends.get(first(n), 0))
        out = []
        while at <= end:
            last = ends.get(at, at)
            if at in ends or lines[at - 1].lstrip().startswith("#"):
                out.append((cut(at, last), False))
            at = last + 1
        return out

    def walk(nodes: list[ast.stmt], start: int, end: int) -> list[tuple[str, bool]]:
        out: list[tuple[str, bool]] = []
        at = start
        for node in nodes:
            if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            out += loose(nodes, at, first(node) - 1)
            if isinstance(node, ast.ClassDef):
                inner = [n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
                head = first(inner[0]) - 1 if inner else node.end_lineno
                out.append((cut(first(node), head), True))
                out += walk(node.body, head + 1, node.end_lineno)
            else:
                out += [(p, True) for p in paragraphs(cut(first(node), node.end_lineno))]
            at = node.end_lineno + 1
        return [x for x in out + loose(nodes, at, end) if x[0].strip()]

    merged: list[tuple[str, bool]] = []
    for body, definition in walk(tree.body, 1, len(lines)):
        if merged and not definition and not merged[-1][1] and tokens(body) <= CODE_MERGE and tokens(merged[-1][0]) <= CODE_MERGE:
            merged[-1] = (merged[-1][0] + "\n\n" + body, False)
        else:
            merged.append((body, definition))
    out: list[str] = []
    for body, _ in merged:
        out += [body] if tokens(body) <= most else split_length(body, most * 4, 0)
    return out


def chunk_documents(docs: DataFrame, kind: str = "markdown", min_tokens: int = MIN_TOKENS, id_col: str = "path", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(path, chunk_idx, document) of every document, and its columns keep; indices count chunks before small ones are dropped."""
    split = lookup("chunker", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [split(t) for t in b.column("text").to_pylist()]
            of = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            made = {n: b.column(n).take(of) for n in b.schema.names if n != "text"}
            made["chunk_idx"] = pa.array([i for f in found for i in range(len(f))], pa.int32())
            made["document"] = pa.array([c for f in found for c in f], pa.string())
            yield pa.RecordBatch.from_pydict(made)

    src = docs.select(F.col(id_col).alias("path"), *keep, F.col(text_col).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text")
    out = src.mapInArrow(run, f"{kept}, chunk_idx int, document string")
    return out.where(F.greatest(F.lit(1), F.floor(F.length("document") / 4)) >= min_tokens)


def window_chunks(docs: DataFrame, size: int = 128, overlap: int = 16, text_col: str = "text") -> DataFrame:
    """docs with (chunk_idx, document) for its text: windows of at most `size` words, each sharing `overlap` with the one before.

    Words are runs without white space, joined again by one space. A text without words
    (null, empty) has no row. Expressions only, so a text of any length stays in the JVM.
    """
    if not 0 <= overlap < size:
        raise ValueError("windows must be longer than what they share")
    step = size - overlap
    words = F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    # slices of one array a text: it is made once, before the rows of its windows
    listed = docs.withColumn("words_", words).where(F.size("words_") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words_") - overlap, F.lit(1)) - 1, F.lit(step))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("words_", i + 1, F.lit(size)), " "))
    return listed.select(*docs.columns, F.posexplode(windows).alias("chunk_idx", "document"))


def chunk_transcripts(pairs: DataFrame) -> DataFrame:
    """(piece, document) of pairs (user_json, assistant_json array, ...), with every other column of the pair on each piece; tool payloads elided."""
    rest = [f for f in pairs.schema if f.name not in ("user_json", "assistant_json")]
    names = [f.name for f in rest]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[(i, c) for i, c in enumerate(chunk_drawer(json.loads(u), [json.loads(x) for x in a]))] for u, a in zip(b["user_json"], b["assistant_json"], strict=True)]
            out = b[names].loc[b.index.repeat([len(f) for f in found])].reset_index(drop=True)
            flat = [x for f in found for x in f]
            out["piece"], out["document"] = [x[0] for x in flat], [x[1] for x in flat]
            yield out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "piece int", "document string"])
    return pairs.select(*names, "user_json", "assistant_json").mapInPandas(run, schema)


def chunk_by_suffix(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Transcript files by turns, all others as markdown: (path, chunk_idx, document)."""
    text = chunk_documents(files.where(~F.col("path").endswith(".jsonl")))
    turns = chunk_transcripts(pairs.select("session", "turn_index", "user_json", "assistant_json")).select(F.concat_ws("#", "session", "turn_index").alias("path"), F.col("piece").alias("chunk_idx"), "document")
    return text.unionByName(turns)


register("chunker", "markdown")(chunk_markdown)
register("chunker", "python")(chunk_python)
