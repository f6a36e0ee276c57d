"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut, seeded_share

#: Bytes of a window (each is read in both directions), windows of a batch, hidden units each way.
STEPS, BLOCK, HIDDEN = 64, 2048, 8
#: Texts that are learned from, over all languages: with many of them each gives fewer, but none is left out.
TEXTS = 150_000
#: Byte 0 fills up the last window of a text and is never scored.
PAD = 0
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Weights. Input and recurrent weights hold the gates one below the other: update, reset, candidate."""

    langs: list[str]
    table: list[np.ndarray]  # per direction (3H, 256): a byte's share of the gates, biases included
    inner: list[np.ndarray]  # per direction (3H, H)
    out: np.ndarray  # (L, 2H)
    bias: np.ndarray  # (L, 1)

    def arrays(self) -> list[np.ndarray]:
        return [*self.table, *self.inner, self.out, self.bias]


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    return Model(langs, [draw(3 * hidden, 256, scale=0.3) for _ in "ab"], [draw(3 * hidden, hidden, scale=hidden**-0.5) for _ in "ab"], draw(len(langs), 2 * hidden, scale=0.3), np.zeros((len(langs), 1), np.float32))


def _direction(table: np.ndarray, inner: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, H, B) of one direction over bytes x (T, B)."""
    h3, hid = table.shape[0], inner.shape[1]
    steps, b = x.shape
    half = np.ones((h3, 1), np.float32)
    half[: 2 * hid] = 0.5  # sigmoid(v) = (1 + tanh(v / 2)) / 2
    table, inner = np.ascontiguousarray(table * half), np.ascontiguousarray(inner * half)
    out = np.empty((steps, hid, b), np.float32)
    h, g, rec = np.zeros((hid, b), np.float32), np.empty((h3, b), np.float32), np.empty((h3, b), np.float32)
    for t in range(steps):
        np.take(table, x[t], axis=1, out=g, mode="clip")
        np.matmul(inner, h, out=rec)
        gates = g[: 2 * hid]
        gates += rec[: 2 * hid]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:hid], gates[hid:]
        n = g[2 * hid :]
        n += r * rec[2 * hid :]
        np.tanh(n, out=n)
        new = out[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        if keep is not None:
            keep.append((h, z.copy(), r.copy(), n.copy(), rec[2 * hid :].copy()))
        h = new
    return out


def positions(m: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities (T, L, B): a label for every position of the windows x (T, B)."""
    both = np.concatenate([_direction(m.table[0], m.inner[0], x), _direction(m.table[1], m.inner[1], x[::-1])[::-1]], axis=1)
    logit = np.matmul(m.out, both)
    logit += m.bias
    logit -= logit.max(axis=1, keepdims=True)
    np.exp(logit, out=logit)
    logit /= logit.sum(axis=1, keepdims=True)
    return logit


def _backward(table: np.ndarray, inner: np.ndarray, x: np.ndarray, kept: list, dh_all: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of one direction by backpropagation through time."""
    hid = inner.shape[1]
    d_inner, d_table = np.zeros_like(inner), np.zeros_like(table)
    dh = np.zeros_like(dh_all[0])
    for t in reversed(range(len(x))):
        h, z, r, n, rn = kept[t]
        dh = dh + dh_all[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * rn * r * (1 - r)
        d_rec = np.concatenate([dz, dr, dn * r])
        d_in = np.concatenate([dz, dr, dn])
        d_inner += d_rec @ h.T
        one_hot = np.zeros((256, x.shape[1]), np.float32)
        one_hot[x[t], np.arange(x.shape[1])] = 1
        d_table += d_in @ one_hot.T
        dh = dh * z + inner.T @ d_rec
    return d_table, d_inner


def loss_and_gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions that hold text, and its gradients in the order of arrays()."""
    hid = m.inner[0].shape[1]
    kept: list[list] = [[], []]
    fwd = _direction(m.table[0], m.inner[0], x, kept[0])
    bwd = _direction(m.table[1], m.inner[1], x[::-1], kept[1])[::-1]
    both = np.concatenate([fwd, bwd], axis=1)
    logit = np.matmul(m.out, both) + m.bias
    logit -= logit.max(axis=1, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(axis=1, keepdims=True)
    mask = (x != PAD).astype(np.float32)
    total = max(1.0, float(mask.sum()))
    at = np.arange(x.shape[1])
    loss = float(-(np.log(p[:, y, at] + 1e-9) * mask).sum() / total)
    d = p
    d[:, y, at] -= 1
    d *= mask[:, None, :] / total
    d_out = np.einsum("tlb,thb->lh", d, both, optimize=True)
    d_both = np.matmul(m.out.T, d)
    tf, uf = _backward(m.table[0], m.inner[0], x, kept[0], d_both[:, :hid])
    tb, ub = _backward(m.table[1], m.inner[1], x[::-1], kept[1], d_both[::-1, hid:])
    return loss, [tf, tb, uf, ub, d_out.astype(np.float32), d.sum(axis=(0, 2))[:, None].astype(np.float32)]


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], rounds: int = 400, batch: int = 192, rate: float = 0.02, seed: int = 7) -> Model:
    """Adam over class-balanced batches of windows (N, STEPS)."""
    rng = np.random.default_rng(seed)
    m = new_model(langs, seed=seed)
    by = [np.flatnonzero(labels == i) for i in range(len(langs))]
    first = [np.zeros_like(a) for a in m.arrays()]
    second = [np.zeros_like(a) for a in m.arrays()]
    for step in range(1, rounds + 1):
        y = rng.integers(0, len(langs), batch)
        x = np.ascontiguousarray(windows[[by[i][rng.integers(len(by[i]))] for i in y]].T)
        _, grads = loss_and_gradients(m, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1.0, 4 * (1 - step / (rounds + 1)))
        for a, g, u, v in zip(m.arrays(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            a -= lr * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return m


def cut_windows(text: bytes) -> np.ndarray:
    """The whole text as windows (n, STEPS), the last one filled up with PAD."""
    n = -(-len(text) // STEPS)
    out = np.full(n * STEPS, PAD, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, STEPS)


def predict(m: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, probability) of whole texts: every position is labelled, then a text's positions are averaged."""
    raw = [t.encode("utf-8", "replace") if t and _LETTER.search(t) else b"" for t in texts]
    counts = np.array([-(-len(r) // STEPS) for r in raw])
    wins = np.concatenate([cut_windows(r) for r in raw]) if counts.sum() else np.zeros((0, STEPS), np.uint8)
    sums = np.zeros((len(m.langs), len(wins)))
    for i in range(0, len(wins), BLOCK):
        x = np.ascontiguousarray(wins[i : i + BLOCK].T)
        p = positions(m, x)
        sums[:, i : i + BLOCK] = np.einsum("tlb,tb->lb", p, (x != PAD).astype(np.float32), optimize=True)
    owner = np.repeat(np.arange(len(raw)), counts)
    pooled = np.stack([np.bincount(owner, weights=s, minlength=len(raw)).astype(float) for s in sums], axis=1)
    pooled /= np.maximum(1e-9, pooled.sum(axis=1, keepdims=True))
    best = pooled.argmax(axis=1)
    return [(m.langs[j], float(min(1.0, p[j]))) if r else ("und", 0.0) for r, j, p in zip(raw, best, pooled, strict=True)]


def training_windows(labelled: DataFrame, per_lang: int, per_text: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """At most per_text windows of at most per_lang texts a language (fewer where all languages together would exceed TEXTS); the texts are the first by a seeded hash."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, wins = [], []
            for lang, text, k in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), b.column("k").to_pylist(), strict=True):
                w = cut_windows(text.encode("utf-8", "replace"))
                for i in np.random.default_rng(k & 0x7FFFFFFF).permutation(len(w))[:per_text]:
                    langs.append(lang)
                    wins.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(wins, pa.binary())], ["lang", "win"])

    order = Window.partitionBy("lang").orderBy("k", "doc_id")
    counts = cut(labelled.groupBy("lang").agg(F.count("*").alias("total")))
    n = counts.count()
    if n > TEXTS:
        raise ValueError(f"{n} languages, but at most {TEXTS} texts to learn them from")
    per_lang = max(1, min(per_lang, TEXTS // max(1, n)))
    near = labelled.join(F.broadcast(counts), "lang").where(seeded_share(F.col("doc_id"), per_lang, F.col("total"), seed))
    best = near.withColumn("k", F.xxhash64(F.lit(seed), "doc_id")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_lang)
    found = best.select("lang", "text", "k").mapInArrow(pick, "lang string, win binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["win"])))
    langs = sorted({r["lang"] for r in found})
    at = {x: i for i, x in enumerate(langs)}
    wins = np.frombuffer(b"".join(bytes(r["win"]) for r in found), np.uint8).reshape(len(found), STEPS)
    return wins, np.array([at[r["lang"]] for r in found], int), langs


def fit_language(docs: DataFrame, learn: str | None = None, per_lang: int = 600, per_text: int = 8, rounds: int = 400, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on the rows whose text and language are not null; None if there are none.

    Every language is learned. The sample is bounded: per_lang * per_text windows a
    language, TEXTS * per_text in all; more languages than TEXTS raise an error. learn is a SQL
    condition on doc_id that rows must meet.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and text <> '' and lang is not null and doc_id is not null")
    wins, labels, langs = training_windows(rows if learn is None else rows.where(learn), per_lang, per_text, seed)
    return train(wins, labels, langs, rounds=rounds, seed=seed) if len(wins) else None


def score_language(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every whole text.

    `und` with score 0 where the text is null or has no letter, and for every text when
    nothing could be learned. Null and repeated ids are kept, a row each; an empty table
    gives no rows; other columns are never read.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            got = predict(model, texts) if model else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def keep_recognised(docs: DataFrame, model: Model | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a letter and a language of at least that probability."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            got = predict(model, texts) if model else [("und", 0.0)] * len(texts)
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
