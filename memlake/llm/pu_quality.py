"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut, seeded_share

_PUNCT = [ord(c) for c in ".,;:!?#$%&*|-'\"()@/\\=_<>{}[]+~^`"]
_STOP = (".", "!", "?", ",", ";", ":")
#: Number of features of a text.
WIDTH = len(_PUNCT) + 18


def features(text: str | None) -> np.ndarray:
    """What the classifier sees of a whole text: shares of characters, words, repeats and lines."""
    t = text or ""
    out = np.zeros(WIDTH, np.float32)
    raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    c = np.bincount(raw, minlength=256)
    words = t.split()
    w = max(1, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    lines = [x for x in t.split("\n") if x]
    k = max(1, len(lines))
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[: len(_PUNCT)] = c[_PUNCT] / n
    out[len(_PUNCT) :] = [
        np.log1p(len(raw)), np.log1p(len(words)), c[65:91].sum() / n, c[97:123].sum() / n, c[48:58].sum() / n, c[32] / n, c[10] / n, c[128:].sum() / n,
        lens.mean(), lens.std(), np.log1p(lens.max()), len(seen) / w, (max(seen.values()) if seen else 0) / w,
        sum(map(str.__eq__, words, words[1:])) / w, pairs / w, len(set(lines)) / k, np.log1p(len(raw) / k), sum(x.endswith(_STOP) for x in words) / w,
    ]
    return out


@dataclass
class Model:
    """A network with one hidden layer over standardised features, and the class prior it was trained with."""

    mean: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(np.float64), -30, 30)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def risk_step(g: np.ndarray, n: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk of logits (n positives, then unlabelled), and the direction that a step goes against.

    The risk is that of positives as positives, and that of unlabelled as negatives less
    the positives' share in it. Where the second part is below zero it counts as zero, and
    the step raises it.
    """
    s, m = 1 / (1 + np.exp(-g)), len(g) - n
    rest = _softplus(g[n:]).mean() - prior * _softplus(g[:n]).mean()
    risk = prior * _softplus(-g[:n]).mean() + max(0.0, float(rest))
    if rest >= 0:
        return risk, np.concatenate([prior * ((s[:n] - 1) - s[:n]) / n, s[n:] / m])
    return risk, np.concatenate([prior * s[:n] / n, -s[n:] / m])


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int, seed: int, hidden: int = 24, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam. With a prior: the non-negative unbiased risk. Without: positives against unlabelled, for the prior's estimate."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([p, u])
    m = Model(both.mean(0), both.std(0) + 1e-3, [rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)], prior or 0.0)
    p, u = (np.clip((x - m.mean) / m.scale, -8, 8).astype(np.float32) for x in (p, u))
    first, second = ([np.zeros_like(a) for a in m.w] for _ in "ab")
    for step in range(1, rounds + 1):
        x = np.concatenate([p[rng.integers(0, len(p), 512)], u[rng.integers(0, len(u), 512)]])
        hid = np.tanh(x @ m.w[0] + m.w[1])
        g = (hid @ m.w[2] + m.w[3])[:, 0]
        s = 1 / (1 + np.exp(-g))
        if prior is None:
            d = np.concatenate([(s[:512] - 1) / 512, s[512:] / 512])
        else:
            d = risk_step(g, 512, prior)[1]
        d_hid = d[:, None] @ m.w[2].T * (1 - hid * hid)
        grads = [x.T @ d_hid, d_hid.sum(0), hid.T @ d[:, None], d.sum()[None]]
        lr = rate * min(1.0, 3 * (1 - step / (rounds + 1)))
        for a, g_, f, v in zip(m.w, grads, first, second, strict=True):
            g_ = g_ + decay * a
            f += 0.1 * (g_ - f)
            v += 0.001 * (g_ * g_ - v)
            a -= lr * (f / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return m


def estimate_prior(p: np.ndarray, u: np.ndarray, rounds: int, seed: int) -> float:
    """The share of positives among unlabelled texts.

    Unlabelled text is a mixture of positives and others, so for every score threshold its
    mass above is at least the prior times the positives' mass above: the smallest ratio
    estimates the prior. The scores come from a network that tells positives from unlabelled texts, fitted on one half and read on the other.
    """
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    i, j = len(p) // 2, len(u) // 2
    m = _fit(p[:i] if i else p, u[:j] if j else u, None, rounds, seed)
    sp, su = np.sort(m.logit(p[i:])), np.sort(m.logit(u[j:]))
    at = np.quantile(sp, np.linspace(0, 0.5, 101))
    above_p, above_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    ratio = above_u / np.maximum(above_p, 1e-3)
    return float(np.clip(ratio.min(), 0.01, 0.99))


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): features of every whole text."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([features(t) for t in b.column("text").to_pylist()]) if b.num_rows else np.zeros((0, WIDTH), np.float32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), pa.array(x.ravel(), pa.float32()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def _sample(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    near = rows.where(seeded_share(F.col("doc_id"), n, rows.count(), seed))
    got = near.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n).select("x").collect()
    return np.array([r["x"] for r in got], np.float32).reshape(-1, WIDTH)


def fit_quality(x: DataFrame, positives: DataFrame, learn: str | None = None, max_positives: int = 4_000, max_unlabelled: int = 8_000, rounds: int = 3_000, seed: int = 11) -> Model | None:
    """Train on trusted positives (doc_id) and unlabelled rows of x; None if either is missing.

    Both samples are bounded, by the parameters, and are the first rows by a seeded hash.
    """
    rows = x.where("doc_id is not null")
    rows = rows if learn is None else rows.where(learn)
    p = _sample(rows.join(positives.select("doc_id").distinct(), "doc_id", "left_semi"), max_positives, seed)
    u = _sample(rows, max_unlabelled, seed + 1)
    if len(p) < 2 or len(u) < 2:
        return None
    return _fit(p, u, estimate_prior(p, u, rounds // 2, seed), rounds, seed)


def score_quality(x: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score): the probability of being positive; 0.5 for all where nothing could be learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("x").values.to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            s = model.score(v) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return x.mapInArrow(run, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, learn: str | None = None, threshold: float = 0.3, **fit) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; labels has (doc_id, quality), 1 the trusted positives.

    Null text counts as empty, and empty texts are scored too. Null ids are scored but
    never learned from; repeated ids are kept, a row each. Labels that are null or 0 are
    not used: the rest of the text is unlabelled. An empty table gives no rows. Only the
    text is an input of a score.
    """
    x = cut(text_features(docs))
    model = fit_quality(x, labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")), learn, **fit)
    return score_quality(x, model).select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


