"""Plug-ins by kind and name: backends, chunkers, embedders, rerankers, suites."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Callable, Sequence
from typing import Any

#: Kinds of plug-ins.
KINDS = ("retrieval", "chunker", "embedder", "reranker", "suite")
_found: dict[str, dict[str, Any]] = {k: {} for k in KINDS}


class UnknownPluginError(LookupError):
    """No plug-in of that kind and name."""


def register(kind: str, name: str) -> Callable[[Any], Any]:
    """As a decorator: make a plug-in known. A later one of the same name takes its place."""

    def add(plugin: Any) -> Any:
        if kind not in _found:
            raise UnknownPluginError(f"no such kind: {kind}")
        _found[kind][name] = plugin
        return plugin

    return add


def lookup(kind: str, name: str) -> Any:
    _defaults()
    if name not in _found.get(kind, {}):
        raise UnknownPluginError(f"{kind} {name}: not one of {', '.join(names(kind))}")
    return _found[kind][name]


def names(kind: str) -> list[str]:
    _defaults()
    return sorted(_found.get(kind, {}))


def _defaults() -> None:
    """The plug-ins that come with the engine; they are imported on first use, as they import this module."""
    from memlake.operators import chunkers, evaluation, retrieval  # noqa: F401


class RerankError(RuntimeError):
    """A reranker's reply cannot be used."""


def checked_scorer(post: Callable[[str, list[str]], Sequence[dict]], *, retry_on: tuple[type[Exception], ...] = (OSError, TimeoutError), wait: float = 0.5) -> Callable[[str, list[str]], list[float]]:
    """A scorer from a remote reranker: post(query, texts) replies with rows of index and relevance_score.

    One retry after a retryable error. A reply without rows, with an index out of range or
    given twice, or without a finite score raises; texts that the reply leaves out come last.
    """

    def score(query: str, texts: list[str]) -> list[float]:
        try:
            reply = post(query, texts)
        except retry_on:
            time.sleep(wait)
            try:
                reply = post(query, texts)
            except retry_on as e:
                raise RerankError(f"failed after a retry: {type(e).__name__}") from e
        if not reply:
            raise RerankError("no results")
        got: dict[int, float] = {}
        for row in reply:
            at, value = row.get("index"), row.get("relevance_score")
            if not isinstance(at, int) or isinstance(at, bool) or not 0 <= at < len(texts) or at in got or value is None or not math.isfinite(float(value)):
                raise RerankError(f"index {at!r} or its score is not usable")
            got[at] = float(value)
        least = min(got.values())
        return [got.get(i, least - 1.0) for i in range(len(texts))]

    return score


def batched_scorer(pairs: Callable[[list[tuple[str, str]]], Sequence[float]], batch: int = 16) -> Callable[[str, list[str]], list[float]]:
    """A scorer from a local cross-encoder that scores (query, text) pairs, some at a time."""

    def score(query: str, texts: list[str]) -> list[float]:
        out: list[float] = []
        for i in range(0, len(texts), batch):
            out += [float(x) for x in pairs([(query, t) for t in texts[i : i + batch]])]
        return out

    return score


def floor_is_reachable(floor: float, scale_max: float | None) -> bool:
    """False, with a warning, where a score floor is so high that a reranker's scores can never reach it."""
    if scale_max is not None and floor > 0 and floor >= scale_max:
        warnings.warn(f"score floor {floor} is not under the reranker's greatest score {scale_max}: every reranked hit goes", stacklevel=2)
        return False
    return True
