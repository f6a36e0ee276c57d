"""Settings of ingestion and search, checked when they are made."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Config:
    """Every default is a parameter of the builders; a bad value raises ValueError."""

    arm_n: int = 20
    rerank_n: int = 50
    rrf_k: int = 60
    k: int = 5
    k_max: int = 20
    adaptive_delta: float = 0.5
    dedup_cosine: float = 0.97
    token_budget: int = 1500
    decay_enabled: bool = False
    decay_alpha: float = 0.7
    decay_half_life_days: float = 14.0
    boost: float = 0.1
    boost_days: float = 30.0
    content_dedup: bool = False
    retention_days: float = 0.0
    preview_chars: int = 0
    fetch_k: int = 30
    inject_k: int = 5
    min_score: float = 0.0
    remote_timeout: float = 5.0
    response_format: str = "concise"
    rooms: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        checks = {
            "k_max": 1 <= self.k_max <= 50,
            "adaptive_delta": self.adaptive_delta >= 0,
            "dedup_cosine": 0 < self.dedup_cosine <= 1,
            "decay_alpha": 0 <= self.decay_alpha <= 1,
            "decay_half_life_days": self.decay_half_life_days > 0,
            "retention_days": self.retention_days >= 0,
            "preview_chars": self.preview_chars >= 0,
            "fetch_k": 1 <= self.fetch_k <= 500,
            "inject_k": 1 <= self.inject_k <= self.fetch_k,
            "remote_timeout": self.remote_timeout > 0,
            "min_score": math.isfinite(self.min_score) and self.min_score >= 0,
            "response_format": self.response_format in ("concise", "detailed"),
        }
        kinds = {"int": int, "float": (int, float), "bool": bool, "str": str}
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type in kinds and (not isinstance(value, kinds[f.type]) or isinstance(value, bool) != (f.type == "bool")):
                raise ValueError(f"bad type: {f.name}")
        bad = [k for k, ok in checks.items() if not ok]
        if bad:
            raise ValueError(f"bad value: {', '.join(bad)}")

    @classmethod
    def read(cls, settings: Mapping[str, object]) -> Config:
        """From a mapping; keys that are no settings are left out with a warning."""
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(settings) - known):
            warnings.warn(f"unknown settings: {', '.join(unknown)}", stacklevel=2)
        return cls(**{k: v for k, v in settings.items() if k in known})
