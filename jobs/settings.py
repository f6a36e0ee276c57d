"""Settings of a job from its JSON file."""

from __future__ import annotations

import json
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def read_settings(spark: SparkSession, path: str | None, kind: type[T]) -> T:
    """The settings in a file that Spark can read; without one the defaults. A key that is no setting raises ValueError."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := sorted(set(given) - {f.name for f in fields(kind)}):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return kind(**given)
