"""The filter language: a mapping of keys to a value or a list of values."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that hold lists: equality means that the list contains the value.
LISTS = ("path_prefixes",)


def live(valid_to: Column, now: Column) -> Column:
    """Missing and null ends are live; so are ends to come."""
    return valid_to.isNull() | (valid_to > now)


def predicate(where: Mapping[str, str | list[str]] | None, df: DataFrame, *, temporal: bool = True, now: datetime | str | None = None) -> Column | None:
    """All keys must hold: a scalar is equality, a list is IN; None where nothing is asked.

    `valid_to` takes only "now", which the temporal condition already means. `path_prefix`
    is a whole-segment prefix of the path. Keys without a column are looked up in the map
    column `extra`. The mapping is not changed.
    """
    rest, parts = dict(where or {}), []
    if rest.pop("valid_to", "now") != "now":
        raise ValueError('valid_to takes only "now"')
    if temporal:
        parts.append(live(F.col("valid_to"), F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()))
    if (prefix := rest.pop("path_prefix", None)) is not None:
        rest = {"path_prefixes": prefix} | rest
    for key, value in rest.items():
        col = F.col(key) if key in df.columns else F.col("extra")[key]
        values = value if isinstance(value, list) else [value]
        if key in LISTS:
            parts.append(F.arrays_overlap(col, F.array(*(F.lit(v) for v in values))))
        else:
            parts.append(col.isin(*values) if isinstance(value, list) else col == value)
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out
