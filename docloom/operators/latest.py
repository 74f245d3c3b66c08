"""Last writer wins: the newest version of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, that with the greatest ``order``; nulls are least.

    An aggregation, not a window: versions of a key are combined before the shuffle, so a key that
    is written very often is no hot task.
    """
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*key).agg(newest).select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def drop_deleted(df: DataFrame, op: str = "op", deleted: str = "delete") -> DataFrame:
    return df.where(F.col(op) != deleted)
