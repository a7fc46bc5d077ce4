"""Key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run the check now; raise ``ValueError`` on the first duplicate keys found."""
    bad = duplicate_keys(df, keys).take(5)
    if bad:
        raise ValueError(f"duplicate keys on {list(keys)}: {[r.asDict() for r in bad]}")
    return df


def unique_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, failing at run time if a key repeats.

    The check is one aggregation on the key, so a join on that key directly
    above reuses its partitioning and the check adds no shuffle of its own.
    """
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.first(F.col(f"`{c}`")).alias(c) for c in rest],
    )
    message = F.lit(f"duplicate key on {list(keys)}")
    return grouped.filter(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(message).cast("boolean"))).select(
        *[F.col(f"`{c}`") for c in df.columns]
    )


def require_date(df: DataFrame, name: str) -> None:
    """Series operators need a DATE order column.

    With one row per key and date, a series then holds at most one row per
    calendar day however many raw rows fed it, which bounds every window group.
    """
    if not isinstance(df.schema[name].dataType, T.DateType):
        raise TypeError(f"{name} must be DATE; aggregate to a date grain first")
