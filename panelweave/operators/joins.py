"""Checked joins and lookups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators.checks import require_date, unique_by
from panelweave.session import materialize


def join_checked(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str | None = "m:1"
) -> DataFrame:
    """USING join whose ``1:1`` / ``m:1`` promise is enforced while it runs.

    No broadcast hint is given: file statistics and adaptive execution pick the
    strategy from real sizes, and split skewed partitions when they shuffle.
    """
    if validate not in (None, "1:1", "m:1"):
        raise ValueError(f"unknown validate mode: {validate}")
    if validate == "1:1":
        left = unique_by(left, on)
    if validate in ("1:1", "m:1"):
        right = unique_by(right, on)
    return left.join(right, list(on), how)


def full_join_all(tables: Sequence[DataFrame], on: Sequence[str], validate: str | None = "1:1") -> DataFrame:
    """Full outer join of several tables with unique keys."""
    return reduce(lambda a, b: join_checked(a, b, on, "full", validate), tables)


def date_dimension(df: DataFrame, date: str) -> DataFrame:
    """One row per date, enforced, hinted for broadcast.

    A century of days is 36,525 rows, the whole DATE range 3.7 million, so two
    or three numbers per day stay far below a broadcast's limits.
    """
    require_date(df, date)
    return F.broadcast(unique_by(df, [date]))


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a derived lookup table whose size is not known beforehand.

    The lookup is stored first (runs a job), so the planner sees its true size:
    below the broadcast threshold the big side is not shuffled at all and a key
    with a third of all rows stays where it is; above it the join shuffles and
    adaptive execution splits the hot partition.
    """
    return big.join(materialize(small, "lookup"), list(on), how)


def attach_monthly(base: DataFrame, tables: Iterable[DataFrame], date: str = "date") -> DataFrame:
    """Left join side tables to a panel or wide table by date; a date that a side repeats fails the job."""
    return reduce(lambda df, side: df.join(date_dimension(side, date), date, "left"), tables, base)


def compare_sources(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, names: tuple[str, str]) -> DataFrame:
    """Full outer comparison of one value in two sources."""
    left, right = (f"{value}_{n}" for n in names)
    both = a.select(*on, F.col(value).alias(left)).join(b.select(*on, F.col(value).alias(right)), list(on), "full")
    x, y = F.coalesce(F.col(left), F.lit(0.0)), F.coalesce(F.col(right), F.lit(0.0))
    diff = y - x
    return both.select(
        *on,
        x.alias(left),
        y.alias(right),
        F.col(left).isNotNull().alias(f"has_{names[0]}_data"),
        F.col(right).isNotNull().alias(f"has_{names[1]}_data"),
        diff.alias("difference"),
        F.abs(diff).alias("abs_difference"),
        (diff / (F.abs(y) + F.lit(1e-10)) * 100).alias("pct_difference"),
    )


def lookup_rate(df: DataFrame, rates: DataFrame, date: str, rate: str, replace: Column | None = None) -> DataFrame:
    """Take a rate from a date-keyed table; keep a usable own value where ``replace`` allows it."""
    looked = rates.select(F.col(date), F.col(rate).alias("_looked"))
    out = df.join(date_dimension(looked, date), date, "left")
    own = F.col("_looked") if replace is None else F.coalesce(replace, F.col("_looked"))
    return out.withColumn(rate, own).drop("_looked")


def on_date_spine(tables: Sequence[DataFrame], series: DataFrame, date: str) -> DataFrame:
    """Reindex ``series`` onto the union of the dates of ``tables``."""
    spine = reduce(lambda a, b: a.unionByName(b), [t.select(date) for t in tables]).distinct()
    return spine.join(series, date, "left")
