"""One entry point for operators that look at neighbouring rows of a dated series.

A series needs a DATE and one row per date; both are enforced here, the second while the job runs, on the
window that the operator uses anyway. With keys, a series is one window group, at most one row per day. Without
keys, rows get their place from counts per year and are cut into blocks of places, each with copies of the rows
just outside it, so that shifts need no task that holds the whole series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelweave.operators.checks import require_date

#: Rows of a block of a series without keys.
BLOCK_ROWS = 4096
PLACE, SIZE, BLOCK, HOME = "_place", "_size", "_block", "_home"


@dataclass(frozen=True)
class Series:
    """Rows with ``_place`` (from 1) and ``_size``; ``window`` reaches as far as was asked for."""

    rows: DataFrame
    window: WindowSpec
    blocked: bool

    def own(self, df: DataFrame) -> DataFrame:
        """``df``, a selection of the rows, without the copies and the helper columns."""
        own = df.filter(F.col(HOME)) if self.blocked else df
        return own.drop(PLACE, SIZE, BLOCK, HOME)


def _once(at: WindowSpec, keys: Sequence[str], order: str) -> Column:
    """True, or an error where a date repeats or is missing."""
    wrong = F.raise_error(F.lit(f"{order} repeats or is missing in a series by {list(keys)}")).cast("boolean")
    good = F.col(order).isNotNull() & ~F.coalesce(F.lag(order).over(at) == F.col(order), F.lit(False))
    return F.when(good, True).otherwise(wrong)


def _year_starts(df: DataFrame, order: str) -> DataFrame:
    """year, rows of the years before, and rows in all: as many rows as the data has years."""
    counts = df.groupBy(F.year(order).alias("_year")).agg(F.count(F.lit(1)).alias("_n"))
    years = counts.agg(F.sort_array(F.collect_list(F.struct("_year", "_n"))).alias("_c"))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x["_n"])
    starts = F.transform("_c", lambda x, i: F.struct(x["_year"].alias("_year"), total(F.slice("_c", 1, i)).alias("_start")))
    return years.select(F.explode(starts).alias("_s"), total(F.col("_c")).alias(SIZE)).select("_s._year", "_s._start", SIZE)


def series(df: DataFrame, keys: Sequence[str], order: str, before: int = 0, after: int = 0) -> Series:
    """The series of ``df``; shifts by up to ``before`` rows back and ``after`` rows on may be asked of its window.

    A date that repeats within a series or is missing fails the job; an order column that is not a DATE raises.
    An empty table gives an empty series.
    """
    require_date(df, order)
    if keys:
        at = W.partitionBy(*keys).orderBy(order)
        rows = df.withColumns({"_ok": _once(at, keys, order), PLACE: F.row_number().over(at).cast("long"), SIZE: F.count(F.lit(1)).over(W.partitionBy(*keys))})
        return Series(rows.filter("_ok").drop("_ok"), at, False)
    block_rows = max(BLOCK_ROWS, before, after)
    # One row a year, so the side is bounded by the calendar.
    starts = F.broadcast(_year_starts(df, order))
    in_year = W.partitionBy("_year").orderBy(order)
    placed = df.withColumn("_year", F.year(order)).withColumns({"_ok": _once(in_year, keys, order), "_r": F.row_number().over(in_year)})
    placed = placed.filter("_ok").join(starts, "_year").withColumn(PLACE, F.col("_start") + F.col("_r"))
    home = F.floor((F.col(PLACE) - 1) / block_rows)
    at_place = (F.col(PLACE) - 1) % block_rows
    blocks = [home]
    if before:
        blocks.append(F.when(at_place >= block_rows - before, home + 1))
    if after:
        blocks.append(F.when(at_place < after, home - 1))
    held = F.filter(F.array(*blocks), lambda b: b.isNotNull())
    rows = placed.withColumn(BLOCK, F.explode(held)).withColumn(HOME, F.col(BLOCK) == home).drop("_year", "_ok", "_r", "_start")
    return Series(rows, W.partitionBy(BLOCK).orderBy(PLACE), True)
