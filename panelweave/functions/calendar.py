"""Calendar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave import fixed_values as fv


def month_start(col: Column) -> Column:
    return F.trunc(col.cast("date"), "MM")


def calendar_columns(date: Column) -> dict[str, Column]:
    """Month, quarter, year and their positions on the yearly circle."""
    month, quarter = F.month(date), F.quarter(date)
    turn = 2 * math.pi
    return {
        "month": month,
        "quarter": quarter,
        "month_sin": F.sin(F.lit(turn) * month / F.lit(12.0)),
        "month_cos": F.cos(F.lit(turn) * month / F.lit(12.0)),
        "quarter_sin": F.sin(F.lit(turn) * quarter / F.lit(4.0)),
        "quarter_cos": F.cos(F.lit(turn) * quarter / F.lit(4.0)),
        "year": F.year(date),
    }


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Calendar columns plus months since the earliest date of the table.

    The earliest date is a scalar subquery: one partial minimum per task, one
    value shipped back, no join and no window over the whole table.
    """
    first = df.agg(F.min(date)).scalar()
    since = F.datediff(F.col(date), first) / F.lit(fv.TIME_INDEX_DAYS)
    cols = calendar_columns(F.col(date))
    return df.select("*", *[c.alias(n) for n, c in cols.items()], since.alias("time_idx"))
