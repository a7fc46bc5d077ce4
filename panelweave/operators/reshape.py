"""Reshapes (A2-A9): interval allocation, pivots, unpivots, quarters, best prices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import parse_month_label, row_min


def best_prices(df: DataFrame, groups: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """One best-price column per group of supplier columns, next to the kept columns."""
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        *[row_min(cols).alias(name) for name, cols in groups.items()],
    )


def best_price_by_type(df: DataFrame, date: str, cols: Sequence[str]) -> DataFrame:
    """Best price per (date, type) with the type read from names like ``x pc gp (usd/kg)``."""
    long = to_long(df.select(date, *[F.col(f"`{c}`") for c in cols]), [date], cols, "name", "price")
    low = F.lower("name")
    kind = F.trim(F.regexp_extract(low, r"(?:^|.*? )pc (.*?)\(usd/kg\)", 1))
    return (
        long.withColumn("pc_type", kind)
        .filter((F.col("pc_type") != "") & low.contains("(usd/kg)"))
        .groupBy(date, "pc_type")
        .agg(F.min("price").alias("best_price"))
    )


def allocate_interval(df: DataFrame, start: str, end: str, total: str, by: Sequence[str] = ()) -> DataFrame:
    """Spread each interval's total over its days and sum by month.

    Equal to a day-by-day expansion but explodes months only: the share of a
    month is its overlap in days over the inclusive length. Intervals with a
    missing date or total, or ending before they start, are skipped.
    """
    first, last = F.col(start).cast("date"), F.col(end).cast("date")
    spans = df.select(*by, first.alias("_s"), last.alias("_e"), F.col(total).alias("_t")).filter(
        F.col("_s").isNotNull() & F.col("_e").isNotNull() & F.col("_t").isNotNull() & (F.col("_e") >= F.col("_s"))
    )
    months = F.sequence(F.trunc("_s", "MM"), F.trunc("_e", "MM"), F.expr("INTERVAL 1 MONTH"))
    parts = spans.withColumn("date", F.explode(months))
    overlap = (
        F.datediff(F.least(F.col("_e"), F.last_day("date")), F.greatest(F.col("_s"), F.col("date"))) + 1
    )
    share = F.col("_t") / (F.datediff("_e", "_s") + 1) * overlap
    return parts.groupBy(*by, "date").agg(F.sum(share).alias("allocated"))


def to_wide(
    df: DataFrame, idx: Sequence[str], col: str, val: str, values: Mapping[str, str], agg=F.first
) -> DataFrame:
    """Pivot with an explicit value list; ``values`` maps cell value to column name."""
    wide = df.groupBy(*idx).pivot(col, list(values)).agg(agg(val))
    return wide.withColumnsRenamed(dict(values))


def to_long(
    df: DataFrame, ids: Sequence[str], vals: Sequence[str], name: str, value: str, drop_null: bool = False
) -> DataFrame:
    """Unpivot, keeping null cells unless told otherwise."""
    long = df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in vals], name, value)
    return long.filter(F.col(value).isNotNull()) if drop_null else long


def matrix_row_series(df: DataFrame, label_col: str, label: str, value: str) -> DataFrame:
    """One row of a ``Mon YYYY`` matrix as a dated series; ``ValueError`` if the row is absent."""
    row = df.filter(F.col(label_col) == label)
    if row.isEmpty():
        raise ValueError(f"{label} not found in {label_col}")
    months = [
        c
        for c in df.columns
        if c != label_col and not c.startswith("Avg.") and not c.lower().startswith("unnamed")
    ]
    cells = [F.struct(F.lit(c).alias("m"), F.col(f"`{c}`").cast("double").alias("v")) for c in months]
    return (
        row.select(F.explode(F.array(*cells)).alias("c"))
        .select(parse_month_label(F.col("c.m")).alias("date"), F.col("c.v").alias(value))
        .filter(F.col(value).isNotNull())
    )


def price_panel(wide: DataFrame, region: str, date: str = "date") -> DataFrame:
    """Best-price columns to (date, region, pc_type, pc_price), null prices dropped."""
    cols = [c for c in wide.columns if "best_price" in c]
    kind = F.replace(F.replace(F.col("name"), F.lit("_best_price"), F.lit("")), F.lit("pc_"), F.lit(""))
    return to_long(wide, [date], cols, "name", "pc_price", drop_null=True).select(
        F.col(date).alias("date"), F.lit(region).alias("region"), kind.alias("pc_type"), "pc_price"
    )


def prefix_best_prices(df: DataFrame, date: str, prefix: str) -> DataFrame:
    """Date plus the best-price columns under a region prefix."""
    cols = [c for c in df.columns if c != date and "best_price" in c]
    return df.select(date, *[F.col(f"`{c}`").alias(prefix + c) for c in cols])


def quarter_months(quarter: Column) -> Column:
    """``Qn YYYY`` to its three month starts; bad text gives an empty array."""
    q = F.regexp_extract(quarter, r"^\s*Q?([1-4])\s+(\d{4})\s*$", 1)
    y = F.regexp_extract(quarter, r"^\s*Q?([1-4])\s+(\d{4})\s*$", 2)
    first = F.make_date(y.try_cast("int"), (q.try_cast("int") - 1) * 3 + 1, F.lit(1))
    return F.when(first.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.add_months(first, k)))


def quarters_to_months(df: DataFrame, quarter: str) -> DataFrame:
    """Repeat each quarter's values for its three months; unreadable quarters are skipped."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != quarter]
    return df.select(F.explode(quarter_months(F.col(quarter))).alias("date"), *rest)


def grid_series(cells: DataFrame, date_row: int, rows: Mapping[int, str], first_col: int) -> DataFrame:
    """Rows of a staged cell table ``(row_idx, col_idx, value)`` as quarterly records."""
    wanted = [date_row, *rows]
    grid = (
        cells.filter(F.col("row_idx").isin(wanted) & (F.col("col_idx") >= first_col))
        .groupBy("col_idx")
        .pivot("row_idx", wanted)
        .agg(F.first("value"))
    )
    return grid.filter(F.col(f"`{date_row}`").isNotNull()).select(
        F.col(f"`{date_row}`").alias("quarter"),
        *[F.col(f"`{r}`").try_cast("double").alias(n) for r, n in rows.items()],
    )
