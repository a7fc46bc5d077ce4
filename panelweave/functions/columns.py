"""Null-safe column expressions.

ANSI mode raises where these tables need a NULL (division by zero, bad text),
so every risky expression goes through a ``try_`` form here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave import fixed_values as fv


def row_min(cols: Sequence[str | Column]) -> Column:
    """Smallest non-null value of a row; one column stands for itself."""
    cells = [F.col(f"`{c}`") if isinstance(c, str) else c for c in cols]
    return cells[0] if len(cells) == 1 else F.least(*cells)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with NULL for a zero or missing denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def finite(col: Column) -> Column:
    """NULL in place of NaN and both infinities."""
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).otherwise(col)


def parse_date(col: Column, fmt: str = fv.DATE_FORMAT) -> Column:
    """Strict parse: bad text fails the job."""
    return F.to_date(col, fmt)


def parse_date_or_null(col: Column, fmt: str = fv.DATE_FORMAT) -> Column:
    """Lenient parse: bad text becomes NULL."""
    return F.try_to_timestamp(col, F.lit(fmt)).cast("date")


def parse_month_label(col: Column) -> Column:
    """``Jul 2017`` to the first day of that month."""
    return F.to_date(col, "MMM yyyy")


def parse_number(col: Column) -> Column:
    """Lenient number parse; bad text, NaN and infinities become NULL."""
    return finite(col.try_cast("double"))


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete correlation, NULL instead of an error when a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return ratio(F.covar_pop(a, b), spread)


def clamp_unit(r: Column) -> Column:
    """Keep a correlation inside [-1, 1] against rounding noise."""
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def strength_label(r: Column) -> Column:
    """Wording for a correlation."""
    return (
        F.when(r > 0.7, "Strong positive correlation")
        .when(r > 0.4, "Moderate positive correlation")
        .when(r > 0, "Weak positive correlation")
        .otherwise("Negative or no clear correlation")
    )


def type_flags(pc_type: Column) -> dict[str, Column]:
    """Material flags read off the type name."""
    return {
        "is_recycled": F.contains(pc_type, F.lit("recycled")).cast("int"),
        "is_glass_filled": F.contains(pc_type, F.lit("gf")).cast("int"),
        "is_flame_retardant": F.contains(pc_type, F.lit("fr")).cast("int"),
    }
