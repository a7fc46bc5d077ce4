"""Raw files to cleaned monthly series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.functions.calendar import month_start
from panelweave.functions.columns import parse_date, parse_date_or_null, parse_number, row_min
from panelweave.functions.units import repair_unit, standard_names, to_eur_kg, to_usd_kg
from panelweave.operators.joins import date_dimension, full_join_all, lookup_rate
from panelweave.operators.profile import date_statistics
from panelweave.operators.reshape import (
    allocate_interval,
    best_prices,
    grid_series,
    matrix_row_series,
    quarters_to_months,
    to_wide,
)
from panelweave.operators.splits import non_empty_columns
from panelweave.operators.windows import fill_both


def exchange_rates(rmb: DataFrame, inr: DataFrame, eur: DataFrame) -> DataFrame:
    """One rate table from three, dates of any of them kept."""
    parts = [
        t.select(parse_date(F.col(fv.RATE_DATE).cast("string")).alias(fv.RATE_DATE), F.col(c).try_cast("double").alias(c))
        for t, c in ((rmb, fv.RATE_RMB), (inr, fv.RATE_INR), (eur, fv.RATE_EUR))
    ]
    return full_join_all(parts, [fv.RATE_DATE])


def type_groups(region: str, grouped: bool) -> dict[str, tuple[str, ...]]:
    """Best-price column name to the supplier columns it is the minimum of."""
    if region == fv.EUROPE:
        kinds = dict(fv.EU_TYPE_COLUMNS)
        regular, green = fv.REGULAR_TARGET_TYPES, fv.GREEN_TARGET_TYPES
    else:
        kinds = dict(fv.ASIA_TYPE_COLUMNS)
        regular, green = fv.ASIA_REGULAR_TYPES, fv.ASIA_GREEN_TYPES
    if not grouped:
        kinds = {
            fv.REGULAR: tuple(c for t in regular for c in kinds[t]),
            fv.GREEN: tuple(c for t in green for c in kinds[t]),
        }
    return {f"pc_{t}_best_price": cols for t, cols in kinds.items()}


def europe_prices(raw: DataFrame, grouped: bool) -> DataFrame:
    """Best price per type from the cleaned-header Europe file.

    Finding the empty columns is one counting pass; only columns a best price
    or the kept reference and spread lists need are read.
    """
    groups = type_groups(fv.EUROPE, grouped)
    needed = {c for cols in groups.values() for c in cols}
    extra = [c for c in raw.columns if c in fv.EU_REFERENCE_COLUMNS + fv.EU_SPREAD_COLUMNS]
    typed = raw.select(
        parse_date(F.col("date")).alias("date"),
        *[parse_number(F.col(f"`{c}`")).alias(c) for c in raw.columns if c in needed or c in extra],
    )
    kept = ["date", *non_empty_columns(typed, extra)] if extra else ["date"]
    return best_prices(typed, groups, kept)


def fill_rates(df: DataFrame, rates: DataFrame, date: str = "date") -> DataFrame:
    """Complete the three exchange rates of a date-keyed table.

    A zero or missing RMB rate is looked up; the other two are always looked
    up; what is still open is filled forward, then backward. Only dates and
    rates pass through the fill window, one row per date, which the calendar
    bounds; the other columns stay where they are and meet the filled rates in
    a broadcast join.
    """
    own = F.nullif(F.col(fv.ASIA_RATE_RMB), F.lit(0.0)) if fv.ASIA_RATE_RMB in df.columns else F.lit(None).cast("double")
    looked = rates.select(
        F.col(fv.RATE_DATE).alias(date),
        F.col(fv.RATE_RMB).alias(fv.ASIA_RATE_RMB),
        F.col(fv.RATE_INR).alias(fv.ASIA_RATE_INR),
        F.col(fv.RATE_EUR).alias(fv.ASIA_RATE_EUR),
    )
    slim = lookup_rate(df.select(date, own.alias("_own")), looked.select(date, fv.ASIA_RATE_RMB), date, fv.ASIA_RATE_RMB, F.col("_own"))
    others = date_dimension(looked.select(date, fv.ASIA_RATE_INR, fv.ASIA_RATE_EUR), date)
    open_rates = slim.drop("_own").join(others, date, "left").withColumn("_one", F.lit(0))
    names = (fv.ASIA_RATE_RMB, fv.ASIA_RATE_INR, fv.ASIA_RATE_EUR)
    filled = open_rates.select(date, *[fill_both(F.col(f"`{n}`"), ["_one"], date).alias(n) for n in names])
    return df.drop(*names).join(date_dimension(filled, date), date, "left")


def convert_prices(df: DataFrame, units: Mapping[str, str], date: str = "date") -> DataFrame:
    """Date and one USD-per-kilo column per standard name; rates are kept alongside.

    Units and names belong to the header, so each cell is converted in place
    and columns that share a standard name merge by a row minimum: no unpivot,
    no shuffle. Unparseable columns drop out.
    """
    cols = [c for c in df.columns if c in units]
    names = standard_names(df.sparkSession, cols)
    rmb, inr = F.col(f"`{fv.ASIA_RATE_RMB}`"), F.col(f"`{fv.ASIA_RATE_INR}`")
    cells: dict[str, list[Column]] = {}
    for c in cols:
        if names[c] is not None:
            cells.setdefault(names[c], []).append(to_usd_kg(repair_unit(F.col(f"`{c}`"), units[c]), units[c], rmb, inr))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in units]
    return df.select(*rest, *[row_min(parts).alias(n) for n, parts in sorted(cells.items())])


def asia_prices(raw: DataFrame, rates: DataFrame, grouped: bool) -> DataFrame:
    """Best price per type in EUR per kilo, freight included, from the cleaned-header Asia file."""
    keep = fv.ASIA_REFERENCE_COLUMNS + fv.ASIA_SPREAD_COLUMNS
    numeric = [c for c in raw.columns if c in fv.ASIA_COLUMN_UNITS or c in keep or c == fv.ASIA_RATE_RMB]
    typed = raw.select(parse_date(F.col("date")).alias("date"), *[parse_number(F.col(f"`{c}`")).alias(c) for c in numeric])
    extra = [c for c in numeric if c in keep]
    kept = non_empty_columns(typed, extra) if extra else []
    usd = convert_prices(fill_rates(typed, rates), fv.ASIA_COLUMN_UNITS)
    groups = {best: [c for c in cols if c in usd.columns] for best, cols in type_groups(fv.ASIA, grouped).items()}
    rate = F.col(f"`{fv.ASIA_RATE_EUR}`")
    return usd.select(
        "date",
        *[F.col(f"`{c}`") for c in kept],
        *[to_eur_kg(row_min(cols), rate).alias(best) for best, cols in groups.items() if cols],
    )


def electricity_statistics(raw: DataFrame) -> DataFrame:
    """Spread of national prices per date; rows without a readable date or price are dropped."""
    named = raw.withColumnsRenamed(fv.ELECTRICITY_RENAMES)
    typed = named.select(
        parse_date_or_null(F.col("date")).alias("date"), parse_number(F.col("price_eur_mwhe")).alias("price")
    ).dropna(subset=["date", "price"])
    return date_statistics(typed, "date", "price", "price_eur_mwhe")


def registrations(raw: DataFrame) -> DataFrame:
    """Monthly car registrations at month start."""
    named = raw.withColumnRenamed(fv.REGISTRATION_RAW, fv.REGISTRATION)
    typed = named.select(
        month_start(parse_date_or_null(F.col("date"))).alias("date"), parse_number(F.col(fv.REGISTRATION)).alias(fv.REGISTRATION)
    )
    return typed.dropna(subset=["date", fv.REGISTRATION])


def bpa_capacity_loss(matrix: DataFrame) -> DataFrame:
    return matrix_row_series(matrix, fv.DERIVATIVE, fv.BPA_ROW, "bpa_capacity_loss_kt")


def shutdown_losses(acetone: DataFrame, phenol: DataFrame) -> DataFrame:
    """Monthly capacity loss per chemical, outages spread over their days."""
    parts = [
        t.select(
            F.lit(name).alias("chemical"),
            parse_date_or_null(F.col(fv.OUTAGE_START).cast("string")).alias("start"),
            parse_date_or_null(F.col(fv.OUTAGE_END).cast("string")).alias("end"),
            F.col(fv.OUTAGE_LOSS).try_cast("double").alias("loss"),
        )
        for t, name in ((acetone, "acetone"), (phenol, "phenol"))
    ]
    monthly = allocate_interval(parts[0].unionByName(parts[1]), "start", "end", "loss", ["chemical"])
    names = {"acetone": "acetone_capacity_loss_kt", "phenol": "phenol_capacity_loss_kt"}
    return to_wide(monthly, ["date"], "chemical", "allocated", names)


def commodities(cells: DataFrame) -> DataFrame:
    """Monthly commodity prices from the staged quarterly sheet."""
    return quarters_to_months(grid_series(cells, fv.GRID_DATE_ROW, fv.GRID_ROWS, fv.GRID_FIRST_COL), "quarter")
