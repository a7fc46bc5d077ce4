"""Unit repair, currency conversion and supplier/type names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.functions.columns import ratio


def _by_unit(unit: Column | str, rules: dict[str, Callable[[], Column]], otherwise: Column | None) -> Column:
    """The rule of one unit known while planning, or a CASE over all where the unit is data."""
    if isinstance(unit, str):
        return rules[unit]() if unit in rules else (F.lit(None).cast("double") if otherwise is None else otherwise)
    (first, rule), *rest = rules.items()
    out = F.when(unit == first, rule())
    for name, rule in rest:
        out = out.when(unit == name, rule())
    return out if otherwise is None else out.otherwise(otherwise)


def repair_unit(
    price: Column,
    unit: Column | str,
    threshold_rmb: float = fv.RMB_THRESHOLD,
    threshold_usd: float = fv.USD_THRESHOLD,
) -> Column:
    """Undo values typed per ton in a per-kilo column, and the reverse."""
    rules = {
        fv.RMB_T: lambda: F.when(price < threshold_rmb, price * 1000).otherwise(price),
        fv.RMB_KG: lambda: F.when(price > threshold_rmb, price / 1000).otherwise(price),
        fv.USD_T: lambda: F.when(price < threshold_usd, price * 1000).otherwise(price),
        fv.USD_KG: lambda: F.when(price > threshold_usd * 100, price / 1000).otherwise(price),
    }
    return _by_unit(unit, rules, price)


def to_usd_kg(price: Column, unit: Column | str, usd_rmb: Column, usd_inr: Column) -> Column:
    """Price per kilo in USD from a repaired price; unknown units give NULL."""
    rules = {
        fv.USD_KG: lambda: price,
        fv.USD_T: lambda: price / 1000,
        fv.RMB_KG: lambda: ratio(price, usd_rmb),
        fv.INR_KG: lambda: ratio(price, usd_inr),
        fv.RMB_T: lambda: ratio(price, usd_rmb) / 1000,
    }
    return _by_unit(unit, rules, None)


def to_eur_kg(price_usd: Column, usd_per_eur: Column, freight: float = fv.TRANSPORT_COST_EUR_KG) -> Column:
    """Landed price in EUR: the rate counts USD per EUR, so it divides."""
    return ratio(price_usd, usd_per_eur) + F.lit(freight)


SUPPLIER_PATTERN = "asia_supplier_[1-9]"
TYPE_PATTERN = "^(" + "|".join(fv.ASIA_TYPE_ORDER) + ")(?= |\\(|$)"


def supplier_of(name: Column) -> Column:
    found = F.regexp_extract(F.lower(name), SUPPLIER_PATTERN, 0)
    return F.nullif(found, F.lit(""))


def type_of(name: Column) -> Column:
    """Type after the first `` pc ``; the earliest entry of the ordered list wins."""
    tail = F.get(F.split(F.lower(name), " pc ", 2), F.lit(1))
    found = F.regexp_extract(tail, TYPE_PATTERN, 1)
    return F.nullif(found, F.lit(""))


def converted_name(name: Column) -> Column:
    """Standard name of a converted price column; NULL means the column is dropped."""
    low = F.lower(name)
    supplier, kind = supplier_of(name), type_of(name)
    parsed = F.when(
        supplier.isNotNull() & kind.isNotNull(),
        F.concat(supplier, F.lit(" pc "), kind, F.lit(" (usd/kg)")),
    )
    return F.coalesce(
        parsed,
        F.when(
            F.contains(low, F.lit(" si recycled ")) | F.startswith(low, F.lit("pc si recycled")),
            F.lit("pc si recycled (usd/kg)"),
        ).when(
            F.contains(low, F.lit(" si ")) | F.startswith(low, F.lit("pc si")),
            F.lit("pc si (usd/kg)"),
        ),
    )


def standard_names(spark: SparkSession, names: Sequence[str]) -> dict[str, str | None]:
    """:func:`converted_name` of a header, evaluated once while planning (runs a tiny job)."""
    header = spark.createDataFrame([(n,) for n in names], "name string")
    return {r["name"]: r["std"] for r in header.select("name", converted_name(F.col("name")).alias("std")).collect()}
