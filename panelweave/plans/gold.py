"""Cleaned series to feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.functions.calendar import add_calendar
from panelweave.functions.columns import type_flags
from panelweave.operators.checks import unique_by
from panelweave.operators.joins import attach_monthly, full_join_all
from panelweave.operators.reshape import prefix_best_prices, price_panel, to_long
from panelweave.operators.splits import cutoff_split
from panelweave.operators.windows import (
    SERIES_KEYS,
    add_cross_series,
    diff_columns,
    expanding_columns,
    lag_columns,
    roc_columns,
    rolling_columns,
)

PANEL_KEYS = ("region", "pc_type", "date")


def check_horizon(horizon: int) -> int:
    if horizon not in fv.HORIZONS:
        raise ValueError(f"unsupported horizon: {horizon}; must be one of {fv.HORIZONS}")
    return horizon


def long_base(prices: Mapping[str, DataFrame], exogenous: Sequence[DataFrame]) -> DataFrame:
    """(date, region, pc_type, pc_price) of all regions with the monthly side tables attached."""
    parts = [price_panel(wide, region) for region, wide in prices.items()]
    panel = parts[0]
    for more in parts[1:]:
        panel = panel.unionByName(more)
    return attach_monthly(panel, exogenous)


def long_features(base: DataFrame, horizon: int, exogenous: Sequence[str] = fv.EXOGENOUS_COLUMNS) -> DataFrame:
    """Training table of the long panel for one horizon.

    All series features share one window on (region, pc_type); the cross-series
    features need a second one on (date, region). The rows are partitioned by
    series first, which serves the key check and the series window alike; the
    check fails the job on a repeated key.
    """
    lags, windows = fv.HORIZON_LAGS[check_horizon(horizon)], fv.HORIZON_WINDOWS[horizon]
    checked = unique_by(base.repartition(*SERIES_KEYS), PANEL_KEYS)
    own: dict[str, Column] = {
        **lag_columns(["pc_price"], lags),
        **rolling_columns(["pc_price"], windows, std="last", label="rolling"),
    }
    late = lag_columns(exogenous, lags[:3])
    lagged = checked.select("*", *[c.alias(n) for n, c in {**own, **late}.items()])
    crossed = add_cross_series(add_calendar(lagged, "date"))
    full = crossed.select("*", *[c.alias(n) for n, c in type_flags(F.col("pc_type")).items()])
    order = [
        "date",
        "region",
        "pc_type",
        "pc_price",
        *exogenous,
        *[c for c in full.columns if c not in {"date", "region", "pc_type", "pc_price", *exogenous, *late}],
        *late,
    ]
    return full.select(*order)


def long_table(
    prices: Mapping[str, DataFrame], exogenous: Sequence[DataFrame], horizon: int, cutoff: str = fv.CUTOFF_DATE
) -> tuple[DataFrame, DataFrame]:
    """Feature rows before the cutoff and the bare prices from it on."""
    past, future = cutoff_split(long_base(prices, exogenous), "date", cutoff)
    cols = fv.EXOGENOUS_COLUMNS if exogenous else ()
    return long_features(past, horizon, cols), future.select("date", "region", "pc_type", "pc_price")


def wide_base(prices: Mapping[str, DataFrame], exogenous: Sequence[DataFrame]) -> DataFrame:
    """One row per date over all regions, region-prefixed price columns, side tables attached."""
    sides = [prefix_best_prices(wide, "date", fv.REGION_PREFIX[region]) for region, wide in prices.items()]
    return attach_monthly(full_join_all(sides, ["date"]), exogenous)


def _pivoted(base: DataFrame, cols: Sequence[str], features: Mapping[str, Column]) -> DataFrame:
    """Features of many columns at once: unpivot, one window per series, pivot back.

    A window over the wide table itself has no key and would pull every row
    into one task; per series the work spreads over the series.
    """
    long = to_long(base, ["date"], cols, "series", "x")
    shaped = long.select("date", "series", *[c.alias(n.removeprefix("x_")) for n, c in features.items()])
    names = [n.removeprefix("x_") for n in features]
    return shaped.groupBy("date").pivot("series", list(cols)).agg(*[F.first(n).alias(n) for n in names])


def wide_features(
    base: DataFrame,
    horizon: int,
    targets: Sequence[str],
    exogenous: Sequence[str] = fv.EXOGENOUS_COLUMNS,
    differencing: bool = True,
) -> DataFrame:
    """Training table of the wide layout for one horizon."""
    lags, windows = fv.HORIZON_LAGS[check_horizon(horizon)], fv.HORIZON_WINDOWS[horizon]
    at = {"keys": ("series",), "order": "date"}
    own = {
        **lag_columns(["x"], lags, **at),
        **rolling_columns(["x"], windows, **at),
        **expanding_columns(["x"], **at),
        **roc_columns(["x"], fv.HORIZON_ROC[horizon], **at),
    }
    if differencing:
        own |= diff_columns(["x"], fv.DIFF_PERIODS, **at)
    out = add_calendar(base, "date").join(_pivoted(base, targets, own), "date", "left")
    if exogenous:
        side = {**lag_columns(["x"], lags[:2], **at), **rolling_columns(["x"], windows, **at)}
        out = out.join(_pivoted(base, exogenous, side), "date", "left")
    return out


def wide_table(
    prices: Mapping[str, DataFrame],
    exogenous: Sequence[DataFrame],
    horizon: int,
    targets: Sequence[str],
    cutoff: str = fv.CUTOFF_DATE,
    differencing: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Feature rows before the cutoff and the target prices from it on."""
    past, future = cutoff_split(wide_base(prices, exogenous), "date", cutoff)
    cols = fv.EXOGENOUS_COLUMNS if exogenous else ()
    return wide_features(past, horizon, targets, cols, differencing), future.select("date", *targets)


def select_type_columns(df: DataFrame, pc_type: str, exogenous: Sequence[str] = fv.EXOGENOUS_COLUMNS) -> DataFrame:
    """Columns for one target type, by substring.

    A type whose name is part of another also selects the other's columns;
    exogenous columns are always kept.
    """
    if pc_type not in fv.TARGET_TYPES:
        raise ValueError(f"unknown type: {pc_type}")
    own = [c for c in df.columns if pc_type in c]
    side = [c for e in exogenous for c in df.columns if e in c and c not in own]
    return df.select(*[F.col(f"`{c}`") for c in [*own, *dict.fromkeys(side), "date"]])


__all__ = ["SERIES_KEYS", "long_table", "wide_table", "long_features", "wide_features", "select_type_columns"]
