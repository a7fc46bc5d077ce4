"""Series features over windows.

Every function takes a table with one row per (keys, date). The date must be a
DATE, so a series holds at most one row per calendar day whatever the size of
the raw data it was aggregated from; hot keys are collapsed by the partial
aggregation that builds the series, before any window is shuffled. All columns
of one call share one window specification: one exchange, one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.columns import ratio
from panelweave.operators.checks import require_date

SERIES_KEYS = ("region", "pc_type")


def series_window(keys: Sequence[str], order: str):
    return W.partitionBy(*keys).orderBy(order)


def _with(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def lag_columns(cols, lags, keys=SERIES_KEYS, order="date") -> dict[str, Column]:
    w = series_window(keys, order)
    return {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in lags}


def add_lags(df: DataFrame, cols, lags, keys=SERIES_KEYS, order="date") -> DataFrame:
    """Value ``k`` rows earlier in the same series."""
    require_date(df, order)
    return _with(df, lag_columns(cols, lags, keys, order))


def rolling_columns(cols, windows, keys=SERIES_KEYS, order="date", std="all", label="roll") -> dict[str, Column]:
    """Trailing means and sample deviations, current row included, one value enough.

    ``std="last"`` keeps the deviation of the last window only, as the long
    panel does; the wide table has it for every window.
    """
    w = series_window(keys, order)
    out: dict[str, Column] = {}
    for c in cols:
        for k in windows:
            frame = w.rowsBetween(-(k - 1), 0)
            out[f"{c}_{label}_mean_{k}"] = F.avg(c).over(frame)
            if std == "all" or k == windows[-1]:
                out[f"{c}_{label}_std_{k}"] = F.stddev_samp(c).over(frame)
    return out


def add_rolling(df: DataFrame, cols, windows, keys=SERIES_KEYS, order="date", std="all", label="roll") -> DataFrame:
    require_date(df, order)
    return _with(df, rolling_columns(cols, windows, keys, order, std, label))


def expanding_columns(cols, keys=SERIES_KEYS, order="date") -> dict[str, Column]:
    w = series_window(keys, order).rowsBetween(W.unboundedPreceding, 0)
    out: dict[str, Column] = {}
    for c in cols:
        low, high = F.min(c).over(w), F.max(c).over(w)
        out[f"{c}_expanding_mean"] = F.avg(c).over(w)
        out[f"{c}_expanding_std"] = F.stddev_samp(c).over(w)
        out[f"{c}_expanding_min"] = low
        out[f"{c}_expanding_max"] = high
        out[f"{c}_dist_from_max"] = high - F.col(c)
        out[f"{c}_dist_from_min"] = F.col(c) - low
    return out


def add_expanding(df: DataFrame, cols, keys=SERIES_KEYS, order="date") -> DataFrame:
    """Running mean, deviation, extremes and the distance from both extremes."""
    require_date(df, order)
    return _with(df, expanding_columns(cols, keys, order))


def roc_columns(cols, periods, keys=SERIES_KEYS, order="date") -> dict[str, Column]:
    w = series_window(keys, order)
    return {f"{c}_roc_{k}": ratio(F.col(c), F.lag(c, k).over(w)) - 1 for c in cols for k in periods}


def add_roc(df: DataFrame, cols, periods, keys=SERIES_KEYS, order="date") -> DataFrame:
    """Rate of change over ``k`` rows; NULL where the earlier value is zero or missing."""
    require_date(df, order)
    return _with(df, roc_columns(cols, periods, keys, order))


def diff_columns(cols, periods, keys=SERIES_KEYS, order="date", log=True) -> dict[str, Column]:
    w = series_window(keys, order)
    out: dict[str, Column] = {}
    for c in cols:
        for k in periods:
            out[f"{c}_diff_{k}"] = F.col(c) - F.lag(c, k).over(w)
            if log:
                out[f"{c}_log_diff_{k}"] = F.ln(F.col(c)) - F.ln(F.lag(c, k).over(w))
    return out


def add_diff(df: DataFrame, cols, periods, keys=SERIES_KEYS, order="date", log=True) -> DataFrame:
    """Plain and logarithmic differences over ``k`` rows."""
    require_date(df, order)
    return _with(df, diff_columns(cols, periods, keys, order, log))


def add_momentum(df: DataFrame, col="pc_price", keys=SERIES_KEYS, order="date", prefix="price") -> DataFrame:
    """Change over 3 and 6 rows, and the change of the 3-row momentum."""
    require_date(df, order)
    w = series_window(keys, order)
    x = F.col(col)
    three = x - F.lag(col, 3).over(w)
    before = F.lag(col, 1).over(w) - F.lag(col, 4).over(w)
    return _with(
        df,
        {
            f"{prefix}_momentum_3m": three,
            f"{prefix}_momentum_6m": x - F.lag(col, 6).over(w),
            f"{prefix}_acceleration_3m": three - before,
        },
    )


def add_cross_series(df: DataFrame, col="pc_price", by=("date", "region")) -> DataFrame:
    """Mean and deviation across the types of a region at one date, and the gap to that mean.

    The group is one row per type, so it is as small as the type dictionary.
    """
    w = W.partitionBy(*by)
    mean = F.avg(col).over(w)
    return _with(
        df,
        {
            "regional_avg_price": mean,
            "regional_price_volatility": F.stddev_samp(col).over(w),
            "price_deviation_from_regional_avg": F.col(col) - mean,
        },
    )


def fill_both(col: str | Column, keys: Sequence[str], order: str) -> Column:
    """Forward fill, then backward fill what is left at the start."""
    w = series_window(keys, order)
    past = F.last(col, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    future = F.first(col, True).over(w.rowsBetween(0, W.unboundedFollowing))
    return F.coalesce(past, future)


def fill_forward(col: str | Column, keys: Sequence[str], order: str) -> Column:
    return F.last(col, True).over(series_window(keys, order).rowsBetween(W.unboundedPreceding, 0))


def record_gaps(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Days between successive records of a key.

    Records of one key and date are first folded into one row with their count
    ``n``: the first has the gap below, the other ``n - 1`` have gap 0. So a
    key with very many records still yields at most one row per day.
    """
    days = df.groupBy(*keys, F.col(date).cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("gap_days", F.datediff("date", F.lag("date").over(series_window(keys, "date"))))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Frequency of each gap, repeats on one day counted as gap 0."""
    pairs = gaps.select(
        F.explode(
            F.array(
                F.struct(F.col("gap_days").alias("gap_days"), F.lit(1).cast("bigint").alias("k")),
                F.struct(F.lit(0).alias("gap_days"), (F.col("n") - 1).alias("k")),
            )
        ).alias("p")
    ).select("p.*")
    return (
        pairs.filter(F.col("gap_days").isNotNull() & (F.col("k") > 0))
        .groupBy("gap_days")
        .agg(F.sum("k").alias("records"))
    )


def running_total(df: DataFrame, col: str, keys: Sequence[str], order: str, name: str) -> DataFrame:
    w = series_window(keys, order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(col).over(w))


def add_target(df: DataFrame, col: str, h: int, keys: Sequence[str], order="date", name="target") -> DataFrame:
    """Value ``h`` rows ahead in the same group; put the split column in ``keys`` to stay inside it."""
    require_date(df, order)
    return df.withColumn(name, F.lead(col, h).over(series_window(keys, order)))


def naive_forecast(df: DataFrame, col: str, h: int, keys=SERIES_KEYS, order="date", season: int = 12) -> DataFrame:
    """Last known value and value one season back as forecasts."""
    require_date(df, order)
    w = series_window(keys, order)
    return _with(df, {"naive": F.lag(col, h).over(w), "seasonal_naive": F.lag(col, season).over(w)})


def monthly_interpolate(df: DataFrame, keys: Sequence[str], date: str, col: str) -> DataFrame:
    """Every month between first and last, gaps filled in proportion to elapsed days."""
    spine = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    spine = spine.select(
        *keys, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 MONTH"))).alias(date)
    )
    full = spine.join(df.select(*keys, date, col), [*keys, date], "left")
    w = series_window(keys, date)
    known = F.when(F.col(col).isNotNull(), F.struct(F.col(date).alias("d"), F.col(col).alias("v")))
    prev = F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    nxt = F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing))
    ends = full.select("*", prev.alias("_p"), nxt.alias("_n"))
    weight = ratio(F.datediff(F.col(date), F.col("_p.d")), F.datediff(F.col("_n.d"), F.col("_p.d")))
    value = F.coalesce(
        F.col(col),
        F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * weight,
        F.col("_p.v"),
    )
    return ends.select(*keys, date, value.alias(col))


def last_rows(df: DataFrame, n: int, keys: Sequence[str], order: str) -> DataFrame:
    """Latest ``n`` rows of each series; Spark keeps ``n`` per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
