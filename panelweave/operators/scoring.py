"""Forecast scores and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.functions.columns import ratio


def floored_error(y: Column, yhat: Column) -> Column:
    """Absolute relative error with the smallest positive step as denominator floor."""
    return F.abs(y - yhat) / F.greatest(F.abs(y), F.lit(fv.MAPE_FLOOR))


def skipped_error(y: Column, yhat: Column) -> Column:
    """Absolute relative error, NULL where the truth is zero or either side is missing."""
    return F.abs(ratio(y - yhat, y))


def mape(
    df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), weight: str | None = None, zero: str = "floor"
) -> DataFrame:
    """Mean (and weighted mean) absolute percentage error, as a fraction.

    ``zero="floor"`` and ``zero="skip"`` are two different scores; both are in use.
    """
    error = {"floor": floored_error, "skip": skipped_error}[zero](F.col(y), F.col(yhat))
    aggs = [F.avg(error).alias("mape"), F.count(error).alias("n")]
    if weight is not None:
        w = F.when(error.isNotNull(), F.col(weight))
        aggs.insert(1, ratio(F.sum(w * error), F.sum(w)).alias("weighted_mape"))
    return df.groupBy(*by).agg(*aggs)


def combine_scores(df: DataFrame, by: Sequence[str], score: str, n: str, kind: str | None = None) -> DataFrame:
    """Mean and row-weighted mean of per-series scores, with regular and green subsets (M9).

    Series without a score do not count; a series with no test rows weighs 1.
    """
    s = F.col(score)
    w = F.when(s.isNotNull(), F.coalesce(F.nullif(F.col(n), F.lit(0)), F.lit(1)).cast("double"))
    aggs = [F.avg(s).alias("global_mape"), ratio(F.sum(w * s), F.sum(w)).alias("weighted_mape")]
    if kind is not None:
        for label in (fv.REGULAR, fv.GREEN):
            aggs.append(F.avg(F.when(F.col(kind) == label, s)).alias(f"{label}_mape"))
    return df.groupBy(*by).agg(*aggs)


def ar1_diff_forecast(train: DataFrame, keys: Sequence[str], order: str, col: str, h: int) -> DataFrame:
    """(keys, step, forecast) for h steps: AR(1) on first differences, no constant."""
    w = W.partitionBy(*keys).orderBy(order)
    diffs = train.select(*keys, order, col, (F.col(col) - F.lag(col, 1).over(w)).alias("_d"))
    pairs = diffs.select("*", F.lag("_d", 1).over(w).alias("_p"))
    fit = pairs.groupBy(*keys).agg(
        F.sum(F.col("_d") * F.col("_p")).alias("_dp"),
        F.sum(F.when(F.col("_d").isNotNull(), F.col("_p") * F.col("_p"))).alias("_pp"),
        F.max_by(F.struct(F.col(col).alias("y"), F.col("_d").alias("d")), F.col(order)).alias("_last"),
    )
    phi = ratio(F.col("_dp"), F.col("_pp"))
    coef = fit.select(*keys, phi.alias("_phi"), "_last", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    push = F.aggregate(
        F.sequence(F.lit(1), F.col("step")), F.lit(0.0), lambda acc, k: acc + F.pow(F.col("_phi"), k.cast("double"))
    )
    return coef.select(*keys, "step", (F.col("_last.y") + F.col("_last.d") * push).alias("forecast"))


def score_ar1(train: DataFrame, test: DataFrame, keys: Sequence[str], order: str, col: str, h: int) -> DataFrame:
    """Score of the first ``min(h, test rows)`` steps per series, with a note where none exists."""
    w = W.partitionBy(*keys).orderBy(order)
    fc = ar1_diff_forecast(train, keys, order, col, h)
    ahead = test.select(*keys, F.col(col).alias("_y"), F.row_number().over(w).alias("step")).filter(F.col("step") <= h)
    scored = (
        ahead.join(fc, [*keys, "step"], "left")
        .groupBy(*keys)
        .agg(F.avg(skipped_error(F.col("_y"), F.col("forecast"))).alias("mape"), F.count(F.lit(1)).alias("_steps"))
    )
    size = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_train"))
    every = train.select(*keys).unionByName(test.select(*keys)).distinct()
    full = every.join(size, list(keys), "left").join(scored, list(keys), "left")
    short = F.coalesce(F.col("_train"), F.lit(0)) <= 1
    empty = F.col("_steps").isNull()
    return full.select(
        *keys,
        F.when(~short & ~empty, F.col("mape")).alias("mape"),
        F.when(short | empty, F.lit(0)).otherwise(F.col("_steps")).cast("bigint").alias("n_points"),
        F.when(empty, "test set empty").when(short, "train too short").alias("note"),
    )
