"""Unit-root tests from lagged cross-moments.

The regression of a series' changes on its last level and its last changes needs only sums of products. One
aggregation gives them for all lag orders of a series; sweeping the moment matrix column by column then gives
the residual sum of every order in turn, as array expressions. Rows never leave the JVM, and what a series
leaves behind is one small matrix, whose size depends on the lag order and not on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.operators.series import PLACE, SIZE, series
from panelweave.session import materialize

#: Below this share of its own square sum a regressor counts as a combination of those before it.
SINGULAR = 1e-10
#: Below this share of the changes' square sum a fit counts as perfect, which leaves no test.
PERFECT = 1e-20
#: Terms of the series for the normal distribution, enough for every z up to 12.
NORMAL_TERMS = 250


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution: 1/2 + density * (z + z^3/3 + z^5/(3*5) + ...)."""

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    start = F.struct(z.alias("term"), z.alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(NORMAL_TERMS)), start, add, lambda s: s["total"])
    inner = 0.5 + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * total
    return F.when(z > 12, 1.0).when(z < -12, 0.0).when(z.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner)))


def p_value(tau: Column) -> Column:
    """Published response-surface approximation for a regression with a constant."""
    least, switch, most = fv.UNIT_ROOT_RANGE
    surface = F.when(tau <= switch, _polynomial(tau, fv.UNIT_ROOT_LOW)).otherwise(_polynomial(tau, fv.UNIT_ROOT_HIGH))
    return F.when(tau > most, 1.0).when(tau < least, 0.0).when(tau.isNotNull(), normal_cdf(surface))


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + c
    return total


def most_lags(n: int) -> int:
    """The highest lag order tried for ``n`` values."""
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)


def _changes(long: DataFrame, keys: Sequence[str], order: str, value: str, reach: int) -> DataFrame:
    """keys, n, i, level and recent: a row per change, with the level before it and the changes up to it.

    ``recent`` holds the change itself and up to ``reach`` earlier ones, newest first. Values are shifted and
    scaled per series, which leaves the test as it is and keeps the moments well conditioned. Series that do
    not vary have null levels.
    """
    s = series(long.filter(F.col(value).isNotNull()), keys, order)
    group, y = W.partitionBy(*keys), F.col(value).cast("double")
    spread = F.when(F.max(y).over(group) > F.min(y).over(group), F.stddev_pop(y).over(group))
    rows = s.rows.select(*keys, order, F.col(SIZE).alias("n"), (F.col(PLACE) - 1).alias("_i"), ((y - F.avg(y).over(group)) / spread).alias("_z"))
    rows = rows.withColumn("_level", F.lag("_z").over(s.window)).withColumn("_change", F.col("_z") - F.col("_level"))
    recent = F.reverse(F.collect_list("_change").over(s.window.rowsBetween(-reach, 0)))
    return rows.withColumn("_recent", recent).filter("_i > 0").select(*keys, "n", "_i", "_level", "_recent")


def _moments(rows: DataFrame, keys: Sequence[str], lags: Column) -> DataFrame:
    """keys, m rows and their matrix a of sums of products of: 1, level, ``lags`` earlier changes, change."""
    entries = F.concat(F.array(F.lit(1.0), F.col("_level")), F.slice("_recent", F.lit(2), lags), F.slice("_recent", 1, 1))
    used = rows.filter((F.col("_i") > lags) & F.col("_level").isNotNull()).select(*keys, entries.alias("_v"))
    products = F.flatten(F.transform("_v", lambda x: F.transform(F.col("_v"), lambda y: x * y)))
    sums = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.max(F.size("_v")).alias("_k"), Summarizer.sum(array_to_vector(products)).alias("_s"))
    cells = sums.select(*keys, "_m", "_k", vector_to_array("_s").alias("_s"))
    matrix = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.slice("_s", i * F.col("_k") + 1, F.col("_k")))
    return cells.select(*keys, "_m", "_k", matrix.alias("_a"))


def _swept() -> Column:
    """The matrix ``a`` swept by all regressors (a), and the residual sum after each (rss).

    A regressor that those before it explain turns everything after it into NaN.
    """
    first, last = F.col("_a"), F.col("_k") - 1

    def pivot(s: Column, p: Column) -> Column:
        raw = s["a"][p][p]
        d = F.when(raw > SINGULAR * first[p][p], raw).otherwise(F.lit(float("nan")))

        def cell(x: Column, i: Column, j: Column) -> Column:
            at_row, at_column = i == p, j == p
            inner = F.when(at_column, -x / d).otherwise(x - s["a"][i][p] * s["a"][p][j] / d)
            return F.when(at_row & at_column, 1 / d).when(at_row, x / d).otherwise(inner)

        a = F.transform(s["a"], lambda row, i: F.transform(row, lambda x, j: cell(x, i, j)))
        return F.struct(a.alias("a"), F.concat(s["rss"], F.array(a[last][last])).alias("rss"))

    start = F.struct(first.alias("a"), F.array().cast("array<double>").alias("rss"))
    return F.aggregate(F.sequence(F.lit(0), F.col("_k") - 2), start, pivot)


def _usable(rss: Column, regressors: Column) -> Column:
    total = F.col("_a")[F.col("_k") - 1][F.col("_k") - 1]
    return ~F.isnan(rss) & (rss > PERFECT * total) & (F.col("_m") > regressors)


def _best_lags(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and the lag order of the least information criterion, the smaller of equals."""
    swept = materialize(moments, "moments").withColumn("_rss", _swept()["rss"])
    each = swept.select(*keys, "_m", "_k", "_a", F.posexplode("_rss").alias("_at", "_r")).filter("_at > 0")  # at 0: the constant alone
    fits = each.filter(_usable(F.col("_r"), F.col("_at") + 1))
    score = F.col("_m") * F.log(F.col("_r") / F.col("_m")) + 2 * (F.col("_at") + 1)
    return fits.groupBy(*keys).agg(F.min(F.struct(score.alias("score"), (F.col("_at") - 1).alias("lags"))).alias("_best")).select(*keys, "_best.lags")


def _statistic(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and statistic: the level's coefficient over its standard error.

    Stored, moments and result: a condition on the p-value would else carry the sweep into each of its terms.
    """
    swept = materialize(moments, "moments").withColumn("_swept", _swept())
    regressors, last = F.col("_k") - 1, F.col("_k") - 1
    rss = F.element_at("_swept.rss", -1)
    good = swept.filter(_usable(rss, regressors))
    out = good.select(*keys, (F.col("_swept.a")[1][last] / F.sqrt(rss / (F.col("_m") - regressors) * F.col("_swept.a")[1][1])).alias("statistic"))
    return materialize(out, "statistics")


def unit_root(long: DataFrame, keys: Sequence[str], order: str, value: str, lags: int | None = None, min_n: int = fv.MIN_SERIES_SAMPLES) -> DataFrame:
    """keys, n, lags, statistic and p_value of each series with a known value.

    ``lags`` fixes the lag order; without it the information criterion chooses among orders up to
    ``most_lags(n)``, all judged over the same rows. Null values are passed over. Series of fewer than
    ``min_n`` values, flat ones, and those whose regression has no solution have null results. The order
    column is a DATE that does not repeat in a series. Runs one job for the series' sizes, two that store the
    moments and the statistics, and, to choose the order, one that stores the changes and two that store the
    moments of all orders and the orders chosen.
    """
    keys = list(keys)
    sizes = long.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if lags is None:
        largest = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
        reach = max(0, most_lags(largest))
        rows = materialize(_changes(long, keys, order, value, reach), "changes").filter(F.col("n") >= min_n)
        most = F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 2).cast("int")
        chosen = materialize(_best_lags(_moments(rows.filter(most >= 0), keys, most), keys), "lags")
        rows = rows.join(chosen, keys)
        tested = _statistic(_moments(rows, keys, F.col("lags")), keys).join(chosen, keys)
    else:
        rows = _changes(long, keys, order, value, lags).filter(F.col("n") >= min_n)
        tested = _statistic(_moments(rows, keys, F.lit(lags)), keys).withColumn("lags", F.lit(lags))
    out = sizes.join(tested, keys, "left")
    return out.select(*keys, "n", F.col("lags").cast("int").alias("lags"), "statistic", p_value(F.col("statistic")).alias("p_value"))


def adf_table(long: DataFrame, feature: str, order: str, value: str, min_n: int = fv.MIN_SERIES_SAMPLES) -> DataFrame:
    """(feature, n, lags, statistic, p_value) per series of a long table; see ``unit_root``."""
    return unit_root(long.select(F.col(feature).alias("feature"), order, value), ["feature"], order, value, None, min_n)


def adf_filter(
    df: DataFrame, cols: Sequence[str], order: str, alpha: float = fv.STATIONARITY_ALPHA, min_n: int = fv.MIN_SERIES_SAMPLES
) -> list[str]:
    """Columns that test stationary, or all of them if none does. Collects one name per such column."""
    long = df.unpivot([order], [F.col(f"`{c}`") for c in cols], "feature", "value")
    rows = adf_table(long, "feature", order, "value", min_n).filter(F.col("p_value") <= alpha).select("feature").collect()
    kept = {r["feature"] for r in rows}
    return [c for c in cols if c in kept] or list(cols)
