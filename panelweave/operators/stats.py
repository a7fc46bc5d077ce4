"""Correlation and time-series statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.functions.columns import clamp_unit, pearson, ratio
from panelweave.operators.checks import require_date
from panelweave.operators.ranks import rank_cuts, with_average_ranks
from panelweave.operators.series import series
from panelweave.operators.windows import series_window
from panelweave.session import materialize

PAIR_BATCH = 200


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def pearson_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, r, n) for the named column pairs, each over rows where both are known.

    A batch of pairs is one map-side-combined aggregation: the shuffle carries
    a few numbers per pair and task, never rows.
    """
    parts = []
    for at in range(0, len(pairs), PAIR_BATCH):
        batch = pairs[at : at + PAIR_BATCH]
        aggs = []
        for i, (a, b) in enumerate(batch):
            both = _quoted(a).isNotNull() & _quoted(b).isNotNull()
            aggs += [pearson(_quoted(a), _quoted(b)).alias(f"_r{i}"), F.count_if(both).alias(f"_n{i}")]
        cells = [
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_r{i}").alias("r"), F.col(f"_n{i}").alias("n"))
            for i, (a, b) in enumerate(batch)
        ]
        one = df.groupBy(*keys).agg(*aggs)
        parts.append(one.select(*keys, F.inline(F.array(*cells))))
    out = reduce(lambda x, y: x.unionByName(y), parts)
    return out.withColumn("r", clamp_unit(F.col("r")))


def spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rank correlation per column pair, ranks taken over the rows both columns have.

    Rows are first folded to distinct value pairs with a count, so ties shrink
    the data before any shuffle. The folded pairs are stored (runs jobs), then
    each column is ranked once, by ranges of values, and ranks stay with their rows.
    Up to there a pair of columns is its number, not its names, and the cut points
    of both columns come from one pass over the folded pairs.
    """
    cells = [F.struct(F.lit(i).alias("pair"), _quoted(a).cast("double").alias("x"), _quoted(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)]
    one = df.select(F.inline(F.array(*cells))) if len(cells) > 1 else df.select(cells[0].alias("c")).select("c.*")
    points = materialize(one.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")), "pairs")
    cuts = rank_cuts(points, ["pair"], ["x", "y"])
    ranked = with_average_ranks(points, ["pair"], "x", "w", "y", "rx", cuts=cuts)
    ranked = with_average_ranks(ranked, ["pair"], "y", "w", "x", "ry", cuts=cuts)
    size = points.groupBy("pair").agg(F.sum("w").alias("n"))  # a row for each pair of columns
    mid = (F.col("n") + 1) / F.lit(2.0)
    dx, dy, w = F.col("rx") - mid, F.col("ry") - mid, F.col("w")
    sums = ranked.join(F.broadcast(size), "pair").groupBy("pair").agg(
        F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"), F.max("n").alias("n")
    )
    r = ratio(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return sums.withColumn("_names", F.get(names, F.col("pair"))).select("_names.a", "_names.b", clamp_unit(r).alias("r"), "n")


def corr_pairs(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Upper triangle of a correlation matrix in long form."""
    pairs = list(combinations(cols, 2))
    if method == "pearson":
        return pearson_pairs(df, pairs)
    if method == "spearman":
        return spearman_pairs(df, pairs)
    raise ValueError(f"unknown method: {method}")


def lagged_corr(
    df: DataFrame, target: str, drivers: Sequence[str], lags: Sequence[int], order: str, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, driver, lag, r): a negative lag pairs the target with earlier driver values.

    All shifts are columns of one window and all correlations one aggregation,
    so there is no self-join. ``order`` is a DATE that does not repeat within the keys; without keys the
    table is one series, cut into blocks of rows.
    """
    s = series(df, keys, order, max(0, *(-k for k in lags)), max(0, *lags))
    shifts = [F.lag(d, -k).over(s.window).alias(f"{d}@{k}") for d in drivers for k in lags]
    moved = s.own(s.rows.select("*", *shifts)).select(*keys, target, *[f"{d}@{k}" for d in drivers for k in lags])
    out = pearson_pairs(moved, [(target, f"{d}@{k}") for d in drivers for k in lags], keys)
    parts = F.split("b", "@")
    return out.select(*keys, parts[0].alias("driver"), parts[1].cast("int").alias("lag"), "r")


def best_lag(corr: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lag with the strongest correlation per driver; NULLs never win, ties go to the smaller lag."""
    top = F.max(F.struct(F.abs("r").alias("m"), (-F.col("lag")).alias("l"), F.col("r").alias("r"))).alias("t")
    out = corr.filter(F.col("r").isNotNull()).groupBy(*keys, "driver").agg(top)
    return out.select(*keys, "driver", (-F.col("t.l")).alias("best_lag"), F.col("t.r").alias("r"))


def change_corr(df: DataFrame, a: str, b: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of one-row percent changes of two columns (C5); ``order`` as in ``lagged_corr``."""
    s = series(df, keys, order, before=1)
    pct = {f"_pct_{c}": ratio(F.col(c), F.lag(c, 1).over(s.window)) - 1 for c in (a, b)}
    moved = s.own(s.rows.select("*", *[v.alias(c) for c, v in pct.items()])).select(*keys, *[F.col(f"_pct_{c}").alias(c) for c in (a, b)])
    return pearson_pairs(moved, [(a, b)], keys)


def linear_trend(df: DataFrame, keys: Sequence[str], order: str, col: str) -> DataFrame:
    """Least-squares line of each series on its row index, starting at 0."""
    t = F.row_number().over(series_window(keys, order)) - 1
    src = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).alias("_y"), t.cast("double").alias("_t"))
    return src.groupBy(*keys).agg(
        F.regr_slope("_y", "_t").alias("slope"),
        F.regr_intercept("_y", "_t").alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )


def acf(df: DataFrame, keys: Sequence[str], order: str, col: str, n_lags: int) -> DataFrame:
    """(keys, lag, acf, band): autocorrelation with divisor n, and the white-noise 95% band."""
    require_date(df, order)
    w = series_window(keys, order)
    known = df.filter(F.col(col).isNotNull())
    dev = known.select(*keys, order, (F.col(col) - F.avg(col).over(W.partitionBy(*keys))).alias("_x"))
    moved = dev.select(*keys, "_x", *[F.lag("_x", k).over(w).alias(f"_x{k}") for k in range(1, n_lags + 1)])
    sums = moved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("_x") * F.col("_x")).alias("_s0"),
        *[F.sum(F.col("_x") * F.col(f"_x{k}")).alias(f"_s{k}") for k in range(1, n_lags + 1)],
    )
    cells = [F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("s")) for k in range(n_lags + 1)]
    long = sums.select(*keys, "_n", "_s0", F.inline(F.array(*cells)))
    return long.select(
        *keys, "lag", ratio(F.col("s"), F.col("_s0")).alias("acf"), (F.lit(1.959963984540054) / F.sqrt("_n")).alias("band")
    ).filter(F.col("acf").isNotNull())


def pacf(acf_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial autocorrelations from :func:`acf` rows, by the Levinson-Durbin recursion over each series' lags.

    The recursion is one array expression; a lag whose denominator is zero gives NULL from there on.
    """
    packed = acf_rows.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("rho")
    )
    rho = F.col("rho")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    product = lambda xs, ys: total(F.zip_with(xs, ys, lambda x, y: x * y))

    def step(done, k):
        phi = done["phi"]
        head = F.slice(rho, F.lit(2), k - 1)
        last = ratio(F.element_at(rho, k + 1) - product(phi, F.reverse(head)), F.lit(1.0) - product(phi, head))
        carried = F.zip_with(phi, F.reverse(phi), lambda p, q: p - last * q)
        return F.struct(F.concat(carried, F.array(last)).alias("phi"), F.concat(done["pacf"], F.array(last)).alias("pacf"))

    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array(F.lit(1.0)).alias("pacf"))
    lags = F.when(F.size(rho) > 1, F.sequence(F.lit(1), F.size(rho) - 1)).otherwise(F.array().cast("array<int>"))
    return packed.select(*keys, F.posexplode(F.aggregate(lags, start, step, lambda done: done["pacf"])).alias("lag", "pacf"))


def decompose_additive(df: DataFrame, keys: Sequence[str], date: str, col: str, period: int = 12) -> DataFrame:
    """Trend, seasonal and residual parts of each series, ends extrapolated by a straight line."""
    require_date(df, date)
    w, group = series_window(keys, date), W.partitionBy(*keys)
    half = period // 2
    y, t = F.col(col), F.col("_t")
    src = df.select(
        *keys,
        date,
        col,
        F.row_number().over(w).alias("_t"),
        F.count(F.lit(1)).over(group).alias("_n"),
        (
            (
                F.sum(col).over(w.rowsBetween(-(half - 1), half - 1))
                + F.lit(0.5) * (F.lag(col, half).over(w) + F.lead(col, half).over(w))
            )
            / period
        ).alias("_mid"),
    )
    head = F.when(t <= half + period, F.col("_mid"))
    tail = F.when(t > F.col("_n") - half - period, F.col("_mid"))
    lines = src.select(
        "*",
        *[
            f(part, t.cast("double")).over(group).alias(name)
            for part, name_a, name_b in ((head, "_ha", "_hb"), (tail, "_ta", "_tb"))
            for f, name in ((F.regr_slope, name_a), (F.regr_intercept, name_b))
        ],
    )
    trend = F.coalesce(
        F.col("_mid"),
        F.when(t <= half, F.col("_ha") * t + F.col("_hb")).otherwise(F.col("_ta") * t + F.col("_tb")),
    )
    flat = lines.select(*keys, date, col, trend.alias("trend"), ((t - 1) % period).alias("_pos"))
    at = W.partitionBy(*keys, "_pos")
    raw = flat.select(
        "*",
        F.avg(y - F.col("trend")).over(at).alias("_season"),
        F.count(F.lit(1)).over(at).alias("_k"),
    )
    centre = F.sum(F.col("_season") / F.col("_k")).over(group) / period
    seasonal = raw.withColumn("seasonal", F.col("_season") - centre)
    return seasonal.select(*keys, date, col, "trend", "seasonal", (y - F.col("trend") - F.col("seasonal")).alias("resid"))


def column_variances(df: DataFrame, cols: Sequence[str], threshold: float = fv.VARIANCE_THRESHOLD) -> DataFrame:
    """(column_name, variance, kept) from one aggregation."""
    one = df.agg(*[F.var_samp(_quoted(c)).alias(c) for c in cols])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), _quoted(c).alias("variance")) for c in cols])))
    return long.withColumn("kept", F.coalesce(F.col("variance") > threshold, F.lit(False)))


def variance_filter(df: DataFrame, cols: Sequence[str], threshold: float = fv.VARIANCE_THRESHOLD) -> list[str]:
    """Columns varying more than the threshold, or all of them if none does. Runs one job."""
    one = df.agg(*[F.var_samp(_quoted(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    kept = [c for c, v in zip(cols, one, strict=True) if v is not None and v > threshold]
    return kept or list(cols)
