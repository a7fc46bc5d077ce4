"""Window operators."""

from pyspark.sql import functions as F

from panelweave.catalog.base import Tables, query, r, sql_with
from panelweave.catalog.standins import (
    PANEL,
    RATES,
    SPARSE,
    WIDE_EU,
    best_price_names,
    panel,
    regional_wide,
    sparse_prices,
    three_rates,
)
from panelweave.operators import windows
from panelweave.operators.reshape import to_long

KEY = "date, region, pc_type"
W = "OVER (PARTITION BY region, pc_type ORDER BY date)"
WR = "OVER (PARTITION BY region, pc_type ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
SERIES_SQL = (
    "series AS (SELECT date, series, x FROM ("
    + " UNION ALL ".join(f"SELECT date, '{c}' AS series, {c} AS x FROM wide_eu" for c in best_price_names().values())
    + ") u)"
)
WS = "OVER (PARTITION BY series ORDER BY date)"
WSR = "OVER (PARTITION BY series ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def wide_series(t: Tables):
    """Unpivoted wide table: one series per price column, empty cells kept."""
    return to_long(regional_wide(t, "EUROPE"), ["date"], list(best_price_names().values()), "series", "x")


@query(
    "w01_grouped_lag",
    sql_with([PANEL], f"SELECT {KEY}, {r('pc_price', *[f'lag(pc_price, {k}) {W} AS pc_price_lag_{k}' for k in (1, 2, 3, 6, 9, 12)])} FROM panel"),
)
def w01(t):
    return windows.add_lags(panel(t), ["pc_price"], (1, 2, 3, 6, 9, 12))


@query(
    "w02_rolling_mean",
    sql_with([PANEL], f"SELECT {KEY}, {r(*[f'avg(pc_price) {WR.format(k - 1)} AS pc_price_rolling_mean_{k}' for k in (3, 6, 12)])} FROM panel"),
)
def w02(t):
    return windows.add_rolling(panel(t), ["pc_price"], (3, 6, 12), std="last", label="rolling").drop(
        "pc_price", "pc_price_rolling_std_12"
    )


@query(
    "w03_rolling_std_last",
    sql_with([PANEL], f"SELECT {KEY}, {r(f'stddev_samp(pc_price) {WR.format(11)} AS pc_price_rolling_std_12')} FROM panel"),
)
def w03(t):
    out = windows.add_rolling(panel(t), ["pc_price"], (3, 6, 12), std="last", label="rolling")
    return out.select("date", "region", "pc_type", *[c for c in out.columns if "_std_" in c])


@query(
    "w04_wide_lag",
    sql_with([PANEL, WIDE_EU], "SELECT date, " + r(*[f"lag({c}, {k}) OVER (ORDER BY date) AS {c}_lag_{k}" for c in best_price_names().values() for k in (1, 12)]) + " FROM wide_eu"),
)
def w04(t):
    names = list(best_price_names().values())
    lagged = windows.add_lags(wide_series(t), ["x"], (1, 12), keys=["series"])
    return (
        lagged.groupBy("date")
        .pivot("series", names)
        .agg(F.first("x_lag_1").alias("lag_1"), F.first("x_lag_12").alias("lag_12"))
    )


@query(
    "w05_wide_rolling",
    sql_with(
        [PANEL, WIDE_EU, SERIES_SQL],
        "SELECT date, series, "
        + r(*[f"{f}(x) {WSR.format(k - 1)} AS x_roll_{n}_{k}" for k in (3, 6, 12) for f, n in (("avg", "mean"), ("stddev_samp", "std"))])
        + " FROM series",
    ),
)
def w05(t):
    return windows.add_rolling(wide_series(t), ["x"], (3, 6, 12), keys=["series"]).drop("x")


EXPAND = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@query(
    "w06_expanding",
    sql_with(
        [PANEL, WIDE_EU, SERIES_SQL],
        "SELECT date, series, " + r(*[f"{f}(x) {WSR.format('UNBOUNDED')} AS x_expanding_{n}" for n, f in EXPAND.items()]) + " FROM series",
    ),
)
def w06(t):
    return windows.add_expanding(wide_series(t), ["x"], keys=["series"]).drop("x", "x_dist_from_max", "x_dist_from_min")


@query(
    "w07_distance_from_extremes",
    sql_with(
        [PANEL, WIDE_EU, SERIES_SQL],
        "SELECT date, series, "
        + r(f"max(x) {WSR.format('UNBOUNDED')} - x AS x_dist_from_max", f"x - min(x) {WSR.format('UNBOUNDED')} AS x_dist_from_min")
        + " FROM series",
    ),
)
def w07(t):
    return windows.add_expanding(wide_series(t), ["x"], keys=["series"]).select("date", "series", "x_dist_from_max", "x_dist_from_min")


@query(
    "w08_rate_of_change",
    sql_with([PANEL], f"SELECT {KEY}, {r(*[f'pc_price / nullif(lag(pc_price, {k}) {W}, 0) - 1 AS pc_price_roc_{k}' for k in (3, 6)])} FROM panel"),
)
def w08(t):
    return windows.add_roc(panel(t), ["pc_price"], (3, 6)).drop("pc_price")


@query(
    "w09_difference",
    sql_with([PANEL], f"SELECT {KEY}, {r(*[f'pc_price - lag(pc_price, {k}) {W} AS pc_price_diff_{k}' for k in (1, 12)])} FROM panel"),
)
def w09(t):
    return windows.add_diff(panel(t), ["pc_price"], (1, 12), log=False).drop("pc_price")


@query(
    "w10_log_difference",
    sql_with([PANEL], f"SELECT {KEY}, {r(*[f'ln(pc_price) - ln(lag(pc_price, {k}) {W}) AS pc_price_log_diff_{k}' for k in (1, 12)])} FROM panel"),
)
def w10(t):
    out = windows.add_diff(panel(t), ["pc_price"], (1, 12))
    return out.select("date", "region", "pc_type", "pc_price_log_diff_1", "pc_price_log_diff_12")


@query(
    "w11_momentum",
    sql_with(
        [
            PANEL,
            f"m AS (SELECT {KEY}, pc_price - lag(pc_price, 3) {W} AS m3, pc_price - lag(pc_price, 6) {W} AS m6 FROM panel)",
        ],
        f"SELECT {KEY}, {r('m3 AS price_momentum_3m', 'm6 AS price_momentum_6m', f'm3 - lag(m3, 1) {W} AS price_acceleration_3m')} FROM m",
    ),
)
def w11(t):
    return windows.add_momentum(panel(t)).drop("pc_price")


@query(
    "w12_cross_series",
    sql_with(
        [PANEL],
        f"""SELECT {KEY}, {r('avg(pc_price) OVER (PARTITION BY date, region) AS regional_avg_price',
        'stddev_samp(pc_price) OVER (PARTITION BY date, region) AS regional_price_volatility',
        'pc_price - avg(pc_price) OVER (PARTITION BY date, region) AS price_deviation_from_regional_avg')} FROM panel""",
    ),
)
def w12(t):
    return windows.add_cross_series(panel(t)).drop("pc_price")


@query(
    "w13_forward_target",
    sql_with(
        [PANEL],
        f"""SELECT {KEY}, split, {r('lead(pc_price, 3) OVER (PARTITION BY region, pc_type, split ORDER BY date) AS target')}
        FROM (SELECT *, CASE WHEN date < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS split FROM panel) s""",
    ),
)
def w13(t):
    split = F.when(F.col("date") < F.lit("2000-01-01").cast("date"), "train").otherwise("test")
    return windows.add_target(panel(t).withColumn("split", split), "pc_price", 3, ["region", "pc_type", "split"]).drop("pc_price")


@query(
    "w14_fill_both_ways",
    sql_with(
        [RATES[0]],
        f"""SELECT observation_date, {r('''coalesce(
          last_value(DEXCHUS IGNORE NULLS) OVER (ORDER BY observation_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          first_value(DEXCHUS IGNORE NULLS) OVER (ORDER BY observation_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled''')}
        FROM rate_rmb""",
    ),
)
def w14(t):
    rates = three_rates(t)[0].withColumn("_one", F.lit(0))
    return rates.select("observation_date", windows.fill_both("DEXCHUS", ["_one"], "observation_date").alias("filled"))


@query(
    "w15_record_gaps",
    """SELECT CAST(gap_days AS INTEGER) AS gap_days, count(*) AS records FROM (
      SELECT date_diff('day', lag(d) OVER (PARTITION BY o_custkey ORDER BY d), d) AS gap_days
      FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders) s) g
    WHERE gap_days IS NOT NULL GROUP BY ALL""",
)
def w15(t):
    return windows.gap_summary(windows.record_gaps(t.orders, ["o_custkey"], "o_orderdate"))


@query(
    "w16_running_total",
    """SELECT status, date, n, CAST(sum(n) OVER (PARTITION BY status ORDER BY date) AS BIGINT) AS cumulative FROM (
      SELECT o_orderstatus AS status, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n
      FROM orders GROUP BY ALL) m""",
)
def w16(t):
    monthly = t.orders.groupBy(F.col("o_orderstatus").alias("status"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("date")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return windows.running_total(monthly, "n", ["status"], "date", "cumulative")


@query(
    "w17_naive_forecasts",
    sql_with([PANEL], f"SELECT {KEY}, {r('pc_price', f'lag(pc_price, 3) {W} AS naive', f'lag(pc_price, 12) {W} AS seasonal_naive')} FROM panel"),
)
def w17(t):
    return windows.naive_forecast(panel(t), "pc_price", 3)


@query(
    "w18_monthly_interpolation",
    sql_with(
        [
            SPARSE,
            """spine AS (SELECT country, priority, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS date
               FROM (SELECT country, priority, min(date) AS a, max(date) AS b FROM sparse GROUP BY ALL) s)""",
            "full_s AS (SELECT country, priority, date, price FROM spine LEFT JOIN sparse USING (country, priority, date))",
            """ends AS (SELECT country, priority, date, price,
               last_value(CASE WHEN price IS NOT NULL THEN date END IGNORE NULLS) OVER p AS pd, last_value(price IGNORE NULLS) OVER p AS pv,
               first_value(CASE WHEN price IS NOT NULL THEN date END IGNORE NULLS) OVER n AS nd, first_value(price IGNORE NULLS) OVER n AS nv
               FROM full_s WINDOW p AS (PARTITION BY country, priority ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               n AS (PARTITION BY country, priority ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        ],
        f"""SELECT country, priority, date,
        {r("coalesce(price, pv + (nv - pv) * date_diff('day', pd, date) / nullif(date_diff('day', pd, nd), 0)) AS price")} FROM ends""",
    ),
)
def w18(t):
    return windows.monthly_interpolate(sparse_prices(t), ["country", "priority"], "date", "price")


@query(
    "w19_last_rows",
    sql_with(
        [PANEL],
        f"SELECT {KEY}, {r('pc_price')} FROM panel QUALIFY row_number() OVER (PARTITION BY region, pc_type ORDER BY date DESC) <= 6",
    ),
)
def w19(t):
    return windows.last_rows(panel(t), 6, ["region", "pc_type"], "date")
