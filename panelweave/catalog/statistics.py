"""Correlation and time-series statistics."""

from itertools import combinations

from pyspark.sql import functions as F

from panelweave.catalog.base import Tables, query, r, sql_with
from panelweave.catalog.standins import (
    ALLOCATED,
    COUNTRY,
    OUTAGES,
    PANEL,
    WIDE_EU,
    best_price_names,
    country_prices,
    outages,
    panel,
    regional_wide,
)
from panelweave.operators import stats, unit_root, windows
from panelweave.operators.reshape import allocate_interval, to_wide
from panelweave.plans.gold import wide_features

NAMES = list(best_price_names().values())
PAIRS = list(combinations(NAMES, 2))


@query(
    "c01_pearson",
    sql_with(
        [PANEL, WIDE_EU],
        " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b}) AS r')}, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM wide_eu" for a, b in PAIRS),
    ),
)
def c01(t: Tables):
    return stats.corr_pairs(regional_wide(t, "EUROPE"), NAMES)


@query(
    "c02_spearman",
    sql_with(
        [
            PANEL,
            WIDE_EU,
            "pts AS ("
            + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM wide_eu WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS)
            + ")",
            """rk AS (SELECT a, b,
              rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM pts)""",
        ],
        f"SELECT a, b, {r('corr(rx, ry) AS r')}, count(*) AS n FROM rk GROUP BY a, b",
    ),
)
def c02(t: Tables):
    return stats.corr_pairs(regional_wide(t, "EUROPE"), NAMES, "spearman")


@query(
    "c02_spearman_lines",
    f"""WITH rk AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
      rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
    SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, {r('corr(rx, ry) AS r')}, count(*) AS n FROM rk""",
)
def c02_lines(t: Tables):
    return stats.corr_pairs(t.lineitem, ["l_quantity", "l_extendedprice"], "spearman")


W = "OVER (PARTITION BY region, pc_type ORDER BY date)"


@query(
    "c03_lag_corr_by_type",
    sql_with(
        [PANEL, f"l AS (SELECT pc_type, pc_price, {', '.join(f'lag(pc_price, {k}) {W} AS lag_{k}' for k in (1, 2, 3, 6, 9, 12))} FROM panel)"],
        " UNION ALL ".join(f"SELECT pc_type, 'pc_price_lag_{k}' AS b, {r(f'corr(pc_price, lag_{k}) AS r')}, count(lag_{k}) AS n FROM l GROUP BY pc_type" for k in (1, 2, 3, 6, 9, 12)),
    ),
)
def c03(t: Tables):
    lagged = windows.add_lags(panel(t), ["pc_price"], (1, 2, 3, 6, 9, 12))
    pairs = [("pc_price", c) for c in lagged.columns if "pc_price_lag" in c]
    return stats.pearson_pairs(lagged, pairs, ["pc_type"]).drop("a")


LAGS = range(-6, 7)


def _lag_sql() -> list[str]:
    rows = " UNION ALL ".join(
        f"SELECT region, '{d}' AS driver, {k} AS lag, corr(standard, {d}_{k + 6}) AS r FROM moved GROUP BY region" for d in ("economy", "large") for k in LAGS
    )
    cols = ", ".join(
        f"{'lag' if k <= 0 else 'lead'}({d}, {abs(k)}) OVER (PARTITION BY region ORDER BY date) AS {d}_{k + 6}" for d in ("economy", "large") for k in LAGS
    )
    return [
        PANEL,
        """w3 AS (SELECT region, date, max(CASE WHEN pc_type = 'STANDARD' THEN pc_price END) AS standard,
           max(CASE WHEN pc_type = 'ECONOMY' THEN pc_price END) AS economy, max(CASE WHEN pc_type = 'LARGE' THEN pc_price END) AS large
           FROM panel GROUP BY ALL)""",
        f"moved AS (SELECT region, standard, {cols} FROM w3)",
        f"lc AS ({rows})",
    ]


def by_region(t: Tables):
    names = {"STANDARD": "standard", "ECONOMY": "economy", "LARGE": "large"}
    return to_wide(panel(t), ["region", "date"], "pc_type", "pc_price", names)


@query("c04_lagged_corr", sql_with(_lag_sql(), f"SELECT region, driver, CAST(lag AS INTEGER) AS lag, {r('r')} FROM lc"))
def c04(t: Tables):
    return stats.lagged_corr(by_region(t), "standard", ["economy", "large"], LAGS, "date", ["region"])


@query(
    "c04_best_lag",
    sql_with(_lag_sql(), f"SELECT region, driver, CAST(lag AS INTEGER) AS best_lag, {r('r')} FROM lc WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY region, driver ORDER BY abs(r) DESC, lag) = 1"),
)
def c04_best(t: Tables):
    return stats.best_lag(stats.lagged_corr(by_region(t), "standard", ["economy", "large"], LAGS, "date", ["region"]), ["region"])


@query(
    "c05_change_corr",
    sql_with(
        [*_lag_sql()[:2], "ch AS (SELECT region, standard / lag(standard) OVER (PARTITION BY region ORDER BY date) - 1 AS a, economy / lag(economy) OVER (PARTITION BY region ORDER BY date) - 1 AS b FROM w3)"],
        f"SELECT region, 'standard' AS a, 'economy' AS b, {r('corr(a, b) AS r')}, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n FROM ch GROUP BY region".replace("corr(a, b)", "corr(ch.a, ch.b)").replace("WHERE a IS NOT NULL AND b", "WHERE ch.a IS NOT NULL AND ch.b"),
    ),
)
def c05(t: Tables):
    return stats.change_corr(by_region(t), "standard", "economy", "date", ["region"])


@query(
    "c06_source_corr",
    sql_with(
        [OUTAGES, ALLOCATED],
        f"""SELECT 'x' AS a, 'y' AS b, {r('corr(f.loss, o.loss) AS r')}, count(*) AS n
        FROM allocated f JOIN allocated o USING (date) WHERE f.status = 'F' AND o.status = 'O'""",
    ),
)
def c06(t: Tables):
    lost = allocate_interval(outages(t), "start", "end", "loss", ["status"])
    a = lost.filter(F.col("status") == "F").select("date", F.col("allocated").alias("x"))
    b = lost.filter(F.col("status") == "O").select("date", F.col("allocated").alias("y"))
    return stats.pearson_pairs(a.join(b, "date"), [("x", "y")])


@query(
    "c07_linear_trend",
    sql_with(
        [PANEL, f"i AS (SELECT region, pc_type, pc_price, row_number() {W} - 1 AS t FROM panel)"],
        f"SELECT region, pc_type, {r('regr_slope(pc_price, t) AS slope', 'regr_intercept(pc_price, t) AS intercept')}, count(*) AS n FROM i GROUP BY ALL",
    ),
)
def c07(t: Tables):
    return stats.linear_trend(panel(t), ["region", "pc_type"], "date", "pc_price")


ACF = [
    COUNTRY,
    "x AS (SELECT country, row_number() OVER (PARTITION BY country ORDER BY date) AS t, price - avg(price) OVER (PARTITION BY country) AS x FROM country_prices)",
    "s AS (SELECT country, count(*) AS n, sum(x * x) AS s0 FROM x GROUP BY country)",
    "l AS (SELECT a.country, k.k AS lag, sum(a.x * b.x) AS s FROM x a CROSS JOIN range(0, 25) k(k) JOIN x b ON a.country = b.country AND b.t = a.t - k.k GROUP BY ALL)",
]


@query(
    "c08_autocorrelation",
    sql_with(
        ACF,
        f"SELECT country, CAST(lag AS INTEGER) AS lag, {r('s / s0 AS acf', '1.959963984540054 / sqrt(n) AS band')} FROM l JOIN s USING (country)",
    ),
)
def c08(t: Tables):
    return stats.acf(country_prices(t), ["country"], "date", "price", 24)


@query(
    "c09_partial_autocorrelation",
    sql_with(
        [
            *ACF,
            "rho AS (SELECT country, list(s / s0 ORDER BY lag) AS rho FROM l JOIN s USING (country) GROUP BY country)",
            """d AS (SELECT country, rho, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS last FROM rho
  UNION ALL
  SELECT country, rho, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - v * phi[k + 1 - i]), v), v
  FROM (SELECT country, rho, k, phi, (rho[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * rho[k + 2 - i])), 0))
      / nullif(1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * rho[i + 1])), 0), 0) AS v
    FROM d WHERE k + 1 < len(rho)) z)""",
        ],
        f"SELECT country, CAST(k AS INTEGER) AS lag, {r('last AS pacf')} FROM d",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def c09(t: Tables):
    return stats.pacf(stats.acf(country_prices(t), ["country"], "date", "price", 24), ["country"])


C10 = [
    PANEL,
    f"""m AS (SELECT region, pc_type, date, pc_price AS y, row_number() {W} AS t, count(*) OVER (PARTITION BY region, pc_type) AS n,
       (sum(pc_price) OVER (PARTITION BY region, pc_type ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
        + 0.5 * (lag(pc_price, 6) {W} + lead(pc_price, 6) {W})) / 12 AS mid FROM panel)""",
    """e AS (SELECT region, pc_type,
       regr_slope(mid, t) FILTER (WHERE t <= 18) AS ha, regr_intercept(mid, t) FILTER (WHERE t <= 18) AS hb,
       regr_slope(mid, t) FILTER (WHERE t > n - 18) AS ta, regr_intercept(mid, t) FILTER (WHERE t > n - 18) AS tb FROM m GROUP BY ALL)""",
    "d AS (SELECT region, pc_type, date, y, t, coalesce(mid, CASE WHEN t <= 6 THEN ha * t + hb ELSE ta * t + tb END) AS trend FROM m JOIN e USING (region, pc_type))",
    "p AS (SELECT region, pc_type, (t - 1) % 12 AS pos, avg(y - trend) AS a FROM d GROUP BY ALL)",
    "c AS (SELECT region, pc_type, sum(a) / 12 AS c FROM p GROUP BY ALL)",
]


@query(
    "c10_decomposition",
    sql_with(
        C10,
        f"""SELECT region, pc_type, date, {r('y AS pc_price', 'trend', 'a - c AS seasonal', 'y - trend - (a - c) AS resid')}
        FROM d JOIN p ON d.region = p.region AND d.pc_type = p.pc_type AND p.pos = (d.t - 1) % 12
        JOIN c ON c.region = d.region AND c.pc_type = d.pc_type""".replace("SELECT region, pc_type,", "SELECT d.region AS region, d.pc_type AS pc_type,"),
    ),
)
def c10(t: Tables):
    return stats.decompose_additive(panel(t), ["region", "pc_type"], "date", "pc_price")


def feature_table(t: Tables):
    """Wide features of the European prices, as the variance and unit-root filters see them."""
    return wide_features(regional_wide(t, "EUROPE"), 3, NAMES, ())


@query(
    "c11_variance_filter",
    sql_with(
        [PANEL, WIDE_EU, "v AS (SELECT *, 1.0 AS flat FROM wide_eu)"],
        " UNION ALL ".join(f"SELECT '{c}' AS column_name, {r(f'var_samp({c}) / 1e6 AS variance')}, coalesce(var_samp({c}) > 1e-4, false) AS kept FROM v" for c in (*NAMES, "flat")),
    ),
)
def c11(t: Tables):
    wide = regional_wide(t, "EUROPE").withColumn("flat", F.lit(1.0))
    return stats.column_variances(wide, [*NAMES, "flat"]).withColumn("variance", F.col("variance") / 1e6)


FIXED_LAGS = 1
C12 = [
    PANEL,
    f"o AS (SELECT region, pc_type, date, pc_price - lag(pc_price) {W} AS z, lag(pc_price) {W} AS y FROM panel)",
    f"""x AS (SELECT region, pc_type, z, y, lag(z) {W} AS d FROM o)""",
    """s AS (SELECT region, pc_type, count(*) AS m, var_pop(y) * count(*) AS yy, var_pop(d) * count(*) AS dd, var_pop(z) * count(*) AS zz,
       covar_pop(y, d) * count(*) AS yd, covar_pop(y, z) * count(*) AS yz, covar_pop(d, z) * count(*) AS dz
       FROM x WHERE d IS NOT NULL GROUP BY ALL)""",
    "b AS (SELECT *, yy * dd - yd * yd AS det, (yz * dd - dz * yd) / (yy * dd - yd * yd) AS c_y, (dz * yy - yz * yd) / (yy * dd - yd * yd) AS c_d FROM s)",
]


@query(
    "c12_unit_root_fixed_lag",
    sql_with(
        C12,
        f"""SELECT region, pc_type, m + 2 AS n, {FIXED_LAGS} AS lags,
        {r('c_y / sqrt((zz - c_y * yz - c_d * dz) / (m - 3) * dd / det) AS statistic')} FROM b""",
    ),
)
def c12_fixed(t: Tables):
    return unit_root.unit_root(panel(t), ["region", "pc_type"], "date", "pc_price", FIXED_LAGS).drop("p_value")


@query("c12_unit_root_tests")
def c12(t: Tables):
    feats = feature_table(t)
    cols = [c for c in feats.columns if c != "date"]
    long = feats.unpivot(["date"], [F.col(c).cast("double") for c in cols], "feature", "value")
    return unit_root.adf_table(long, "feature", "date", "value")
