"""Splits, weights, scores and baselines."""

from pyspark.sql import functions as F

from panelweave.catalog.base import Tables, query, r, sql_with
from panelweave.catalog.standins import PANEL, SPARSE, TYPES, WIDE_EU, best_price_names, panel, regional_wide, sparse_prices
from panelweave.operators import attribution, runs, scoring, splits, windows

KEY = "date, region, pc_type"
W = "OVER (PARTITION BY region, pc_type ORDER BY date)"


def _one_date(groups: str, source: str, train: int, test: int, having_all: str) -> str:
    """Brute force: every date against every group."""
    return f"""(SELECT max(d) FROM (SELECT d.date AS d FROM (SELECT DISTINCT date FROM {source}) d, (SELECT DISTINCT {groups} FROM {having_all}) g
      LEFT JOIN {source} s USING ({groups}) GROUP BY d.date, {groups}
      ) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {groups} FROM {having_all}) g
        WHERE (SELECT count(*) FROM {source} s WHERE {' AND '.join(f's.{c.strip()} = g.{c.strip()}' for c in groups.split(','))} AND s.date < x.d) < {train}
           OR (SELECT count(*) FROM {source} s WHERE {' AND '.join(f's.{c.strip()} = g.{c.strip()}' for c in groups.split(','))} AND s.date >= x.d) < {test}))"""


@query(
    "m01_adaptive_split",
    sql_with([PANEL], f"SELECT CAST(NULL AS DATE) AS validation_date, {_one_date('pc_type', 'panel', 100, 45, 'panel')} AS test_date, true AS adaptive"),
)
def m01(t: Tables):
    return splits.split_dates(panel(t), "date", ["pc_type"], TYPES, min_train=100, min_test=45)


@query(
    "m02_adaptive_three_way",
    sql_with(
        [
            PANEL,
            "c AS (SELECT pc_type, date, count(*) AS n FROM panel GROUP BY ALL)",
            "d AS (SELECT DISTINCT date FROM panel)",
            """ok AS (SELECT v.date AS v, t.date AS t FROM d v JOIN d t ON t.date > v.date JOIN c ON true GROUP BY v.date, t.date, pc_type
               HAVING sum(n) FILTER (WHERE c.date < v.date) >= 100 AND sum(n) FILTER (WHERE c.date >= v.date AND c.date < t.date) >= 33
                  AND sum(n) FILTER (WHERE c.date >= t.date) >= 27)""",
            "allok AS (SELECT v, t FROM ok GROUP BY v, t HAVING count(*) = (SELECT count(DISTINCT pc_type) FROM c))",
        ],
        "SELECT v AS validation_date, t AS test_date, true AS adaptive FROM allok ORDER BY v DESC, t DESC LIMIT 1",
    ),
)
def m02(t: Tables):
    return splits.split_dates(panel(t), "date", ["pc_type"], TYPES, min_train=100, min_test=27, min_validation=33)


@query(
    "m03_split_by_series",
    sql_with(
        [
            SPARSE,
            f"found AS (SELECT {_one_date('country, priority', 'sparse', 20, 5, 'sparse')} AS d)",
            "spare AS (SELECT ds[CAST(floor(len(ds) * 0.8) AS BIGINT) + 1] AS d FROM (SELECT list(DISTINCT date ORDER BY date) AS ds FROM sparse) q)",
        ],
        "SELECT CAST(NULL AS DATE) AS validation_date, coalesce(found.d, spare.d) AS test_date, found.d IS NOT NULL AS adaptive FROM found, spare",
    ),
)
def m03(t: Tables):
    return splits.split_dates(sparse_prices(t), "date", ["country", "priority"], None, 20, 5, fallback="first")


@query(
    "m04_chronological_split",
    sql_with(
        [PANEL],
        f"""SELECT {KEY}, CASE WHEN row_number() {W} <= n - greatest(1, CAST(floor(n * 0.2) AS BIGINT)) THEN 'train' ELSE 'test' END AS split
        FROM (SELECT *, count(*) OVER (PARTITION BY region, pc_type) AS n FROM panel) p""",
    ),
)
def m04(t: Tables):
    return splits.chrono_split(panel(t), "date", 0.2, ["region", "pc_type"]).drop("pc_price")


WEIGHTS = """w AS (SELECT date, region, pc_type, {raw} * CASE WHEN region = 'EUROPE' THEN 1.5 ELSE 1 END AS w FROM (
  SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY pc_type) AS ng, (SELECT count(DISTINCT pc_type) FROM panel) AS g FROM panel) z)"""
RAW = {"balanced": "n / (g * ng)", "inverse_frequency": "1.0 / ng", "sqrt_inverse": "1.0 / sqrt(ng)"}


def _weights(method: str) -> str:
    return sql_with([PANEL, WEIGHTS.format(raw=RAW[method])], f"SELECT {KEY}, {r('w * count(*) OVER () / sum(w) OVER () AS weight')} FROM w")


@query("m05_weights_balanced", _weights("balanced"))
def m05(t: Tables):
    return splits.sample_weights(panel(t), "pc_type", "region", "EUROPE").drop("pc_price")


@query("m05_weights_inverse", _weights("inverse_frequency"))
def m05_inverse(t: Tables):
    return splits.sample_weights(panel(t), "pc_type", "region", "EUROPE", "inverse_frequency").drop("pc_price")


@query("m05_weights_sqrt", _weights("sqrt_inverse"))
def m05_sqrt(t: Tables):
    return splits.sample_weights(panel(t), "pc_type", "region", "EUROPE", "sqrt_inverse").drop("pc_price")


NAMES = list(best_price_names().values())


def _both(c: str) -> str:
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )


@query(
    "m06_supervised_matrix",
    sql_with(
        [
            PANEL,
            WIDE_EU,
            "x AS (SELECT *, pc_economy_best_price / lag(pc_economy_best_price, 3) OVER (ORDER BY date) - 1 AS roc, lead(pc_economy_best_price, 3) OVER (ORDER BY date) AS target FROM wide_eu)",
            f"f AS (SELECT date, target, {', '.join(f'{_both(c)} AS {c}' for c in (*NAMES, 'roc'))} FROM x WHERE target IS NOT NULL)",
        ],
        f"SELECT date, {r('target', *NAMES, 'roc')} FROM f WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in (*NAMES, "roc")),
    ),
)
def m06(t: Tables):
    wide = regional_wide(t, "EUROPE").withColumn("_one", F.lit(0))
    roc = windows.add_roc(wide, ["pc_economy_best_price"], [3], keys=["_one"]).drop("_one")
    table = roc.withColumnRenamed("pc_economy_best_price_roc_3", "roc")
    return splits.supervised(table, "pc_economy_best_price", 3, [*NAMES, "roc"])


SCORED = f"s AS (SELECT *, lag(pc_price, 3) {W} AS yhat FROM panel)"
EPS = "2.220446049250313e-16"


def scored(t: Tables):
    return windows.naive_forecast(panel(t), "pc_price", 3)


@query(
    "m07_mape_floor",
    sql_with(
        [PANEL, SCORED],
        f"""SELECT pc_type, {r(f'avg(abs(pc_price - yhat) / greatest(abs(pc_price), {EPS})) AS mape',
        f"sum(CASE WHEN region = 'EUROPE' THEN 1.5 ELSE 1 END * abs(pc_price - yhat) / greatest(abs(pc_price), {EPS})) / sum(CASE WHEN yhat IS NULL THEN NULL WHEN region = 'EUROPE' THEN 1.5 ELSE 1 END) AS weighted_mape")},
        count(yhat) AS n FROM s GROUP BY pc_type""",
    ),
)
def m07(t: Tables):
    w = F.when(F.col("region") == "EUROPE", F.lit(1.5)).otherwise(F.lit(1.0))
    return scoring.mape(scored(t).withColumn("w", w), "pc_price", "naive", ["pc_type"], "w")


@query(
    "m08_mape_skip",
    f"""SELECT l_returnflag, {r('avg(abs((l_discount - l_tax) / nullif(l_discount, 0))) AS mape')}, count(nullif(l_discount, 0)) AS n FROM lineitem GROUP BY ALL""",
)
def m08(t: Tables):
    return scoring.mape(t.lineitem, "l_discount", "l_tax", ["l_returnflag"], zero="skip")


HORIZONS = """hs AS (SELECT h, region, pc_type, avg(abs(pc_price - yhat) / abs(pc_price)) AS mape, count(yhat) AS n FROM (
  SELECT 3 AS h, *, lag(pc_price, 3) OVER (PARTITION BY region, pc_type ORDER BY date) AS yhat FROM panel
  UNION ALL SELECT 6, *, lag(pc_price, 6) OVER (PARTITION BY region, pc_type ORDER BY date) FROM panel
  UNION ALL SELECT 9, *, lag(pc_price, 9) OVER (PARTITION BY region, pc_type ORDER BY date) FROM panel) u GROUP BY ALL)"""


def horizon_scores(t: Tables):
    """Naive score per series for each horizon."""
    p = panel(t)
    many = [
        scoring.mape(windows.naive_forecast(p, "pc_price", h), "pc_price", "naive", ["region", "pc_type"]).withColumn("horizon", F.lit(h))
        for h in (3, 6, 9)
    ]
    return many[0].unionByName(many[1]).unionByName(many[2])


@query(
    "m09_combined_scores",
    sql_with(
        [PANEL, HORIZONS],
        f"""SELECT CAST(h AS INTEGER) AS horizon, {r('avg(mape) AS global_mape', 'sum(n * mape) / sum(n) AS weighted_mape',
        "avg(CASE WHEN pc_type <> 'ECONOMY' THEN mape END) AS regular_mape", "avg(CASE WHEN pc_type = 'ECONOMY' THEN mape END) AS green_mape")} FROM hs GROUP BY h""",
    ),
)
def m09(t: Tables):
    kind = F.when(F.col("pc_type") == "ECONOMY", "green").otherwise("regular")
    return scoring.combine_scores(horizon_scores(t).withColumn("kind", kind), ["horizon"], "mape", "n", "kind")


SLOPES = [
    PANEL,
    f"l AS (SELECT *, {', '.join(f'lag(pc_price, {k}) {W} AS lag_{k}' for k in (1, 2, 3, 6, 9, 12))} FROM panel)",
    "coef AS (" + " UNION ALL ".join(f"SELECT 'pc_price_lag_{k}' AS feature, regr_slope(pc_price, lag_{k}) AS coef FROM l" for k in (1, 2, 3, 6, 9, 12)) + ")",
    "sh AS ("
    + " UNION ALL ".join(f"SELECT 'pc_price_lag_{k}' AS feature, avg(abs(lag_{k} - (SELECT avg(lag_{k}) FROM l))) AS d FROM l" for k in (1, 2, 3, 6, 9, 12))
    + ")",
]


@query(
    "m16_linear_attribution",
    sql_with(SLOPES, f"SELECT feature, {r('abs(coef) * d AS mean_abs')} FROM sh JOIN coef USING (feature) ORDER BY abs(coef) * d DESC, feature LIMIT 5"),
)
def m16(t: Tables):
    lagged = windows.add_lags(panel(t), ["pc_price"], (1, 2, 3, 6, 9, 12))
    cols = [c for c in lagged.columns if "_lag_" in c]
    one = lagged.agg(*[F.regr_slope("pc_price", c).alias(c) for c in cols])
    coefs = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("coef")) for c in cols])))
    return attribution.linear_attribution(lagged, lagged, coefs, cols)


CUT = "DATE '2000-06-01'"
M18 = [
    PANEL,
    f"tr AS (SELECT *, pc_price - lag(pc_price) {W} AS d FROM panel WHERE date < {CUT})",
    f"pr AS (SELECT *, lag(d) {W} AS p FROM tr)",
    """ft AS (SELECT region, pc_type, sum(d * p) / nullif(sum(p * p) FILTER (WHERE d IS NOT NULL), 0) AS phi,
      arg_max(pc_price, date) AS y, arg_max(d, date) AS ld, count(*) AS n FROM pr GROUP BY ALL)""",
    f"te AS (SELECT region, pc_type, date, pc_price, row_number() {W} AS step FROM panel WHERE date >= {CUT})",
    """fc AS (SELECT region, pc_type, step, pc_price, y + ld * phi * (1 - pow(phi, step)) / (1 - phi) AS f FROM te JOIN ft USING (region, pc_type) WHERE step <= 6)""",
]


@query(
    "m18_ar1_baseline",
    sql_with(
        M18,
        f"SELECT region, pc_type, {r('avg(abs((pc_price - f) / nullif(pc_price, 0))) AS mape')}, count(*) AS n_points, CAST(NULL AS VARCHAR) AS note FROM fc GROUP BY ALL",
    ),
)
def m18(t: Tables):
    train, test = splits.cutoff_split(panel(t), "date", "2000-06-01")
    return scoring.score_ar1(train, test, ["region", "pc_type"], "date", "pc_price", 6)


@query(
    "m18_ar1_forecast",
    sql_with(
        M18[:4],
        f"""SELECT region, pc_type, CAST(s AS INTEGER) AS step, {r('y + ld * phi * (1 - pow(phi, s)) / (1 - phi) AS forecast')}
        FROM ft, range(1, 7) q(s)""",
    ),
)
def m18_forecast(t: Tables):
    train, _ = splits.cutoff_split(panel(t), "date", "2000-06-01")
    return scoring.ar1_diff_forecast(train, ["region", "pc_type"], "date", "pc_price", 6)


@query(
    "m21_best_runs",
    sql_with(
        [PANEL, HORIZONS],
        f"SELECT region || '/' || pc_type AS run_name, {r('mape AS value')} FROM hs WHERE h = 6 ORDER BY mape, run_name LIMIT 3",
    ),
)
def m21(t: Tables):
    table = horizon_scores(t).select(
        F.concat_ws("/", "region", "pc_type").alias("run_name"),
        F.create_map(F.lit("horizon"), F.col("horizon").cast("string")).alias("tags"),
        F.create_map(F.lit("mape"), F.col("mape")).alias("metrics"),
    )
    return runs.best_runs(table, {"horizon": "6"}, "mape", 3).select("run_name", "value")


@query(
    "m22_merged_weights",
    sql_with(
        [
            PANEL,
            "p2 AS (SELECT * FROM panel WHERE date < DATE '2000-01-01')",
            WEIGHTS.format(raw=RAW["balanced"]).replace("FROM panel", "FROM p2"),
        ],
        f"SELECT {KEY}, {r('w * count(*) OVER () / sum(w) OVER () AS weight')} FROM w",
    ),
)
def m22(t: Tables):
    p = panel(t)
    day = lambda s: F.lit(s).cast("date")
    train = p.filter(F.col("date") < day("1999-01-01"))
    validation = p.filter((F.col("date") >= day("1999-01-01")) & (F.col("date") < day("2000-01-01")))
    return splits.sample_weights(train.unionByName(validation), "pc_type", "region", "EUROPE").drop("pc_price")
