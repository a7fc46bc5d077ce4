"""Whole flows: raw to silver, silver to gold."""

import re

from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.catalog.base import Tables, query, r, sql_with
from panelweave.catalog.scans import staged_cells
from panelweave.catalog.standins import (
    ALLOCATED,
    COUNTRY,
    EXOGENOUS,
    EXOGENOUS_JOIN,
    OUTAGES,
    PANEL,
    QUARTERS,
    RATES,
    WIDE_ASIA,
    WIDE_EU,
    best_price_names,
    country_prices,
    exogenous,
    outages,
    panel,
    regional_wide,
    three_rates,
)
from panelweave.operators.joins import attach_monthly
from panelweave.operators.splits import cutoff_split
from panelweave.plans import gold, silver
from panelweave.session import materialize

CUTOFF = "2001-01-01"
X = fv.EXOGENOUS_COLUMNS


# --- raw to silver --------------------------------------------------------
def supplier_grid(t: Tables, names, scale):
    """Day by supplier-column table of text cells; the customer key spreads orders over the columns."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")
    slot = F.pmod(F.col("o_custkey"), F.lit(len(names)))
    cells = t.orders.withColumn("_s", slot).groupBy(day).pivot("_s", list(range(len(names)))).agg(F.avg("o_totalprice"))
    return cells.select("date", *[(F.col(f"`{i}`") * F.lit(scale[n])).cast("string").alias(n) for i, n in enumerate(names)])


def grid_sql(name: str, n: int, scale) -> str:
    cols = ",\n".join(f"  avg(o_totalprice) FILTER (WHERE o_custkey % {n} = {i}) * {scale[i]!r} AS c{i}" for i in range(n))
    return f"{name} AS (SELECT CAST(o_orderdate AS DATE) AS date,\n{cols}\n  FROM orders GROUP BY CAST(o_orderdate AS DATE))"


EU_NAMES = [c for cols in fv.EU_TYPE_COLUMNS.values() for c in cols]
EU_SCALE = [1e-5] * len(EU_NAMES)
EU_SLOT = {c: f"c{i}" for i, c in enumerate(EU_NAMES)}


def _least(cols) -> str:
    return cols[0] if len(cols) == 1 else f"least({', '.join(cols)})"


def europe_sql(grouped: bool) -> str:
    groups = silver.type_groups(fv.EUROPE, grouped)
    best = [f"{_least([EU_SLOT[c] for c in cols])} AS {name}" for name, cols in groups.items()]
    return sql_with([grid_sql("eu", len(EU_NAMES), EU_SCALE)], f"SELECT date, {r(*best)} FROM eu")


def europe_raw(t: Tables):
    return supplier_grid(t, EU_NAMES, dict(zip(EU_NAMES, EU_SCALE, strict=True))).withColumn("pc pie", F.lit(None).cast("string"))


@query("silver_europe_grouped", europe_sql(True))
def silver_europe_grouped(t: Tables):
    return silver.europe_prices(europe_raw(t), True)


@query("silver_europe_base", europe_sql(False))
def silver_europe_base(t: Tables):
    return silver.europe_prices(europe_raw(t), False)


ASIA_NAMES = list(fv.ASIA_COLUMN_UNITS)
UNIT_SCALE = {fv.RMB_T: 0.1, fv.RMB_KG: 1e-4, fv.USD_KG: 1e-5, fv.USD_T: 1e-2, fv.INR_KG: 1e-3}
ASIA_SCALE = [UNIT_SCALE[u] for u in fv.ASIA_COLUMN_UNITS.values()]


def standard_name(col: str) -> str | None:
    """Plain statement of the naming rule, for the SQL side."""
    maker = re.search(r"asia_supplier_\d", col)
    kind = re.search(r" pc (gp recycled|gf10fr|gf recycled|si recycled|gp|gf|fr|nat|si)(?= |\(|$)", col)
    if maker and kind:
        return f"{maker.group()} pc {kind.group(1)} (usd/kg)"
    if col.startswith("pc si recycled"):
        return "pc si recycled (usd/kg)"
    return "pc si (usd/kg)" if col.startswith("pc si") else None


def _usd_sql(i: int, unit: str) -> str:
    c = f"c{i}"
    return {
        fv.RMB_T: f"CASE WHEN {c} < 100 THEN {c} * 1000 ELSE {c} END / nullif(rmb, 0) / 1000",
        fv.RMB_KG: f"CASE WHEN {c} > 100 THEN {c} / 1000 ELSE {c} END / nullif(rmb, 0)",
        fv.USD_T: f"CASE WHEN {c} < 10 THEN {c} * 1000 ELSE {c} END / 1000",
        fv.USD_KG: f"CASE WHEN {c} > 1000 THEN {c} / 1000 ELSE {c} END",
        fv.INR_KG: f"{c} / nullif(inr, 0)",
    }[unit]


def _fill(expr: str) -> str:
    return (
        f"coalesce(last_value({expr} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({expr} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )


def asia_sql(grouped: bool) -> str:
    usd = {c: f"({_usd_sql(i, u)})" for i, (c, u) in enumerate(fv.ASIA_COLUMN_UNITS.items())}
    best = []
    for name, wanted in silver.type_groups(fv.ASIA, grouped).items():
        parts = [usd[c] for c in ASIA_NAMES if standard_name(c) in wanted]
        best.append(f"{_least(parts)} / nullif(eur, 0) + 0.3 AS {name}")
    return sql_with(
        [
            grid_sql("raw", len(ASIA_NAMES), ASIA_SCALE),
            *RATES,
            """j AS (SELECT raw.*, coalesce(CASE WHEN day(date) % 2 = 0 THEN 7.25 END, DEXCHUS) AS o_rmb, DEXINUS AS o_inr, DEXUSEU AS o_eur
               FROM raw LEFT JOIN rate_rmb a ON a.observation_date = date LEFT JOIN rate_inr b ON b.observation_date = date
               LEFT JOIN rate_eur c ON c.observation_date = date)""",
            f"f AS (SELECT *, {_fill('o_rmb')} AS rmb, {_fill('o_inr')} AS inr, {_fill('o_eur')} AS eur FROM j)",
        ],
        f"SELECT date, {r(*best)} FROM f",
    )


def asia_silver(t: Tables, grouped: bool):
    raw = supplier_grid(t, ASIA_NAMES, dict(zip(ASIA_NAMES, ASIA_SCALE, strict=True)))
    day = F.dayofmonth(F.col("date").cast("date"))
    own = F.when(day % 2 == 0, "7.25").when(day % 3 == 0, "0")
    rates = silver.exchange_rates(*three_rates(t))
    return silver.asia_prices(raw.withColumn(fv.ASIA_RATE_RMB, own), rates, grouped)


@query("silver_asia_grouped", asia_sql(True))
def silver_asia_grouped(t: Tables):
    return asia_silver(t, True)


@query("silver_asia_base", asia_sql(False))
def silver_asia_base(t: Tables):
    return asia_silver(t, False)


@query(
    "silver_electricity",
    sql_with(
        [COUNTRY],
        f"""SELECT date, {r(*[f'{f}(price) AS {n}_price_eur_mwhe' for n, f in (('min', 'min'), ('max', 'max'), ('avg', 'avg'), ('median', 'median'), ('std', 'stddev_samp'))])}
        FROM country_prices WHERE country <> 'NATION_3' GROUP BY date""",
    ),
)
def silver_electricity(t: Tables):
    price = F.when(F.col("country") == "NATION_3", "n.a.").otherwise(F.col("price").cast("string"))
    raw = country_prices(t).select(
        "country", F.col("iso3").alias("iso3 code"), F.date_format("date", "yyyy-MM-dd").alias("date"), price.alias("price (eur/mwhe)")
    )
    return silver.electricity_statistics(raw)


@query(
    "silver_registrations",
    f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, {r('count(*) AS new_passenger_car_registration')} FROM orders GROUP BY date_trunc('month', o_orderdate)",
)
def silver_registrations(t: Tables):
    month_end = F.date_format(F.last_day(F.col("o_orderdate").cast("date")), "yyyy-MM-dd").alias("date")
    raw = t.orders.groupBy(month_end).agg(F.count(F.lit(1)).cast("string").alias(fv.REGISTRATION_RAW))
    return silver.registrations(raw)


@query(
    "silver_shutdowns",
    sql_with(
        [OUTAGES, ALLOCATED],
        f"""SELECT date, {r("max(CASE WHEN status = 'F' THEN loss END) AS acetone_capacity_loss_kt", "max(CASE WHEN status = 'O' THEN loss END) AS phenol_capacity_loss_kt")}
        FROM allocated WHERE status <> 'P' GROUP BY date""",
    ),
)
def silver_shutdowns(t: Tables):
    raw = outages(t).select(
        "status",
        F.date_format("start", "yyyy-MM-dd").alias(fv.OUTAGE_START),
        F.date_format("end", "yyyy-MM-dd").alias(fv.OUTAGE_END),
        F.col("loss").alias(fv.OUTAGE_LOSS),
    )
    return silver.shutdown_losses(raw.filter(F.col("status") == "F"), raw.filter(F.col("status") == "O"))


@query(
    "silver_commodities",
    sql_with(
        [QUARTERS],
        f"""SELECT CAST(make_date(CAST(y AS INTEGER), CAST((q - 1) * 3 + 1 + k AS INTEGER), 1) AS DATE) AS date,
        {r('crude AS crude_oil_brent_eur_bbl', 'benzene AS benzene_eur_metric_ton')} FROM quarters, (VALUES (0), (1), (2)) v(k)""",
    ),
)
def silver_commodities(t: Tables):
    return silver.commodities(staged_cells(t))


# --- silver to gold -------------------------------------------------------
def _w(part: str, back: str | int | None = None) -> str:
    frame = "" if back is None else f" ROWS BETWEEN {back} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY {part} ORDER BY date{frame})"


CALENDAR = [
    "sin(2 * pi() * month(date) / 12) AS month_sin",
    "cos(2 * pi() * month(date) / 12) AS month_cos",
    "sin(2 * pi() * quarter(date) / 4) AS quarter_sin",
    "cos(2 * pi() * quarter(date) / 4) AS quarter_cos",
    "date_diff('day', min(date) OVER (), date) / 30.44 AS time_idx",
]
CALENDAR_INT = ", ".join(f"CAST({p}(date) AS INTEGER) AS {p}" for p in ("month", "quarter", "year"))


def long_sql(h: int) -> str:
    s = "region, pc_type"
    lags, windows = fv.HORIZON_LAGS[h], fv.HORIZON_WINDOWS[h]
    cols = [
        "pc_price",
        *X,
        *CALENDAR,
        *[f"lag(pc_price, {k}) {_w(s)} AS pc_price_lag_{k}" for k in lags],
        *[f"avg(pc_price) {_w(s, k - 1)} AS pc_price_rolling_mean_{k}" for k in windows],
        f"stddev_samp(pc_price) {_w(s, windows[-1] - 1)} AS pc_price_rolling_std_{windows[-1]}",
        "avg(pc_price) OVER (PARTITION BY date, region) AS regional_avg_price",
        "stddev_samp(pc_price) OVER (PARTITION BY date, region) AS regional_price_volatility",
        "pc_price - avg(pc_price) OVER (PARTITION BY date, region) AS price_deviation_from_regional_avg",
        *[f"lag({x}, {k}) {_w(s)} AS {x}_lag_{k}" for x in X for k in lags[:3]],
    ]
    flags = ", ".join(
        f"CAST(contains(pc_type, '{w}') AS INTEGER) AS {n}"
        for n, w in (("is_recycled", "recycled"), ("is_glass_filled", "gf"), ("is_flame_retardant", "fr"))
    )
    return sql_with(
        [PANEL, *EXOGENOUS, f"base AS (SELECT * FROM panel {EXOGENOUS_JOIN} WHERE date < DATE '{CUTOFF}')"],
        f"SELECT date, region, pc_type, {CALENDAR_INT}, {flags}, {r(*cols)} FROM base",
    )


def long_flow(t: Tables, h: int):
    # the panel is the boundary between raw and gold data: stored once, small from here on
    base = attach_monthly(materialize(panel(t), "panel"), exogenous(t))
    return gold.long_features(cutoff_split(base, "date", CUTOFF)[0], h)


TARGETS = [f"{p}{c}" for p in ("eu_", "asia_") for c in best_price_names().values()]


def wide_sql(h: int) -> str:
    lags, windows = fv.HORIZON_LAGS[h], fv.HORIZON_WINDOWS[h]
    cols = [*TARGETS, *X, *CALENDAR]
    for c in TARGETS:
        run = _w("1", "UNBOUNDED")
        cols += [f"lag({c}, {k}) {_w('1')} AS {c}_x_lag_{k}" for k in lags]
        cols += [f"{f}({c}) {_w('1', k - 1)} AS {c}_x_roll_{n}_{k}" for k in windows for n, f in (("mean", "avg"), ("std", "stddev_samp"))]
        cols += [f"{f}({c}) {run} AS {c}_x_expanding_{n}" for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
        cols += [f"max({c}) {run} - {c} AS {c}_x_dist_from_max", f"{c} - min({c}) {run} AS {c}_x_dist_from_min"]
        cols += [f"{c} / nullif(lag({c}, {k}) {_w('1')}, 0) - 1 AS {c}_x_roc_{k}" for k in fv.HORIZON_ROC[h]]
        cols += [f"{c} - lag({c}, {k}) {_w('1')} AS {c}_x_diff_{k}" for k in fv.DIFF_PERIODS]
        cols += [f"ln({c}) - ln(lag({c}, {k}) {_w('1')}) AS {c}_x_log_diff_{k}" for k in fv.DIFF_PERIODS]
    for c in X:
        cols += [f"lag({c}, {k}) {_w('1')} AS {c}_x_lag_{k}" for k in lags[:2]]
        cols += [f"{f}({c}) {_w('1', k - 1)} AS {c}_x_roll_{n}_{k}" for k in windows for n, f in (("mean", "avg"), ("std", "stddev_samp"))]
    named = [c.replace("_x_", "_") if " AS " in c else c for c in cols]
    pair = ", ".join(
        f"{side}.{c} AS {p}{c}" for p, side in (("eu_", "wide_eu"), ("asia_", "wide_asia")) for c in best_price_names().values()
    )
    return sql_with(
        [
            PANEL,
            WIDE_EU,
            WIDE_ASIA,
            *EXOGENOUS,
            f"two AS (SELECT date, {pair} FROM wide_eu FULL JOIN wide_asia USING (date))",
            f"base AS (SELECT * FROM two {EXOGENOUS_JOIN} WHERE date < DATE '{CUTOFF}')",
        ],
        f"SELECT date, {CALENDAR_INT}, {r(*named)} FROM base",
    )


def wide_flow(t: Tables, h: int):
    stored = materialize(panel(t), "panel")
    prices = {fv.EUROPE: regional_wide(t, "EUROPE", stored), fv.ASIA: regional_wide(t, "ASIA", stored)}
    return gold.wide_table(prices, exogenous(t), h, TARGETS, CUTOFF)[0]


@query("gold_long_h3", long_sql(3))
def gold_long_h3(t: Tables):
    return long_flow(t, 3)


@query("gold_long_h6", long_sql(6))
def gold_long_h6(t: Tables):
    return long_flow(t, 6)


@query("gold_long_h9", long_sql(9))
def gold_long_h9(t: Tables):
    return long_flow(t, 9)


@query("gold_wide_h3", wide_sql(3))
def gold_wide_h3(t: Tables):
    return wide_flow(t, 3)


@query("gold_wide_h6", wide_sql(6))
def gold_wide_h6(t: Tables):
    return wide_flow(t, 6)


@query("gold_wide_h9", wide_sql(9))
def gold_wide_h9(t: Tables):
    return wide_flow(t, 9)
