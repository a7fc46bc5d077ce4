"""Joins (J1-J13)."""

from pyspark.sql import functions as F

from panelweave.catalog.base import Tables, query, r, sql_with
from panelweave.catalog.standins import (
    ALLOCATED,
    COUNTRY,
    EXOGENOUS,
    EXOGENOUS_JOIN,
    OUTAGES,
    PANEL,
    RATES,
    RETAIL,
    WIDE_ASIA,
    WIDE_EU,
    best_price_names,
    country_prices,
    exogenous,
    outages,
    panel,
    regional_wide,
    retail,
    three_rates,
)
from panelweave.fixed_values import EXOGENOUS_COLUMNS
from panelweave.operators import joins, profile, windows
from panelweave.operators.pricing import monthly_with_source, product_price
from panelweave.operators.reshape import allocate_interval, prefix_best_prices
from panelweave.plans.silver import exchange_rates

EU = [f"{c} AS eu_{c}" for c in best_price_names().values()]
ASIA = [f"{c} AS asia_{c}" for c in best_price_names().values()]


@query(
    "j01_full_join_rates",
    sql_with(
        RATES,
        f"""SELECT observation_date, {r('DEXCHUS', 'DEXINUS', 'DEXUSEU')} FROM rate_rmb
        FULL JOIN rate_inr USING (observation_date) FULL JOIN rate_eur USING (observation_date)""",
    ),
)
def j01(t: Tables):
    return exchange_rates(*three_rates(t))


@query(
    "j02_full_join_regions",
    sql_with(
        [PANEL, WIDE_EU, WIDE_ASIA],
        f"SELECT date, {r(*[f'wide_eu.{e}' for e in EU], *[f'wide_asia.{a}' for a in ASIA])} FROM wide_eu FULL JOIN wide_asia USING (date)",
    ),
)
def j02(t: Tables):
    p = panel(t)
    eu, asia = regional_wide(t, "EUROPE", p), regional_wide(t, "ASIA", p)
    return joins.full_join_all([prefix_best_prices(eu, "date", "eu_"), prefix_best_prices(asia, "date", "asia_")], ["date"])


@query(
    "j03_wide_with_exogenous",
    sql_with([PANEL, WIDE_EU, *EXOGENOUS], f"SELECT date, {r(*best_price_names().values(), *EXOGENOUS_COLUMNS)} FROM wide_eu {EXOGENOUS_JOIN}"),
)
def j03(t: Tables):
    return joins.attach_monthly(regional_wide(t, "EUROPE"), exogenous(t))


@query(
    "j04_panel_with_exogenous",
    sql_with([PANEL, *EXOGENOUS], f"SELECT date, region, pc_type, {r('pc_price', *EXOGENOUS_COLUMNS)} FROM panel {EXOGENOUS_JOIN}"),
)
def j04(t: Tables):
    return joins.attach_monthly(panel(t), exogenous(t))


@query(
    "j05_rate_lookup",
    sql_with(
        [RATES[0]],
        f"SELECT o_orderkey, {r('DEXCHUS AS rate')} FROM orders LEFT JOIN rate_rmb ON CAST(o_orderdate AS DATE) = observation_date",
    ),
)
def j05(t: Tables):
    days = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    rates = three_rates(t)[0].select(F.col("observation_date").alias("date"), F.col("DEXCHUS").alias("rate"))
    return joins.lookup_rate(days, rates, "date", "rate").select("o_orderkey", "rate")


@query(
    "j06_compare_sources",
    sql_with(
        [
            OUTAGES,
            ALLOCATED,
            "a AS (SELECT date, loss FROM allocated WHERE status = 'F')",
            "b AS (SELECT CAST(date_trunc('month', start_d) AS DATE) AS date, sum(loss) AS loss FROM outages WHERE status = 'F' GROUP BY ALL)",
        ],
        f"""SELECT date, a.loss IS NOT NULL AS has_spread_data, b.loss IS NOT NULL AS has_booked_data,
        {r('coalesce(a.loss, 0) AS loss_spread', 'coalesce(b.loss, 0) AS loss_booked',
           'coalesce(b.loss, 0) - coalesce(a.loss, 0) AS difference', 'abs(coalesce(b.loss, 0) - coalesce(a.loss, 0)) AS abs_difference',
           '(CASE WHEN b.loss IS NULL THEN NULL ELSE (b.loss - coalesce(a.loss, 0)) / (abs(b.loss) + 1e-10) * 100 END) AS pct_difference')}
        FROM a FULL JOIN b USING (date)""",
    ),
)
def j06(t: Tables):
    src = outages(t).filter(F.col("status") == "F")
    spread = allocate_interval(src, "start", "end", "loss").withColumnRenamed("allocated", "loss")
    booked = src.groupBy(F.trunc("start", "MM").alias("date")).agg(F.sum("loss").alias("loss"))
    out = joins.compare_sources(spread, booked, ["date"], "loss", ("spread", "booked"))
    # a month only one source has is divided by the 1e-10 guard: shown as NULL in this report
    return out.withColumn("pct_difference", F.when(F.col("has_booked_data"), F.col("pct_difference")))


@query(
    "j07_min_and_max_rows",
    sql_with(
        [
            COUNTRY,
            """lo AS (SELECT date, country AS min_country, price AS min_price FROM country_prices
               QUALIFY row_number() OVER (PARTITION BY date ORDER BY price, country) = 1)""",
            """hi AS (SELECT date, country AS max_country, price AS max_price FROM country_prices
               QUALIFY row_number() OVER (PARTITION BY date ORDER BY price DESC, country) = 1)""",
        ],
        f"SELECT date, min_country, {r('min_price')}, max_country, {r('max_price')} FROM lo JOIN hi USING (date)",
    ),
)
def j07(t: Tables):
    return profile.extreme_rows(country_prices(t), ["date"], "country", "price")


@query(
    "j08_outer_join_forecasts",
    sql_with(
        [
            PANEL,
            "actual AS (SELECT date, pc_type, min(pc_price) AS actual FROM panel WHERE date < DATE '2001-01-01' GROUP BY ALL)",
            "client AS (SELECT date, pc_type, min(pc_price) AS client_forecast FROM panel WHERE date >= DATE '2000-10-01' GROUP BY ALL)",
            """own AS (SELECT date, pc_type, min(f) AS own_forecast FROM (
               SELECT date, pc_type, lag(pc_price, 3) OVER (PARTITION BY region, pc_type ORDER BY date) AS f FROM panel) z
               WHERE date >= DATE '2000-10-01' GROUP BY ALL)""",
        ],
        f"SELECT date, pc_type, {r('actual', 'client_forecast', 'own_forecast')} FROM actual FULL JOIN client USING (date, pc_type) FULL JOIN own USING (date, pc_type)",
    ),
)
def j08(t: Tables):
    src = windows.naive_forecast(panel(t), "pc_price", 3)
    cut, late = F.lit("2001-01-01").cast("date"), F.lit("2000-10-01").cast("date")
    keys = ["date", "pc_type"]
    actual = src.filter(F.col("date") < cut).groupBy(*keys).agg(F.min("pc_price").alias("actual"))
    client = src.filter(F.col("date") >= late).groupBy(*keys).agg(F.min("pc_price").alias("client_forecast"))
    own = src.filter(F.col("date") >= late).groupBy(*keys).agg(F.min("naive").alias("own_forecast"))
    return joins.full_join_all([actual, client, own], keys)


@query(
    "j09_product_with_categories",
    sql_with(
        [
            PANEL,
            RETAIL,
            "m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(coalesce(avgprice, least(site_1, site_2, site_3, site_4, site_5))) AS product_price FROM retail GROUP BY ALL)",
            "reg AS (SELECT date, pc_price AS regular_price FROM panel WHERE region = 'EUROPE' AND pc_type = 'STANDARD')",
            "grn AS (SELECT date, pc_price AS green_price FROM panel WHERE region = 'EUROPE' AND pc_type = 'ECONOMY')",
        ],
        f"SELECT date, {r('product_price', 'regular_price', 'green_price')} FROM m LEFT JOIN reg USING (date) LEFT JOIN grn USING (date)",
    ),
)
def j09(t: Tables):
    monthly = monthly_with_source(product_price(retail(t), "avgprice", [c for c in retail(t).columns if c.startswith("site_")]), "date")
    p = panel(t).filter(F.col("region") == "EUROPE")
    regular = p.filter(F.col("pc_type") == "STANDARD").select("date", F.col("pc_price").alias("regular_price"))
    green = p.filter(F.col("pc_type") == "ECONOMY").select("date", F.col("pc_price").alias("green_price"))
    return joins.attach_monthly(monthly.select("date", "product_price"), [regular, green])


@query(
    "j10_semi_join_test_dates",
    sql_with(
        [
            PANEL,
            "test AS (SELECT * FROM panel WHERE date >= DATE '2000-06-01' AND pc_price > 3500)",
        ],
        f"SELECT date, region, pc_type, {r('pc_price')} FROM panel p WHERE EXISTS (SELECT 1 FROM test q WHERE q.date = p.date AND q.region = p.region AND q.pc_type = p.pc_type)",
    ),
)
def j10(t: Tables):
    p = panel(t)
    test = p.filter((F.col("date") >= F.lit("2000-06-01").cast("date")) & (F.col("pc_price") > 3500))
    return p.join(test.select("date", "region", "pc_type"), ["date", "region", "pc_type"], "left_semi")


@query(
    "j11_reindex_on_date_union",
    sql_with(
        [*RATES, "d AS (SELECT observation_date FROM rate_inr UNION SELECT observation_date FROM rate_eur)"],
        f"SELECT observation_date, {r('DEXCHUS')} FROM d LEFT JOIN rate_rmb USING (observation_date)",
    ),
)
def j11(t: Tables):
    rmb, inr, eur = three_rates(t)
    return joins.on_date_spine([inr, eur], rmb, "observation_date")


@query(
    "j12_checked_join",
    "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def j12(t: Tables):
    left = t.orders.select("o_orderkey", F.col("o_custkey").alias("custkey"))
    right = t.customer.select(F.col("c_custkey").alias("custkey"), "c_name")
    return joins.join_checked(left, right, ["custkey"], "left", "m:1").select("o_orderkey", "c_name")


@query(
    "j13_align_predictions",
    sql_with(
        [PANEL, "pred AS (SELECT region, pc_type, CAST(date + INTERVAL 3 MONTH AS DATE) AS date, pc_price AS predicted FROM panel)"],
        f"SELECT region, pc_type, date, {r('predicted', 'pc_price AS actual')} FROM pred JOIN panel USING (region, pc_type, date)",
    ),
)
def j13(t: Tables):
    p = panel(t)
    pred = p.select("region", "pc_type", F.add_months("date", 3).alias("date"), F.col("pc_price").alias("predicted"))
    return pred.join(p.withColumnRenamed("pc_price", "actual"), ["region", "pc_type", "date"])


