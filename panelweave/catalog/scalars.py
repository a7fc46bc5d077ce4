"""Scalar functions."""

from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.catalog.base import Tables, query, r, sql_with
from panelweave.catalog.standins import (
    ALLOCATED,
    OUTAGES,
    PANEL,
    RATES,
    RETAIL,
    SITES,
    UNIT_PRICES,
    outages,
    panel,
    retail,
    three_rates,
    unit_prices,
)
from panelweave.functions.calendar import add_calendar, month_start
from panelweave.functions.columns import finite, row_min, strength_label, type_flags
from panelweave.functions.units import converted_name, repair_unit, supplier_of, to_eur_kg, to_usd_kg, type_of
from panelweave.operators import pricing
from panelweave.operators.joins import compare_sources, date_dimension
from panelweave.operators.reshape import allocate_interval
from panelweave.operators.splits import encode_labels
from panelweave.operators.stats import pearson_pairs
from panelweave.operators.windows import fill_both


@query(
    "f01_calendar_parts",
    "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders",
)
def f01(t: Tables):
    out = add_calendar(t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date")))
    return out.select("o_orderkey", "month", "quarter", "year")


@query(
    "f02_cyclic_calendar",
    f"""SELECT o_orderkey, {r('sin(2 * pi() * month(o_orderdate) / 12) AS month_sin', 'cos(2 * pi() * month(o_orderdate) / 12) AS month_cos',
    'sin(2 * pi() * quarter(o_orderdate) / 4) AS quarter_sin', 'cos(2 * pi() * quarter(o_orderdate) / 4) AS quarter_cos')} FROM orders""",
)
def f02(t: Tables):
    out = add_calendar(t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date")))
    return out.select("o_orderkey", "month_sin", "month_cos", "quarter_sin", "quarter_cos")


@query(
    "f03_time_index",
    f"SELECT o_orderkey, {r('''date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), CAST(o_orderdate AS DATE)) / 30.44 AS time_idx''')} FROM orders",
)
def f03(t: Tables):
    return add_calendar(t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))).select("o_orderkey", "time_idx")


@query("f04_month_start", "SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS month FROM events")
def f04(t: Tables):
    return t.events.select("event_id", month_start(F.col("ts")).alias("month"))


REPAIRED = """repaired AS (SELECT date, supplier, unit, CASE
   WHEN unit = 'rmb/t' AND price < 100 THEN price * 1000
   WHEN unit = 'rmb/kg' AND price > 100 THEN price / 1000
   WHEN unit = 'usd/kg' AND price > 1000 THEN price / 1000 ELSE price END AS price FROM unit_prices)"""
USD = """usd AS (SELECT date, supplier, CASE unit WHEN 'usd/kg' THEN price WHEN 'rmb/kg' THEN price / 7.1
   WHEN 'rmb/t' THEN price / 7.1 / 1000 END AS price FROM repaired)"""


@query("f05_unit_repair", sql_with([UNIT_PRICES, REPAIRED], f"SELECT date, supplier, unit, {r('price')} FROM repaired"))
def f05(t: Tables):
    return unit_prices(t).withColumn("price", repair_unit(F.col("price"), F.col("unit")))


def usd_prices(t: Tables):
    fixed = repair_unit(F.col("price"), F.col("unit"))
    usd = to_usd_kg(fixed, F.col("unit"), F.lit(7.1), F.lit(83.0))
    return unit_prices(t).select("date", "supplier", usd.alias("price"))


@query("f06_to_usd", sql_with([UNIT_PRICES, REPAIRED, USD], f"SELECT date, supplier, {r('price')} FROM usd"))
def f06(t: Tables):
    return usd_prices(t)


@query("f07_merge_by_minimum", sql_with([UNIT_PRICES, REPAIRED, USD], f"SELECT date, supplier, {r('min(price) AS price')} FROM usd GROUP BY ALL"))
def f07(t: Tables):
    return usd_prices(t).groupBy("date", "supplier").agg(F.min("price").alias("price"))


FILLED = """filled AS (SELECT observation_date AS date, coalesce(
    last_value(DEXUSEU IGNORE NULLS) OVER (ORDER BY observation_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(DEXUSEU IGNORE NULLS) OVER (ORDER BY observation_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM rate_eur)"""


@query(
    "f08_landed_eur_price",
    sql_with(
        [UNIT_PRICES, REPAIRED, USD, *RATES, FILLED],
        f"SELECT date, supplier, {r('min(price) / nullif(rate, 0) + 0.3 AS price_eur')} FROM usd JOIN filled USING (date) GROUP BY date, supplier, rate",
    ),
)
def f08(t: Tables):
    best = usd_prices(t).groupBy("date", "supplier").agg(F.min("price").alias("price"))
    rates = three_rates(t)[2].withColumn("_one", F.lit(0))
    filled = rates.select(F.col("observation_date").alias("date"), fill_both("DEXUSEU", ["_one"], "observation_date").alias("rate"))
    return best.join(date_dimension(filled, "date"), "date").select("date", "supplier", to_eur_kg(F.col("price"), F.col("rate")).alias("price_eur"))


# column names met in price files, attached to the order priorities
LABELS = {
    "1-URGENT": "asia_supplier_7 pc gf fr",
    "2-HIGH": "pc si (inr/kg)",
    "3-MEDIUM": "asia_supplier_4  (usd/kg)",
    "4-NOT SPECIFIED": "asia_supplier_2 pc gp recycled (rmb/t)",
    "5-LOW": "asia_supplier_5 pc si recycled (rmb/kg)",
}
PARSED = {
    "1-URGENT": ("asia_supplier_7", "gf", "asia_supplier_7 pc gf (usd/kg)"),
    "2-HIGH": (None, None, "pc si (usd/kg)"),
    "3-MEDIUM": ("asia_supplier_4", None, None),
    "4-NOT SPECIFIED": ("asia_supplier_2", "gp recycled", "asia_supplier_2 pc gp recycled (usd/kg)"),
    "5-LOW": ("asia_supplier_5", "si recycled", "asia_supplier_5 pc si recycled (usd/kg)"),
}


def _case(i: int) -> str:
    return "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {repr(v[i]) if v[i] else 'NULL'}" for k, v in PARSED.items()) + " END"


def named_orders(t: Tables):
    name = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", name.alias("name"))


@query("f09_supplier_and_type", f"SELECT o_orderkey, {_case(0)} AS supplier, {_case(1)} AS pc_type FROM orders")
def f09(t: Tables):
    return named_orders(t).select("o_orderkey", supplier_of(F.col("name")).alias("supplier"), type_of(F.col("name")).alias("pc_type"))


@query("f10_fallback_names", f"SELECT o_orderkey, {_case(2)} AS name FROM orders WHERE o_orderpriority <> '3-MEDIUM'")
def f10(t: Tables):
    return named_orders(t).select("o_orderkey", converted_name(F.col("name")).alias("name")).filter(F.col("name").isNotNull())


@query(
    "f11_type_flags",
    "SELECT o_orderkey, " + ", ".join(
        f"CAST(contains(CASE o_orderpriority {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in LABELS.items())} END, '{s}') AS INTEGER) AS {n}"
        for n, s in (("is_recycled", "recycled"), ("is_glass_filled", "gf"), ("is_flame_retardant", "fr"))
    ) + " FROM orders",
)
def f11(t: Tables):
    return named_orders(t).select("o_orderkey", *[c.alias(n) for n, c in type_flags(F.col("name")).items()])


@query("f12_infinity_to_null", f"SELECT l_orderkey, l_linenumber, {r('CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS x')} FROM lineitem")
def f12(t: Tables):
    bad = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_tax", "l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", finite(bad).alias("x"))


@query("f13_replace_null_or_zero", f"SELECT l_orderkey, l_linenumber, {r('coalesce(nullif(l_discount, 0), l_tax) AS rate')} FROM lineitem")
def f13(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(F.nullif("l_discount", F.lit(0.0)), F.col("l_tax")).alias("rate"))


@query(
    "f14_product_price",
    sql_with([RETAIL], f"SELECT date, {r('coalesce(avgprice, least(' + ', '.join(SITES) + ')) AS product_price')}, CASE WHEN avgprice IS NOT NULL THEN 'average' ELSE 'min_website' END AS price_source FROM retail"),
)
def f14(t: Tables):
    return pricing.product_price(retail(t), "avgprice", SITES).select("date", "product_price", "price_source")


@query("f15_newer_over_older", sql_with([RETAIL], f"SELECT date, {r('coalesce(avgprice, site_1) AS price')} FROM retail"))
def f15(t: Tables):
    return retail(t).select("date", F.coalesce("avgprice", "site_1").alias("price"))


@query(
    "f16_difference_report",
    sql_with(
        [
            OUTAGES,
            ALLOCATED,
            "a AS (SELECT date, loss FROM allocated WHERE status = 'F')",
            "b AS (SELECT date, -loss AS loss FROM allocated WHERE status = 'O')",
        ],
        f"""SELECT date, a.loss IS NOT NULL AS has_f_data, b.loss IS NOT NULL AS has_o_data,
        {r('coalesce(a.loss, 0) AS loss_f', 'coalesce(b.loss, 0) AS loss_o', 'coalesce(b.loss, 0) - coalesce(a.loss, 0) AS difference',
           'abs(coalesce(b.loss, 0) - coalesce(a.loss, 0)) AS abs_difference',
           '(coalesce(b.loss, 0) - coalesce(a.loss, 0)) / (abs(coalesce(b.loss, 0)) + 1e-10) * 100 AS pct_difference')}
        FROM a FULL JOIN b USING (date)""",
    ),
)
def f16(t: Tables):
    lost = allocate_interval(outages(t), "start", "end", "loss", ["status"])
    a = lost.filter(F.col("status") == "F").select("date", F.col("allocated").alias("loss"))
    b = lost.filter(F.col("status") == "O").select("date", (-F.col("allocated")).alias("loss"))
    return compare_sources(a, b, ["date"], "loss", ("f", "o"))


@query(
    "f17_label_codes",
    sql_with([PANEL], "SELECT date, region, pc_type, CAST(dense_rank() OVER (ORDER BY region) - 1 AS INTEGER) AS region_encoded, CAST(dense_rank() OVER (ORDER BY pc_type) - 1 AS INTEGER) AS pc_type_encoded FROM panel"),
)
def f17(t: Tables):
    return encode_labels(panel(t), ["region", "pc_type"]).select("date", "region", "pc_type", "region_encoded", "pc_type_encoded")


BOTH = [
    PANEL,
    "p2 AS (SELECT s.date, s.pc_price / 1000 AS regular, g.pc_price / 1000 AS green FROM panel s JOIN panel g USING (date) WHERE s.region = 'EUROPE' AND g.region = 'EUROPE' AND s.pc_type = 'STANDARD' AND g.pc_type = 'ECONOMY')",
]
COST_SQL = [
    f"(1.8 + ({k} - 2.15) * {fv.SENSITIVITY[k]}) * {1 + m} AS price_{k}_{n}" for k in ("regular", "green") for n, m in fv.MARKUP.items()
]


def two_categories(t: Tables):
    p = panel(t).filter(F.col("region") == "EUROPE")
    a = p.filter(F.col("pc_type") == "STANDARD").select("date", (F.col("pc_price") / 1000).alias("regular"))
    b = p.filter(F.col("pc_type") == "ECONOMY").select("date", (F.col("pc_price") / 1000).alias("green"))
    return a.join(b, "date")


@query("f18_cost_plus", sql_with(BOTH, f"SELECT date, {r('regular', 'green', *COST_SQL)} FROM p2"))
def f18(t: Tables):
    return pricing.cost_plus(two_categories(t), {"regular": "regular", "green": "green"})


@query(
    "f19_strength_label",
    sql_with(
        BOTH,
        "SELECT CASE WHEN c > 0.7 THEN 'Strong positive correlation' WHEN c > 0.4 THEN 'Moderate positive correlation' WHEN c > 0 THEN 'Weak positive correlation' ELSE 'Negative or no clear correlation' END AS strength FROM (SELECT corr(regular, green) AS c FROM p2) x",
    ),
)
def f19(t: Tables):
    return pearson_pairs(two_categories(t), [("regular", "green")]).select(strength_label(F.col("r")).alias("strength"))


SCEN = ("price_green_base", "price_green_premium")


@query(
    "f20_scenario_summary",
    sql_with(
        [
            *BOTH,
            f"c AS (SELECT date, {', '.join(COST_SQL)} FROM p2)",
            RETAIL,
            f"d AS (SELECT date, coalesce(avgprice, least({', '.join(SITES)})) AS p, avgprice IS NOT NULL OR month(date) % 4 <> 0 AS own FROM retail)",
            "m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(p) AS p, bool_and(own) AS own FROM d GROUP BY ALL)",
            "h AS (SELECT avg(p) AS h FROM (SELECT p FROM m WHERE own ORDER BY date DESC LIMIT 6) z)",
        ],
        " UNION ALL ".join(f"SELECT '{s}' AS scenario, {r(f'avg({s}) AS mean', f'min({s}) AS low', f'max({s}) AS high', f'avg({s}) / max(h) AS ratio_to_recent')} FROM c, h" for s in SCEN),
    ),
)
def f20(t: Tables):
    costs = pricing.cost_plus(two_categories(t), {"regular": "regular", "green": "green"})
    # Averages are known on all days but in one month of four.
    known = retail(t).withColumn("avgprice", F.coalesce("avgprice", F.when(F.month("date") % 4 != 0, row_min(SITES))))
    history = pricing.monthly_with_source(pricing.product_price(known, "avgprice", SITES), "date")
    return pricing.scenario_summary(costs, history, "date", "product_price", SCEN)


@query("f21_material_cost", sql_with(BOTH, f"SELECT date, {r('0.07686 * 0.449 AS material_kg', '0.07686 * 0.449 * green AS material_cost')} FROM p2"))
def f21(t: Tables):
    return pricing.material_cost(two_categories(t), "green").select("date", "material_kg", "material_cost")
