"""Projections, filters, casts."""

from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.catalog.base import Tables, query, r, sql_with
from panelweave.catalog.standins import COUNTRY, PANEL, RETAIL, SITES, WIDE_EU, best_price_names, country_prices, panel, regional_wide, retail
from panelweave.functions.columns import parse_date, parse_date_or_null, parse_month_label, parse_number
from panelweave.operators.reshape import best_prices, prefix_best_prices
from panelweave.operators.splits import cutoff_split, non_empty_columns, numeric_columns


@query("p01_select_reorder", sql_with([PANEL], f"SELECT pc_type, region, date, {r('pc_price')} FROM panel"))
def p01(t: Tables):
    return panel(t).select("pc_type", "region", "date", "pc_price")


@query("p02_rename", sql_with([COUNTRY], f"SELECT country AS land, iso3 AS iso3_code, date, {r('price AS price_eur_mwhe')} FROM country_prices"))
def p02(t: Tables):
    return country_prices(t).withColumnsRenamed({"country": "land", "iso3": "iso3_code", "price": "price_eur_mwhe"})


@query("p03_drop_if_present", f"SELECT o_orderkey, {r('o_totalprice')} FROM orders")
def p03(t: Tables):
    return t.orders.drop("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "unnamed: 11")


@query("p04_drop_empty_columns", f"SELECT c_custkey, {r('c_acctbal')} FROM customer")
def p04(t: Tables):
    raw = t.customer.select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") < 0, F.col("c_name")).alias("empty"))
    return raw.select(*non_empty_columns(raw, raw.columns))


@query("p05_drop_percent_columns", f"SELECT l_orderkey, l_linenumber, {r('l_quantity')} FROM lineitem")
def p05(t: Tables):
    raw = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_discount").alias("discount %"), F.col("l_tax").alias("tax %"))
    return raw.drop(*[c for c in raw.columns if c.endswith("%")])


@query(
    "p06_keep_list",
    sql_with([RETAIL], f"SELECT date, {r('avgprice', 'least(site_1, site_2) AS best_low', 'site_5 AS best_single')} FROM retail"),
)
def p06(t: Tables):
    keep = [c for c in retail(t).columns if c in ("date", "avgprice")]
    return best_prices(retail(t), {"best_low": SITES[:2], "best_single": SITES[4:]}, keep)


@query(
    "p07_prefix_best_prices",
    sql_with([PANEL, WIDE_EU], "SELECT date, " + r(*[f"{c} AS eu_{c}" for c in best_price_names().values()]) + " FROM wide_eu"),
)
def p07(t: Tables):
    wide = regional_wide(t, "EUROPE").withColumn("spread", F.lit(1.0))
    return prefix_best_prices(wide, "date", "eu_")


@query("p08_strict_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def p08(t: Tables):
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"))
    return text.select("o_orderkey", parse_date(F.col("s")).alias("d"))


@query(
    "p09_lenient_date",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS d FROM orders",
)
def p09(t: Tables):
    bad = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", parse_date_or_null(bad).alias("d"))


@query("p10_month_label", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders")
def p10(t: Tables):
    return t.orders.select("o_orderkey", parse_month_label(F.date_format("o_orderdate", "MMM yyyy")).alias("d"))


@query("p11_lenient_number", f"SELECT o_orderkey, {r('''CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x''')} FROM orders")
def p11(t: Tables):
    text = F.when(F.col("o_orderstatus") == "P", "-").otherwise(F.col("o_totalprice").cast("string"))
    return t.orders.select("o_orderkey", parse_number(text).alias("x"))


@query("p12_drop_null_rows", sql_with([RETAIL], f"SELECT date, {r('avgprice', 'site_1')} FROM retail WHERE avgprice IS NOT NULL AND site_1 IS NOT NULL"))
def p12(t: Tables):
    return retail(t).select("date", "avgprice", "site_1").dropna(subset=["avgprice", "site_1"])


@query("p13_required_row", "SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY'")
def p13(t: Tables):
    found = t.part.filter(F.col("p_type") == "ECONOMY").select("p_partkey", "p_name")
    if found.isEmpty():
        raise ValueError("ECONOMY not found in p_type")
    return found


@query(
    "p14_outside_interval",
    sql_with([COUNTRY], f"SELECT country, date, {r('price')} FROM country_prices WHERE NOT (date >= DATE '1998-07-01' AND date <= DATE '2000-05-01')"),
)
def p14(t: Tables):
    lo, hi = (F.lit(d).cast("date") for d in ("1998-07-01", "2000-05-01"))
    return country_prices(t).filter(~F.col("date").between(lo, hi)).select("country", "date", "price")


@query(
    "p15_cutoff",
    sql_with([PANEL], "SELECT region, pc_type, count(*) FILTER (WHERE date < DATE '2000-07-01') AS before, count(*) FILTER (WHERE date >= DATE '2000-07-01') AS after FROM panel GROUP BY ALL"),
)
def p15(t: Tables):
    past, future = cutoff_split(panel(t), "date", "2000-07-01")
    sides = past.withColumn("late", F.lit(False)).unionByName(future.withColumn("late", F.lit(True)))
    return sides.groupBy("region", "pc_type").agg(F.count_if(~F.col("late")).alias("before"), F.count_if("late").alias("after"))


@query(
    "p16_columns_of_type",
    sql_with([PANEL, WIDE_EU], f"SELECT date, {r('pc_economy_best_price AS gf10_price', 'pc_large_best_price AS recycled_gf10_white_price', 'pc_small_best_price AS benzene_eur_metric_ton')} FROM wide_eu"),
)
def p16(t: Tables):
    from panelweave.plans.gold import select_type_columns

    wide = regional_wide(t, "EUROPE").select(
        "date",
        F.col("pc_economy_best_price").alias("gf10_price"),
        F.col("pc_large_best_price").alias("recycled_gf10_white_price"),
        F.col("pc_medium_best_price").alias("si_price"),
        F.col("pc_small_best_price").alias("benzene_eur_metric_ton"),
    )
    return select_type_columns(wide, "gf10", fv.EXOGENOUS_COLUMNS)


@query("p17_numeric_columns", f"SELECT p_partkey, p_size, {r('p_retailprice')} FROM part")
def p17(t: Tables):
    return t.part.select(*numeric_columns(t.part))
