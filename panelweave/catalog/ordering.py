"""Sorts, limits, set operations."""

from pyspark.sql import functions as F

from panelweave.catalog.base import Tables, query, r, sql_with
from panelweave.catalog.standins import COUNTRY, PANEL, country_prices, panel
from panelweave.fixed_values import TARGET_TYPES
from panelweave.operators import profile


@query("o01_multi_key_sort", sql_with([PANEL], f"SELECT date, region, pc_type, {r('pc_price')} FROM panel ORDER BY date, region, pc_type"))
def o01(t: Tables):
    return panel(t).orderBy("date", "region", "pc_type")


@query("o02_top_k", f"SELECT o_orderkey, {r('o_totalprice')} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o02(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(
    "o03_latest_extremes",
    sql_with(
        [COUNTRY, "l AS (SELECT date, country, price FROM country_prices WHERE date = (SELECT max(date) FROM country_prices))"],
        f"""SELECT * FROM (SELECT date, country, {r('price')}, 'high' AS side FROM l ORDER BY l.price DESC, country LIMIT 5) h
        UNION ALL SELECT * FROM (SELECT date, country, {r('price')}, 'low' AS side FROM l ORDER BY l.price, country LIMIT 5) w""",
    ),
)
def o03(t: Tables):
    return profile.latest_extremes(country_prices(t), "date", "country", "price")


@query(
    "o04_union_all",
    "SELECT 'customer' AS kind, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_name, s_nationkey FROM supplier",
)
def o04(t: Tables):
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    b = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return a.unionByName(b)


@query("o05_distinct_pairs", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def o05(t: Tables):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


EXPECTED = (*TARGET_TYPES, "economy", "large")


@query(
    "o06_missing_types",
    "SELECT pc_type FROM (VALUES " + ", ".join(f"('{x}')" for x in EXPECTED) + ") v(pc_type) EXCEPT SELECT lower(p_type) FROM part",
)
def o06(t: Tables):
    return profile.missing_values(t.part.select(F.lower("p_type").alias("pc_type")), "pc_type", EXPECTED)
