"""Driver tables shaped like this toolkit's inputs, with the matching SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.catalog.base import Tables
from panelweave.functions.calendar import month_start
from panelweave.operators.profile import date_statistics
from panelweave.operators.reshape import allocate_interval, quarters_to_months, to_wide

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SITES = tuple(f"site_{p[0]}" for p in PRIORITIES)
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def order_place(t: Tables) -> DataFrame:
    """Order key with nation and region; dimension sizes are known from the files."""
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def panel(t: Tables) -> DataFrame:
    """(date, region, pc_type, pc_price): mean unit price by ship month.

    Joins shuffle on the order key and, if the part file is not small, on the
    part key; hot keys there are split by adaptive skew handling. The panel
    itself is combined map-side, so a region or type with a third of all rows
    reaches the shuffle as one partial sum per task.
    """
    lines = t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        month_start(F.col("l_shipdate")).alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
    )
    place = order_place(t).select("o_orderkey", F.col("r_name").alias("region"))
    kinds = t.part.select("p_partkey", F.col("p_type").alias("pc_type"))
    return (
        lines.join(place, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(kinds, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("date", "region", "pc_type")
        .agg(F.avg("unit").alias("pc_price"))
    )


PANEL = """panel AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, r_name AS region, p_type AS pc_type,
         avg(l_extendedprice / l_quantity) AS pc_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""


def best_price_names() -> dict[str, str]:
    return {k: f"pc_{k.lower()}_best_price" for k in TYPES}


def regional_wide(t: Tables, region: str, source: DataFrame | None = None) -> DataFrame:
    """Best-price table of one region: a date and one column per type."""
    rows = (source or panel(t)).filter(F.col("region") == region)
    return to_wide(rows, ["date"], "pc_type", "pc_price", best_price_names())


def _wide_sql(name: str, region: str) -> str:
    cols = ",\n".join(f"  max(CASE WHEN pc_type = '{k}' THEN pc_price END) AS {v}" for k, v in best_price_names().items())
    return f"{name} AS (SELECT date,\n{cols}\n  FROM panel WHERE region = '{region}' GROUP BY date)"


WIDE_EU = _wide_sql("wide_eu", "EUROPE")
WIDE_ASIA = _wide_sql("wide_asia", "ASIA")


def country_prices(t: Tables) -> DataFrame:
    """(country, iso3, date, price) by order month."""
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(
            F.col("n_name").alias("country"),
            F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso3"),
            month_start(F.col("o_orderdate")).alias("date"),
        )
        .agg((F.avg("o_totalprice") / 1000).alias("price"))
    )


COUNTRY = """country_prices AS (
  SELECT n_name AS country, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         avg(o_totalprice) / 1000 AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""


def sparse_prices(t: Tables) -> DataFrame:
    """(country, priority, date, price): months without such orders are missing."""
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(
            F.col("n_name").alias("country"),
            F.col("o_orderpriority").alias("priority"),
            month_start(F.col("o_orderdate")).alias("date"),
        )
        .agg((F.avg("o_totalprice") / 1000).alias("price"))
    )


SPARSE = """sparse AS (
  SELECT n_name AS country, o_orderpriority AS priority, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         avg(o_totalprice) / 1000 AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""


def rate_table(t: Tables, priority: str, name: str) -> DataFrame:
    """Daily rate from orders of one priority; every third day of the month has none."""
    day = F.col("o_orderdate").cast("date")
    rate = F.when(F.dayofmonth("observation_date") % 3 != 0, F.col("_r"))
    return (
        t.orders.filter(F.col("o_orderpriority") == priority)
        .groupBy(day.alias("observation_date"))
        .agg((F.avg("o_totalprice") / 1e5).alias("_r"))
        .select("observation_date", rate.alias(name))
    )


def _rate_sql(cte: str, priority: str, name: str) -> str:
    return f"""{cte} AS (SELECT CAST(o_orderdate AS DATE) AS observation_date,
  CASE WHEN day(CAST(o_orderdate AS DATE)) % 3 <> 0 THEN avg(o_totalprice) / 1e5 END AS {name}
  FROM orders WHERE o_orderpriority = '{priority}' GROUP BY CAST(o_orderdate AS DATE))"""


RATES = [
    _rate_sql("rate_rmb", "1-URGENT", "DEXCHUS"),
    _rate_sql("rate_inr", "2-HIGH", "DEXINUS"),
    _rate_sql("rate_eur", "3-MEDIUM", "DEXUSEU"),
]


def three_rates(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        rate_table(t, "1-URGENT", "DEXCHUS"),
        rate_table(t, "2-HIGH", "DEXINUS"),
        rate_table(t, "3-MEDIUM", "DEXUSEU"),
    )


def outages(t: Tables) -> DataFrame:
    """(status, start, end, loss): order date to last ship date; some end before they start."""
    last = t.lineitem.groupBy("l_orderkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("end"))
    return t.orders.join(last, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("date").alias("start"),
        "end",
        (F.col("o_totalprice") / 1000).alias("loss"),
    )


OUTAGES = """outages AS (
  SELECT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS start_d, e AS end_d, o_totalprice / 1000 AS loss
  FROM orders JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS e FROM lineitem GROUP BY l_orderkey) x
    ON o_orderkey = l_orderkey)"""
ALLOCATED = """allocated AS (
  SELECT status, CAST(date_trunc('month', d) AS DATE) AS date, sum(loss / (date_diff('day', start_d, end_d) + 1)) AS loss
  FROM (SELECT status, start_d, end_d, loss,
               unnest(generate_series(start_d, end_d, INTERVAL 1 DAY)) AS d
        FROM outages WHERE end_d >= start_d) y
  GROUP BY ALL)"""


def quarter_prices(t: Tables) -> DataFrame:
    """(quarter text, crude, benzene)."""
    q = F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit(" "), F.year("o_orderdate"))
    return t.orders.groupBy(q.alias("quarter")).agg(
        (F.avg("o_totalprice") / 1000).alias("crude"), (F.max("o_totalprice") / 1000).alias("benzene")
    )


QUARTERS = """quarters AS (
  SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q,
         'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter,
         avg(o_totalprice) / 1000 AS crude, max(o_totalprice) / 1000 AS benzene
  FROM orders GROUP BY ALL)"""


def retail(t: Tables) -> DataFrame:
    """Day grid: cheapest order per priority as five sites, an average missing every fourth day."""
    day = F.col("o_orderdate").cast("date")
    grid = (
        t.orders.groupBy(day.alias("date"))
        .pivot("o_orderpriority", list(PRIORITIES))
        .agg(F.min("o_totalprice") / 1000)
        .withColumnsRenamed(dict(zip(PRIORITIES, SITES, strict=True)))
    )
    mean = t.orders.groupBy(day.alias("date")).agg((F.avg("o_totalprice") / 1000).alias("_m"))
    return grid.join(mean, "date").select(
        "date", F.when(F.dayofmonth("date") % 4 != 0, F.col("_m")).alias("avgprice"), *SITES
    )


RETAIL = (
    "retail AS (SELECT CAST(o_orderdate AS DATE) AS date,\n"
    "  CASE WHEN day(CAST(o_orderdate AS DATE)) % 4 <> 0 THEN avg(o_totalprice) / 1000 END AS avgprice,\n"
    + ",\n".join(
        f"  min(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END) / 1000 AS {s}" for p, s in zip(PRIORITIES, SITES, strict=True)
    )
    + "\n  FROM orders GROUP BY CAST(o_orderdate AS DATE))"
)


def event_days(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("ts").cast("date").alias("date"), "event_type").agg(F.avg("value").alias("value"))


EVENT_DAYS = """event_days AS (
  SELECT CAST(ts AS DATE) AS date, event_type, avg(value) AS value FROM events GROUP BY ALL)"""


def unit_prices(t: Tables) -> DataFrame:
    """Raw prices with a declared unit, typed in the wrong scale on odd order keys."""
    unit = (
        F.when(F.col("l_returnflag") == "A", "rmb/t").when(F.col("l_returnflag") == "N", "rmb/kg").otherwise("usd/kg")
    )
    base = F.col("l_extendedprice") / F.col("l_quantity") / 20
    odd = F.col("l_orderkey") % 2 == 1
    price = (
        F.when(F.col("l_returnflag") == "A", F.when(odd, base / 10).otherwise(base * 100))
        .when(F.col("l_returnflag") == "N", F.when(odd, base * 100).otherwise(base / 10))
        .otherwise(F.when(odd, base * 100).otherwise(base / 100))
    )
    return t.lineitem.select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("supplier"), unit.alias("unit"), price.alias("price")
    )


UNIT_PRICES = """unit_prices AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS supplier,
    CASE l_returnflag WHEN 'A' THEN 'rmb/t' WHEN 'N' THEN 'rmb/kg' ELSE 'usd/kg' END AS unit,
    CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_orderkey % 2 = 1 THEN b / 10 ELSE b * 100 END
         WHEN l_returnflag = 'N' THEN CASE WHEN l_orderkey % 2 = 1 THEN b * 100 ELSE b / 10 END
         ELSE CASE WHEN l_orderkey % 2 = 1 THEN b * 100 ELSE b / 100 END END AS price
  FROM (SELECT *, l_extendedprice / l_quantity / 20 AS b FROM lineitem) z)"""


def exogenous(t: Tables) -> list[DataFrame]:
    """Five monthly side tables holding the eleven exogenous columns."""
    month = month_start(F.col("l_shipdate")).alias("date")
    bpa = t.lineitem.groupBy(month).agg(
        (F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * F.col("l_tax"))) / 100).alias("bpa_capacity_loss_kt")
    )
    power = date_statistics(country_prices(t), "date", "price", "price_eur_mwhe")
    cars = t.orders.groupBy(month_start(F.col("o_orderdate")).alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("new_passenger_car_registration")
    )
    lost = allocate_interval(outages(t), "start", "end", "loss", ["status"])
    shut = to_wide(lost, ["date"], "status", "allocated", {"F": "acetone_capacity_loss_kt", "O": "phenol_capacity_loss_kt"})
    goods = quarters_to_months(quarter_prices(t), "quarter").withColumnsRenamed(
        {"crude": "crude_oil_brent_eur_bbl", "benzene": "benzene_eur_metric_ton"}
    )
    return [bpa, power, cars, shut, goods]


EXOGENOUS = [
    COUNTRY,
    OUTAGES,
    ALLOCATED,
    QUARTERS,
    """x_bpa AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity * l_tax END) / 100 AS bpa_capacity_loss_kt FROM lineitem GROUP BY ALL)""",
    """x_power AS (SELECT date, min(price) AS min_price_eur_mwhe, max(price) AS max_price_eur_mwhe,
  avg(price) AS avg_price_eur_mwhe, median(price) AS median_price_eur_mwhe,
  stddev_samp(price) AS std_price_eur_mwhe FROM country_prices GROUP BY ALL)""",
    """x_cars AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
  CAST(count(*) AS DOUBLE) AS new_passenger_car_registration FROM orders GROUP BY ALL)""",
    """x_shut AS (SELECT date, max(CASE WHEN status = 'F' THEN loss END) AS acetone_capacity_loss_kt,
  max(CASE WHEN status = 'O' THEN loss END) AS phenol_capacity_loss_kt FROM allocated GROUP BY ALL)""",
    """x_goods AS (SELECT CAST(make_date(CAST(y AS INTEGER), CAST((q - 1) * 3 + 1 + k AS INTEGER), 1) AS DATE) AS date,
  crude AS crude_oil_brent_eur_bbl, benzene AS benzene_eur_metric_ton FROM quarters, (VALUES (0), (1), (2)) v(k))""",
]
EXOGENOUS_JOIN = (
    "LEFT JOIN x_bpa USING (date) LEFT JOIN x_power USING (date) LEFT JOIN x_cars USING (date) "
    "LEFT JOIN x_shut USING (date) LEFT JOIN x_goods USING (date)"
)
