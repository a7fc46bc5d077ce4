"""Aggregations and reshapes."""

from pyspark.sql import functions as F

from panelweave.catalog.base import Tables, query, r, sql_with
from panelweave.catalog.standins import (
    ALLOCATED,
    COUNTRY,
    OUTAGES,
    PANEL,
    QUARTERS,
    RETAIL,
    SITES,
    SPARSE,
    WIDE_EU,
    best_price_names,
    country_prices,
    outages,
    panel,
    quarter_prices,
    regional_wide,
    retail,
    sparse_prices,
)
from panelweave.functions.columns import row_min
from panelweave.operators import checks, pricing, profile, reshape
from panelweave.operators.windows import add_roc


@query(
    "a01_date_statistics",
    sql_with(
        [COUNTRY],
        f"""SELECT date, {r('min(price) AS min_price', 'max(price) AS max_price', 'avg(price) AS avg_price',
        'median(price) AS median_price', 'stddev_samp(price) AS std_price')} FROM country_prices GROUP BY date""",
    ),
)
def a01(t: Tables):
    return profile.date_statistics(country_prices(t), "date", "price", "price")


@query("a02_row_minimum", sql_with([RETAIL], f"SELECT date, {r('least(' + ', '.join(SITES) + ') AS best', 'site_3 AS single')} FROM retail"))
def a02(t: Tables):
    return retail(t).select("date", row_min(SITES).alias("best"), row_min([SITES[2]]).alias("single"))


@query(
    "a03_best_price_by_type",
    sql_with([RETAIL], f"""SELECT date, pc_type, {r('min(p) AS best_price')} FROM (
      SELECT date, 'gp' AS pc_type, unnest([site_1, site_2]) AS p FROM retail
      UNION ALL SELECT date, 'gp recycled' AS pc_type, unnest([site_3, site_4]) AS p FROM retail) u GROUP BY ALL"""),
)
def a03(t: Tables):
    named = retail(t).select(
        "date",
        F.col("site_1").alias("asia_supplier_1 pc gp (usd/kg)"),
        F.col("site_2").alias("asia_supplier_2 pc gp (usd/kg)"),
        F.col("site_3").alias("asia_supplier_1 pc gp recycled (usd/kg)"),
        F.col("site_4").alias("pc gp recycled (usd/kg)"),
        F.col("site_5").alias("spread (usd/kg)"),
    )
    return reshape.best_price_by_type(named, "date", named.columns[1:])


@query("a04_interval_allocation", sql_with([OUTAGES, ALLOCATED], f"SELECT status, date, {r('loss AS allocated')} FROM allocated"))
def a04(t: Tables):
    return reshape.allocate_interval(outages(t), "start", "end", "loss", ["status"])


@query(
    "a05_union_and_pivot",
    sql_with(
        [OUTAGES, ALLOCATED],
        f"""SELECT date, {r("max(CASE WHEN status = 'F' THEN loss END) AS acetone_capacity_loss_kt", "max(CASE WHEN status = 'O' THEN loss END) AS phenol_capacity_loss_kt")}
        FROM allocated WHERE status IN ('F', 'O') GROUP BY date""",
    ),
)
def a05(t: Tables):
    src = outages(t)
    parts = [
        src.filter(F.col("status") == code).select(F.lit(name).alias("chemical"), "start", "end", "loss")
        for code, name in (("F", "acetone"), ("O", "phenol"))
    ]
    both = reshape.allocate_interval(parts[0].unionByName(parts[1]), "start", "end", "loss", ["chemical"])
    names = {"acetone": "acetone_capacity_loss_kt", "phenol": "phenol_capacity_loss_kt"}
    return reshape.to_wide(both, ["date"], "chemical", "allocated", names)


MONTHS = [f"{m} {y}" for y in range(1995, 2002) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]


@query(
    "a06_matrix_row_series",
    f"""SELECT date, {r('v AS capacity_loss_kt')} FROM (
      SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) / 1000 AS v
      FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) m""",
)
def a06(t: Tables):
    label = F.when(F.col("o_orderstatus") == "O", "BISPHENOL A").otherwise(F.col("o_orderstatus")).alias("Derivative")
    matrix = (
        t.orders.select(label, F.date_format("o_orderdate", "MMM yyyy").alias("m"), "o_totalprice")
        .groupBy("Derivative")
        .pivot("m", MONTHS)
        .agg(F.avg("o_totalprice") / 1000)
        .withColumn("Avg. Conversion Factor (+)", F.lit(1.0))
    )
    return reshape.matrix_row_series(matrix, "Derivative", "BISPHENOL A", "capacity_loss_kt")


@query(
    "a07_unpivot_prices",
    sql_with([PANEL], f"SELECT date, 'europe' AS region, lower(pc_type) AS pc_type, {r('pc_price')} FROM panel WHERE region = 'EUROPE'"),
)
def a07(t: Tables):
    return reshape.price_panel(regional_wide(t, "EUROPE"), "europe")


@query(
    "a08_melt_two_ids",
    sql_with(
        [RETAIL],
        "SELECT date, month, site, "
        + r("price")
        + " FROM ("
        + " UNION ALL ".join(f"SELECT date, CAST(month(date) AS INTEGER) AS month, '{s}' AS site, {s} AS price FROM retail" for s in SITES)
        + ") u",
    ),
)
def a08(t: Tables):
    src = retail(t).withColumn("month", F.month("date"))
    return reshape.to_long(src, ["date", "month"], SITES, "site", "price")


@query(
    "a09_quarters_to_months",
    sql_with([QUARTERS], f"SELECT CAST(make_date(CAST(y AS INTEGER), CAST((q - 1) * 3 + 1 + k AS INTEGER), 1) AS DATE) AS date, {r('crude', 'benzene')} FROM quarters, (VALUES (0), (1), (2)) v(k)"),
)
def a09(t: Tables):
    return reshape.quarters_to_months(quarter_prices(t), "quarter")


@query("a10_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a10(t: Tables):
    return checks.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("a11_coverage", sql_with([PANEL], "SELECT region, pc_type, min(date) AS first_date, max(date) AS last_date, count(*) AS rows FROM panel GROUP BY ALL"))
def a11(t: Tables):
    return profile.coverage(panel(t), ["region", "pc_type"], "date")


@query(
    "a12_mapping_audit",
    sql_with(
        [],
        """SELECT 'p_brand->p_type' AS direction, p_brand AS value, count(DISTINCT p_type) AS partners FROM part GROUP BY ALL
        UNION ALL SELECT 'p_type->p_brand', p_type, count(DISTINCT p_brand) FROM part GROUP BY ALL""",
    ),
)
def a12(t: Tables):
    return profile.mapping_audit(t.part, "p_brand", "p_type")


@query(
    "a13_onboarding",
    sql_with(
        [COUNTRY, "f AS (SELECT country, min(date) AS first_month FROM country_prices GROUP BY country)"],
        """SELECT first_month, count(*) AS added, array_to_string(list(country ORDER BY country), ',') AS added_keys,
        CAST(sum(count(*)) OVER (ORDER BY first_month) AS BIGINT) AS cumulative FROM f GROUP BY first_month""",
    ),
)
def a13(t: Tables):
    return profile.onboarding(country_prices(t), "country", "date").withColumn("added_keys", F.concat_ws(",", "added_keys"))


@query(
    "a14_null_profile",
    sql_with(
        [RETAIL],
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
            + r(f"count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS missing_pct")
            + " FROM retail"
            for c in ("date", "avgprice", *SITES)
        ),
    ),
)
def a14(t: Tables):
    return profile.null_profile(retail(t))


@query(
    "a15_rows_with_null",
    sql_with([RETAIL], f"SELECT date, {r('avgprice', *SITES)} FROM retail WHERE avgprice IS NULL OR " + " OR ".join(f"{s} IS NULL" for s in SITES)),
)
def a15(t: Tables):
    return profile.rows_with_null(retail(t))


PCTS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query(
    "a16_describe",
    f"""SELECT event_type, count(value) AS n, {r('avg(value) AS mean', 'stddev_samp(value) AS std', 'min(value) AS min', 'max(value) AS max',
    *[f'quantile_cont(value, {p}) AS {n}' for n, p in PCTS.items()])} FROM events GROUP BY ALL""",
)
def a16(t: Tables):
    return profile.describe_exact(t.events, "value", PCTS, ["event_type"])


@query(
    "a16_describe_whole",
    f"""SELECT count(l_extendedprice) AS n, {r('avg(l_extendedprice) AS mean', 'stddev_samp(l_extendedprice) AS std', 'min(l_extendedprice) AS min', 'max(l_extendedprice) AS max',
    *[f'quantile_cont(l_extendedprice, {p}) AS {n}' for n, p in PCTS.items()])} FROM lineitem""",
)
def a16_whole(t: Tables):
    return profile.describe_exact(t.lineitem, "l_extendedprice", PCTS)


CAL = r("avg(price) AS mean", "median(price) AS median", "stddev_samp(price) AS std", "min(price) AS min", "max(price) AS max")


@query("a17_month_profile", sql_with([COUNTRY], f"SELECT CAST(month(date) AS INTEGER) AS month, {CAL} FROM country_prices GROUP BY ALL"))
def a17(t: Tables):
    return profile.calendar_profile(country_prices(t), "date", "price", "month")


@query("a17_year_profile", sql_with([COUNTRY], f"SELECT CAST(year(date) AS INTEGER) AS year, {CAL} FROM country_prices GROUP BY ALL"))
def a17_year(t: Tables):
    return profile.calendar_profile(country_prices(t), "date", "price", "year")


NAMES = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


@query(
    "a18_year_month_matrix",
    sql_with(
        [COUNTRY],
        f"SELECT CAST(year(date) AS INTEGER) AS year, {r(*[f'avg(CASE WHEN month(date) = {i + 1} THEN price END) AS {n}' for i, n in enumerate(NAMES)])} FROM country_prices GROUP BY ALL",
    ),
)
def a18(t: Tables):
    return profile.year_month_matrix(country_prices(t), "date", "price")


@query(
    "a19_extreme_rows",
    sql_with(
        [SPARSE],
        f"""SELECT country, CAST(arg_min(priority, (price, priority)) AS VARCHAR) AS min_priority, {r('min(price) AS min_price')},
        CAST(arg_min(priority, (-price, priority)) AS VARCHAR) AS max_priority, {r('max(price) AS max_price')} FROM sparse GROUP BY country""",
    ),
)
def a19(t: Tables):
    return profile.extreme_rows(sparse_prices(t), ["country"], "priority", "price")


@query("a20_frequency", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_brand, p_type LIMIT 5")
def a20(t: Tables):
    return profile.frequency(t.part, ["p_brand", "p_type"], 5)


@query(
    "a21_histogram",
    f"""SELECT CAST(least(39, floor((l_extendedprice - lo) / ((hi - lo) / 40))) AS INTEGER) AS bin, count(*) AS n,
    {r('min(l_extendedprice) AS smallest', 'max(l_extendedprice) AS largest')}
    FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) b GROUP BY 1""",
)
def a21(t: Tables):
    return profile.histogram(t.lineitem, "l_extendedprice")


@query(
    "a22_monthly_with_source",
    sql_with(
        [
            RETAIL,
            f"d AS (SELECT date, coalesce(avgprice, least({', '.join(SITES)})) AS p, avgprice IS NOT NULL AS own FROM retail)",
            "m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(p) AS product_price, bool_and(own) AS own FROM d GROUP BY ALL)",
            "s AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS date FROM (SELECT min(date) AS a, max(date) AS b FROM m) x)",
        ],
        f"SELECT date, {r('product_price')}, CASE WHEN coalesce(own, true) THEN 'average' ELSE 'includes_min' END AS price_source FROM s LEFT JOIN m USING (date)",
    ),
)
def a22(t: Tables):
    return pricing.monthly_with_source(pricing.product_price(retail(t), "avgprice", SITES), "date")


@query(
    "a23_distinct_on_subset",
    """SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, min(o_orderkey) AS o_orderkey FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS k FROM orders) q WHERE k = 1 GROUP BY ALL""",
)
def a23(t: Tables):
    src = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_orderkey")
    return profile.first_per_key(src, ["o_custkey"], ["date", "o_orderkey"])


@query(
    "a24_group_summary",
    sql_with([COUNTRY], f"""SELECT country, {r(*[f'round({f}(price) + 3e-8, 2) AS {n}' for n, f in (('mean', 'avg'), ('std', 'stddev_samp'), ('min', 'min'), ('max', 'max'))])}, count(price) AS n
    FROM country_prices GROUP BY country"""),
)
def a24(t: Tables):
    return profile.group_summary(country_prices(t).withColumn("price", F.col("price") + F.lit(3e-8)), ["country"], "price")


@query(
    "a24_change_volatility",
    sql_with(
        [COUNTRY, "c AS (SELECT country, price / nullif(lag(price) OVER (PARTITION BY country ORDER BY date), 0) - 1 AS p FROM country_prices)"],
        f"SELECT country, {r('avg(p) AS mean_change', 'stddev_samp(p) AS change_std')}, count(p) AS observations FROM c GROUP BY country HAVING count(p) > 1",
    ),
)
def a24_volatility(t: Tables):
    change = add_roc(country_prices(t), ["price"], [1], keys=["country"])
    return (
        change.groupBy("country")
        .agg(F.avg("price_roc_1").alias("mean_change"), F.stddev_samp("price_roc_1").alias("change_std"), F.count("price_roc_1").alias("observations"))
        .dropna()
    )


@query(
    "a25_variation",
    sql_with([PANEL, WIDE_EU], f"SELECT {r(*[f'stddev_samp({c}) / avg({c}) * 100 AS {c}_cv' for c in best_price_names().values()])} FROM wide_eu"),
)
def a25(t: Tables):
    return profile.variation(regional_wide(t, "EUROPE"), list(best_price_names().values()))


@query(
    "a26_boxplot",
    f"""SELECT p_type, {r(*[f'quantile_cont(l_extendedprice / l_quantity, {p}) AS {n}' for n, p in profile.BOX.items()])}
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""",
)
def a26(t: Tables):
    lines = t.lineitem.select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    kinds = t.part.select("p_partkey", "p_type")
    return profile.boxplot(lines.join(kinds, F.col("l_partkey") == F.col("p_partkey")), ["p_type"], "unit")


@query("a27_min_over_regions", sql_with([PANEL], f"SELECT date, pc_type, {r('min(pc_price) AS pc_price')} FROM panel GROUP BY ALL"))
def a27(t: Tables):
    return panel(t).groupBy("date", "pc_type").agg(F.min("pc_price").alias("pc_price"))


@query(
    "a28_largest_group",
    "SELECT max(n) AS max_records FROM (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL) g",
)
def a28(t: Tables):
    return profile.largest_group(t.orders.withColumn("d", F.col("o_orderdate").cast("date")), ["o_custkey"], "d")
