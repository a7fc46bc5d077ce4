"""Sources and sinks.

File formats are exercised on tables written from the driver tables to the
shared folder and read back.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.catalog.base import Tables, query, r, sql_with
from panelweave.catalog.standins import PANEL, QUARTERS, panel, quarter_prices
from panelweave.operators.reshape import grid_series, quarters_to_months
from panelweave.session import scratch_path
from panelweave.sources import files

CUSTOMER_SQL = f"SELECT c_custkey, c_name, c_nationkey, {r('c_acctbal')}, c_mktsegment FROM customer"
CUSTOMER_SCHEMA = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)


@query("s01_csv_scan", CUSTOMER_SQL)
def s01(t: Tables):
    path = scratch_path(t.spark, "customer_csv")
    files.write_table(t.customer, path, "csv")
    return files.read_csv(t.spark, path, schema=CUSTOMER_SCHEMA)


@query("s02_csv_semicolon", CUSTOMER_SQL)
def s02(t: Tables):
    path = scratch_path(t.spark, "customer_semicolon")
    t.customer.write.option("sep", ";").option("header", True).csv(path)
    return files.read_csv(t.spark, path, sep=";", schema=CUSTOMER_SCHEMA)


@query(
    "s03_parquet_scan",
    f"SELECT o_orderkey, o_custkey, o_orderstatus, {r('o_totalprice')}, o_orderdate, o_orderpriority FROM orders",
)
def s03(t: Tables):
    return files.read_parquet(t.spark, f"{t.folder}/orders.parquet")


@query("s04_first_matching_file", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s04(t: Tables):
    return files.read_parquet(t.spark, files.first_match(t.spark, t.folder, "na*.parquet"))


def staged_cells(t: Tables):
    """Quarter table laid out as a sheet: quarters in row 8, values in rows 14 and 25, from column 2."""
    q = quarter_prices(t)
    col = ((F.substring("quarter", 4, 4).cast("int") - 1990) * 4 + F.substring("quarter", 2, 1).cast("int") + 1).alias("col_idx")
    cells = F.array(
        F.struct(F.lit(8).alias("row_idx"), F.col("quarter").alias("value")),
        F.struct(F.lit(14).alias("row_idx"), F.col("crude").cast("string").alias("value")),
        F.struct(F.lit(25).alias("row_idx"), F.col("benzene").cast("string").alias("value")),
    )
    return q.select(col, F.explode(cells).alias("c")).select("c.row_idx", "col_idx", "c.value")


@query("s05_grid_series", sql_with([QUARTERS], f"SELECT quarter, {r('crude', 'benzene')} FROM quarters"))
def s05(t: Tables):
    return grid_series(staged_cells(t), 8, {14: "crude", 25: "benzene"}, 2)


@query("s06_clean_header", f'SELECT c_custkey AS "cust key", c_name AS "name", {r("c_acctbal")} FROM customer'.replace("AS c_acctbal", 'AS "acct bal"'))
def s06(t: Tables):
    raw = t.customer.select(
        F.col("c_custkey").alias(" Cust\nKey"), F.col("c_name").alias("Name "), F.col("c_acctbal").alias("ACCT BAL")
    )
    return raw.toDF(*files.clean_header(raw.columns))


@query("s07_duplicate_header", f'SELECT c_name AS "date", c_mktsegment AS "x", c_name AS "x.1" FROM customer')
def s07(t: Tables):
    path = scratch_path(t.spark, "duplicate_header")
    # repeats that differ in case or in blanks only become repeats once the header is cleaned
    names = ("Date", "X", "date ", "X ")
    cols = ("c_name", "c_mktsegment", "c_nationkey", "c_name")
    t.customer.select(*[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)]).write.option("header", True).csv(path)
    return files.read_csv(t.spark, path, drop=["date "], clean=True)


@query("s08_sink_round_trip", sql_with([PANEL], f"SELECT date, region, pc_type, {r('pc_price')} FROM panel"))
def s08(t: Tables):
    path = scratch_path(t.spark, "panel")
    files.write_table(panel(t), path, sort=["date", "region", "pc_type"])
    return files.read_parquet(t.spark, path)


@query(
    "s09_holdout",
    sql_with([PANEL], f"SELECT date, region, pc_type, {r('pc_price')} FROM panel WHERE date >= DATE '2001-01-01'"),
)
def s09(t: Tables):
    return files.holdout(panel(t), "date", ["date", "region", "pc_type", "pc_price"], "2001-01-01")


@query("s10_read_or_build", sql_with([QUARTERS], f"SELECT CAST(make_date(CAST(y AS INTEGER), CAST((q - 1) * 3 + 1 + k AS INTEGER), 1) AS DATE) AS date, {r('crude', 'benzene')} FROM quarters, (VALUES (0), (1), (2)) v(k)"))
def s10(t: Tables):
    path = scratch_path(t.spark, "cached")
    build = lambda: quarters_to_months(quarter_prices(t), "quarter")
    files.read_or_build(t.spark, path, build)
    return files.read_or_build(t.spark, path, build)
