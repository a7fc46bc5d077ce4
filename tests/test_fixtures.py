"""Hand-worked micro-fixtures for the value-level traps."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.functions.columns import finite, pearson, ratio, row_min
from panelweave.functions.units import converted_name, repair_unit, type_of
from panelweave.operators import checks, joins, pricing, reshape, scoring, splits, stats, windows
from panelweave.plans import gold, silver
from panelweave.sources import files


def d(text):
    return dt.date.fromisoformat(text)


def rows(df):
    return [tuple(r) for r in df.collect()]


def series(spark, values, key="a", start="2020-01-01"):
    first = d(start)
    data = [(key, dt.date(first.year + (first.month - 1 + i) // 12, (first.month - 1 + i) % 12 + 1, 1), v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "k string, date date, x double")


def test_interval_month_edges(spark):
    src = spark.createDataFrame(
        [
            (d("2020-01-15"), d("2020-03-10"), 56.0),
            (d("2020-02-28"), d("2020-02-29"), 4.0),
            (d("2020-05-02"), d("2020-05-01"), 9.0),
            (None, d("2020-05-01"), 9.0),
            (d("2020-05-01"), d("2020-05-01"), None),
        ],
        "s date, e date, loss double",
    )
    out = {r["date"]: r["allocated"] for r in reshape.allocate_interval(src, "s", "e", "loss").collect()}
    assert out == {d("2020-01-01"): 17.0, d("2020-02-01"): 33.0, d("2020-03-01"): 10.0}
    assert math.isclose(sum(out.values()), 60.0)


def test_unit_thresholds(spark):
    data = [("rmb/t", 99.0), ("rmb/t", 100.0), ("rmb/kg", 100.0), ("rmb/kg", 101.0), ("usd/t", 9.9), ("usd/t", 10.0), ("usd/kg", 1000.0), ("usd/kg", 1001.0), ("inr/kg", 5.0)]
    df = spark.createDataFrame(data, "unit string, p double")
    got = [r[0] for r in df.select(repair_unit(F.col("p"), F.col("unit"))).collect()]
    assert got == [99000.0, 100.0, 100.0, 0.101, 9900.0, 10.0, 1000.0, 1.001, 5.0]


def test_one_column_minimum(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (None, None)], "a double, b double")
    assert rows(df.select(row_min(["a"]), row_min(["a", "b"]))) == [(1.0, 1.0), (None, 3.0), (None, None)]


def test_rate_fill(spark):
    days = [d(f"2020-01-0{i}") for i in range(1, 6)]
    df = spark.createDataFrame(list(zip(days, [None, 0.0, 7.1, None, None])), ["date", fv.ASIA_RATE_RMB]).select("date", F.col(f"`{fv.ASIA_RATE_RMB}`").cast("double"))
    rates = spark.createDataFrame(
        [(days[1], 6.9, None, 1.1), (days[2], 6.8, 80.0, 1.2)], f"{fv.RATE_DATE} date, {fv.RATE_RMB} double, {fv.RATE_INR} double, {fv.RATE_EUR} double"
    )
    out = silver.fill_rates(df, rates).orderBy("date")
    assert [r[fv.ASIA_RATE_RMB] for r in out.collect()] == [6.9, 6.9, 7.1, 7.1, 7.1]
    assert [r[fv.ASIA_RATE_INR] for r in out.collect()] == [80.0] * 5
    assert [r[fv.ASIA_RATE_EUR] for r in out.collect()] == [1.1, 1.1, 1.2, 1.2, 1.2]


def test_lag_counts_rows_not_months(spark):
    data = [("a", d("2020-01-01"), 1.0), ("a", d("2020-02-01"), 2.0), ("a", d("2020-05-01"), 5.0)]
    df = spark.createDataFrame(data, "k string, date date, x double")
    out = windows.add_lags(df, ["x"], [1], keys=["k"]).orderBy("date")
    assert [r["x_lag_1"] for r in out.collect()] == [None, 1.0, 2.0]


def test_rolling_std_only_for_last_window_and_null_for_one_row(spark):
    out = windows.add_rolling(series(spark, [1.0, 3.0]), ["x"], (3, 6, 12), keys=["k"], std="last", label="rolling")
    assert [c for c in out.columns if "std" in c] == ["x_rolling_std_12"]
    assert [r["x_rolling_std_12"] for r in out.orderBy("date").collect()] == [None, pytest.approx(math.sqrt(2))]


def test_timestamps_are_refused_as_series_order(spark):
    with pytest.raises(TypeError):
        windows.add_lags(series(spark, [1.0]).withColumn("date", F.col("date").cast("timestamp")), ["x"], [1], keys=["k"])


def test_zero_division_gives_null(spark):
    src = series(spark, [0.0, 2.0])
    assert windows.add_roc(src, ["x"], [1], keys=["k"]).orderBy("date").collect()[1]["x_roc_1"] is None
    assert windows.add_diff(src, ["x"], [1], keys=["k"]).orderBy("date").collect()[1]["x_log_diff_1"] is None
    assert rows(spark.range(1).select(ratio(F.lit(1.0), F.lit(0.0)), finite(F.lit(float("nan"))), finite(F.lit(float("-inf"))))) == [(None, None, None)]


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert rows(df.agg(pearson(F.col("a"), F.col("b")))) == [(None,)]


def test_spearman_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (2.0, 4.0), (5.0, 4.0), (None, 9.0)], "a double, b double")
    out = stats.corr_pairs(df, ["a", "b"], "spearman").first()
    assert out["r"] == pytest.approx(0.5) and out["n"] == 4


def test_duplicate_headers(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('Date,x,date,x,"A\nB "\n2020-01-01,1,zz,2,3\n')
    out = files.read_csv(spark, str(path), drop=["date"], clean=True)
    assert out.columns == ["date", "x", "x.1", "a b"]
    assert rows(out) == [("2020-01-01", "1", "2", "3")]


def test_type_names(spark):
    names = ["asia_supplier_7 pc gf fr", "pc si (inr/kg)", "asia_supplier_4  (usd/kg)", "asia_supplier_1  pc gf recycled (rmb/t)"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert rows(df.select(type_of(F.col("n")), converted_name(F.col("n")))) == [
        ("gf", "asia_supplier_7 pc gf (usd/kg)"),
        (None, "pc si (usd/kg)"),
        (None, None),
        ("gf recycled", "asia_supplier_1 pc gf recycled (usd/kg)"),
    ]


def test_split_takes_latest_valid_date(spark):
    src = series(spark, [float(i) for i in range(30)], "a").unionByName(series(spark, [float(i) for i in range(30)], "b"))
    got = splits.split_dates(src, "date", ["k"], ["a", "b"], 20, 5).first()
    assert (got["test_date"], got["adaptive"]) == (d("2022-02-01"), True)  # the 26th of 30 months
    none = splits.split_dates(src, "date", ["k"], ["a", "zz"], 20, 5).first()
    assert (none["test_date"], none["adaptive"]) == (d("2022-01-01"), False)  # last int(30 * 0.2) dates
    zero = splits.split_dates(src, "date", ["k"], ["zz"], 20, 5, test_ratio=0.01).first()
    assert zero["test_date"] == d("2020-01-01")  # no test date left: first date
    first = splits.split_dates(src, "date", ["k"], ["zz"], 20, 5, fallback="first").first()
    assert first["test_date"] == d("2022-01-01")


def test_three_way_split_against_search(spark):
    import itertools
    import random

    rng = random.Random(5)
    months = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(24)]
    data = [(k, m) for k in "abc" for m in months for _ in range(rng.randint(0, 2))]
    src = spark.createDataFrame(data, "k string, date date")
    for need in [(6, 4, 4), (10, 5, 7), (3, 9, 2), (40, 1, 1)]:
        best = None
        for v, t in itertools.combinations(sorted({m for _, m in data}), 2):
            ok = all(
                sum(1 for g, m in data if g == k and m < v) >= need[0]
                and sum(1 for g, m in data if g == k and v <= m < t) >= need[1]
                and sum(1 for g, m in data if g == k and m >= t) >= need[2]
                for k in "abc"
            )
            if ok and (best is None or (v, t) > best):
                best = (v, t)
        got = splits.split_dates(src, "date", ["k"], None, need[0], need[2], need[1]).first()
        if best is None:
            assert not got["adaptive"]
        else:
            assert (got["validation_date"], got["test_date"]) == best


def test_weights_sum_to_rows(spark):
    data = [(f"t{i % 3}", "europe" if i % 2 else "asia") for i in range(30)] + [("t0", "asia")] * 7
    df = spark.createDataFrame(data, "pc_type string, region string")
    for method in ("balanced", "inverse_frequency", "sqrt_inverse"):
        out = splits.sample_weights(df, "pc_type", "region", "europe", method).collect()
        assert sum(r["weight"] for r in out) == pytest.approx(37)
        w = {(r["pc_type"], r["region"]): r["weight"] for r in out}
        assert w["t1", "europe"] / w["t1", "asia"] == pytest.approx(1.5)
    with pytest.raises(ValueError):
        splits.weight_table(df, "pc_type", "region", "europe", "other")


def test_two_mape_rules(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, f double")
    assert scoring.mape(df, "y", "f", zero="skip").first()["mape"] == 0.5
    assert scoring.mape(df, "y", "f").first()["mape"] > 1e14
    none = scoring.mape(df.filter("y = 0"), "y", "f", zero="skip").first()
    assert none["mape"] is None and none["n"] == 0


def test_empty_month_counts_as_average(spark):
    df = spark.createDataFrame(
        [(d("2020-01-05"), 2.0, "average"), (d("2020-03-05"), 4.0, "average"), (d("2020-03-06"), 6.0, "min_website")],
        "date date, product_price double, price_source string",
    )
    out = rows(pricing.monthly_with_source(df, "date").orderBy("date"))
    assert out == [(d("2020-01-01"), 2.0, "average"), (d("2020-02-01"), None, "average"), (d("2020-03-01"), 5.0, "includes_min")]


def test_cost_plus(spark):
    df = spark.createDataFrame([(2.15,)], "p double")
    got = pricing.cost_plus(df, {"regular": "p", "green": "p"}).first()
    assert got["price_green_base"] == pytest.approx(2.07) and got["price_regular_premium"] == pytest.approx(2.25)


def test_duplicate_keys_fail(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError):
        checks.assert_unique(df, ["k"])
    with pytest.raises(PySparkException):
        joins.join_checked(df.select("k").distinct(), df, ["k"]).collect()
    assert joins.join_checked(df, df.select("k").distinct(), ["k"], validate="m:1").count() == 2
    with pytest.raises(PySparkException):
        joins.join_checked(df, df.select("k").distinct(), ["k"], validate="1:1").collect()


def test_quarters_skip_bad_text(spark):
    df = spark.createDataFrame([("Q1 2018", 1.0), ("Q4 2019", 2.0), ("total", 3.0), ("Q7 2018", 4.0)], "q string, v double")
    out = sorted(rows(reshape.quarters_to_months(df, "q")))
    assert out == [(d(f"2018-0{m}-01"), 1.0) for m in (1, 2, 3)] + [(d(f"2019-{m}-01"), 2.0) for m in (10, 11, 12)]


def test_missing_matrix_row_and_file(spark, tmp_path):
    df = spark.createDataFrame([("ACETONE", 1.0)], ["Derivative", "Jul 2017"])
    with pytest.raises(ValueError):
        silver.bpa_capacity_loss(df)
    (tmp_path / "b.csv").write_text("x\n1\n")
    (tmp_path / "a.csv").write_text("x\n1\n")
    assert files.first_match(spark, str(tmp_path), "*.csv").endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        files.first_match(spark, str(tmp_path), "*.xlsx")


def test_unsupported_horizon_and_type(spark):
    with pytest.raises(ValueError):
        gold.check_horizon(4)
    with pytest.raises(ValueError):
        gold.select_type_columns(spark.range(1), "zz")


def test_unpivot_of_pivot_is_identity(spark):
    src = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "id int, k string, v double")
    wide = reshape.to_wide(src, ["id"], "k", "v", {"a": "a", "b": "b"})
    back = reshape.to_long(wide, ["id"], ["a", "b"], "k", "v", drop_null=True)
    assert sorted(rows(back)) == sorted(rows(src))


def test_supervised_fill_modes(spark):
    src = series(spark, [1.0, 2.0, 3.0, 4.0]).withColumn("f", F.when(F.col("x") > 1, F.col("x") * 10))
    both = splits.supervised(src, "x", 1, ["f"]).orderBy("date")
    assert [r["f"] for r in both.collect()] == [20.0, 20.0, 30.0]
    forward = splits.supervised(src, "x", 1, ["f"], fill="forward").orderBy("date")
    assert [r["f"] for r in forward.collect()] == [20.0, 30.0]


def test_short_series_refuses_chrono_split(spark):
    with pytest.raises(PySparkException):
        splits.chrono_split(series(spark, [1.0] * 8), "date").collect()
    out = splits.chrono_split(series(spark, [1.0] * 20), "date").groupBy("split").count()
    assert dict(rows(out)) == {"train": 16, "test": 4}


def test_read_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return series(spark, [1.0, 2.0])

    path = str(tmp_path / "gold")
    for _ in range(2):
        assert files.read_or_build(spark, path, build).count() == 2
    assert len(calls) == 1


def test_ar1_notes(spark):
    train = series(spark, [1.0, 2.0, 4.0, 7.0], "a").unionByName(series(spark, [1.0], "b")).unionByName(series(spark, [1.0, 2.0], "c"))
    test = series(spark, [11.0, 16.0], "a", "2020-05-01").unionByName(series(spark, [1.0], "b", "2020-05-01"))
    got = {r["k"]: r for r in scoring.score_ar1(train, test, ["k"], "date", "x", 6).collect()}
    phi = (1 * 2 + 2 * 3) / (1 + 4)
    want = [7 + 3 * phi, 7 + 3 * (phi + phi**2)]
    assert got["a"]["mape"] == pytest.approx((abs(11 - want[0]) / 11 + abs(16 - want[1]) / 16) / 2)
    assert got["a"]["n_points"] == 2
    assert got["b"]["note"] == "train too short" and got["b"]["mape"] is None
    assert got["c"]["note"] == "test set empty" and got["c"]["n_points"] == 0


def test_side_tables_join_on_their_own_dates(spark):
    base = spark.sql("SELECT DATE '2020-01-31' AS date, 1 AS v UNION ALL SELECT DATE '2020-02-01', 2")
    side = spark.sql("SELECT DATE '2020-01-31' AS date, 7 AS x UNION ALL SELECT DATE '2020-02-01', 8")
    assert {(r.v, r.x) for r in joins.attach_monthly(base, [side]).collect()} == {(1, 7), (2, 8)}
    with pytest.raises(PySparkException):
        joins.attach_monthly(base, [side.union(side.filter("x = 7"))]).collect()
