"""Series statistics against plain numpy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import stats, unit_root
from panelweave.operators.series import BLOCK_ROWS, series


def months(n):
    return [dt.date(1990 + i // 12, i % 12 + 1, 1) for i in range(n)]


def frame(spark, **series):
    data = [(k, m, float(v)) for k, vs in series.items() for m, v in zip(months(len(vs)), vs, strict=True)]
    return spark.createDataFrame(data, "k string, date date, x double")


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(11)
    ar = [0.0]
    for e in rng.normal(size=199):
        ar.append(0.3 * ar[-1] + e)
    return {"noise": np.array(ar), "walk": np.cumsum(rng.normal(size=200)), "flat": np.ones(60), "short": rng.normal(size=10)}


def brute_adf(y):
    n, d = len(y), np.diff(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def ols(lags, start):
        x = [[1.0, y[t], *[d[t - k] for k in range(1, lags + 1)]] for t in range(start, len(d))]
        x, z = np.array(x), d[start:]
        beta = np.linalg.solve(x.T @ x, x.T @ z)
        return x, beta, float(((z - x @ beta) ** 2).sum())

    def aic(lags):
        x, _, rss = ols(lags, most)
        m = len(x)
        loglik = -m / 2 * (math.log(2 * math.pi) + math.log(rss / m) + 1)
        return -2 * loglik + 2 * x.shape[1]

    lags = min(range(most + 1), key=aic)
    x, beta, rss = ols(lags, lags)
    se = math.sqrt(np.linalg.inv(x.T @ x)[1, 1] * rss / (len(x) - x.shape[1]))
    return beta[1] / se, lags


def test_unit_root(spark, walks):
    got = {r["feature"]: r for r in unit_root.adf_table(frame(spark, **walks), "k", "date", "x").collect()}
    for k in ("noise", "walk"):
        tau, lags = brute_adf(walks[k])
        assert got[k]["statistic"] == pytest.approx(tau) and got[k]["lags"] == lags
    assert got["noise"]["p_value"] < 0.01 < 0.05 < got["walk"]["p_value"]
    assert got["flat"]["p_value"] is None and got["short"]["p_value"] is None


def test_p_values(spark):
    rows = spark.createDataFrame([(-3.43, 0.010), (-2.86, 0.050), (-2.57, 0.099), (-20.0, 0.0), (3.0, 1.0)], "tau double, p double")
    for row in rows.withColumn("got", unit_root.p_value(F.col("tau"))).collect():
        assert row["got"] == pytest.approx(row["p"], abs=5e-4)


def test_normal_distribution(spark):
    zs = [-15.0, -12.0, -8.0, -3.0, -1.0, 0.0, 0.5, 2.0, 6.0, 12.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", unit_root.normal_cdf(F.col("z")).alias("p")).collect()
    for z, p in rows:
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-14)


def test_unit_root_edges(spark, walks):
    t = np.arange(60.0)
    got = {r["k"]: r for r in unit_root.unit_root(frame(spark, line=3 * t, flat=0 * t, short=t[:5], big=1e9 + walks["walk"]), ["k"], "date", "x").collect()}
    assert all(got[k]["statistic"] is None and got[k]["p_value"] is None for k in ("line", "flat", "short"))
    tau, lags = brute_adf(walks["walk"])
    assert got["big"]["statistic"] == pytest.approx(tau, rel=1e-5) and got["big"]["lags"] == lags
    fixed = unit_root.unit_root(frame(spark, walk=walks["walk"]), ["k"], "date", "x", lags=2).first()
    d = np.diff(walks["walk"])
    x = np.array([[1.0, walks["walk"][i], d[i - 1], d[i - 2]] for i in range(2, len(d))])
    beta = np.linalg.lstsq(x, d[2:], rcond=None)[0]
    rss = ((d[2:] - x @ beta) ** 2).sum()
    assert fixed["statistic"] == pytest.approx(beta[1] / math.sqrt(np.linalg.inv(x.T @ x)[1, 1] * rss / (len(x) - 4)))
    empty = unit_root.unit_root(frame(spark, walk=walks["walk"]).limit(0), ["k"], "date", "x")
    assert empty.count() == 0


def test_series_in_blocks(spark):
    n = 2 * BLOCK_ROWS + 700
    first = dt.date(1990, 1, 1)
    df = spark.range(n).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("x"))
    s = series(df.repartition(7), [], "date", before=5, after=3)
    rows = s.own(s.rows.select("*", F.lag("x", 5).over(s.window).alias("back"), F.lead("x", 3).over(s.window).alias("ahead"), F.col("_place").alias("at"), F.col("_size").alias("n")))
    got = sorted((r["x"], r["back"], r["ahead"], r["at"], r["n"]) for r in rows.collect())
    want = [(float(i), float(i - 5) if i >= 5 else None, float(i + 3) if i + 3 < n else None, i + 1, n) for i in range(n)]
    assert got == want
    assert series(df.limit(0), [], "date").rows.count() == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_series_refuses_repeated_dates(spark, keys):
    df = frame(spark, a=[1, 2, 3])
    with pytest.raises(Exception, match="repeats"):
        series(df.unionByName(df.limit(1)), keys, "date").rows.count()
    with pytest.raises(TypeError):
        series(df.withColumn("date", F.to_timestamp("date")), keys, "date")


def test_filters(spark, walks):
    wide = frame(spark, **{k: walks[k] for k in ("noise", "walk")}).groupBy("date").pivot("k", ["noise", "walk"]).agg(F.first("x"))
    assert unit_root.adf_filter(wide, ["noise", "walk"], "date") == ["noise"]
    assert unit_root.adf_filter(wide, ["walk"], "date") == ["walk"]  # nothing left: keep all
    flat = wide.withColumn("flat", F.lit(1.0))
    assert stats.variance_filter(flat, ["noise", "flat"]) == ["noise"]
    assert stats.variance_filter(flat, ["flat"]) == ["flat"]


def test_condition_on_the_p_value_does_not_repeat_the_sweep(spark, walks):
    rows = unit_root.adf_table(frame(spark, **walks), "k", "date", "x").filter(F.col("p_value") <= 0.05)
    assert "1.0E-10" not in rows._jdf.queryExecution().optimizedPlan().toString()  # SINGULAR, in every sweep


def test_partial_autocorrelation(spark, walks):
    y = walks["noise"] - walks["noise"].mean()
    rho = np.array([(y[k:] * y[: len(y) - k]).sum() for k in range(9)]) / (y * y).sum()
    want = [1.0]
    for k in range(1, 9):
        toeplitz = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        want.append(np.linalg.solve(toeplitz, rho[1 : k + 1])[-1])
    rows = stats.pacf(stats.acf(frame(spark, noise=walks["noise"]), ["k"], "date", "x", 8), ["k"]).orderBy("lag").collect()
    assert [r["pacf"] for r in rows] == pytest.approx(want)


def test_decomposition_recovers_parts(spark):
    t = np.arange(60)
    season = np.tile([3, 1, -2, 0, 4, -1, -3, 2, -4, 1, 0, -1], 5)
    rows = stats.decompose_additive(frame(spark, s=5 + 0.5 * t + season), ["k"], "date", "x").orderBy("date").collect()
    assert [r["trend"] for r in rows] == pytest.approx(list(5 + 0.5 * t))
    assert [r["seasonal"] for r in rows] == pytest.approx(list(season.astype(float)))
    assert max(abs(r["resid"]) for r in rows) < 1e-9


def test_lag_sign(spark):
    rng = np.random.default_rng(2)
    driver = rng.normal(size=80)
    target = np.concatenate([rng.normal(size=2), driver[:-2]])  # the driver leads by two months
    data = [(m, float(a), float(b)) for m, a, b in zip(months(80), target, driver, strict=True)]
    df = spark.createDataFrame(data, "date date, y double, z double")
    best = stats.best_lag(stats.lagged_corr(df, "y", ["z"], range(-6, 7), "date")).first()
    assert best["best_lag"] == -2 and best["r"] == pytest.approx(1.0)
