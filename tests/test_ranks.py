"""Distributed ranks and quantiles against numpy, with one group holding most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import profile, ranks, stats

PROBS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": np.round(rng.normal(0, 50, 20_000), 1), "ties": np.repeat([1.0, 2.0, 2.5], [500, 3, 40]), "one": np.array([7.0])}
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    return groups, spark.createDataFrame(data, "k string, v double").repartition(6)


def test_quantiles_match(skewed):
    groups, df = skewed
    got = {r["k"]: r for r in ranks.quantiles(df, ["k"], "v", PROBS).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p))


def test_brackets_that_miss_are_widened(skewed):
    groups, df = skewed
    got = {r["k"]: r for r in ranks.quantiles(df, ["k"], "v", PROBS, accuracy=20, margin=0.001).collect()}
    for k, vs in groups.items():
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p))
    assert ranks.quantiles(df.limit(0), ["k"], "v", PROBS).count() == 0
    assert set(ranks.quantiles(df.limit(0), [], "v", PROBS).first()) == {None}


def test_a_value_in_a_third_of_the_rows(spark):
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 1e4).alias("v"))
    want = np.array([r[0] for r in df.collect()])
    got = ranks.quantiles(df, [], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}).first()
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q99", 0.99)):
        assert got[name] == pytest.approx(np.quantile(want, p))
    inside = ranks._inside(df, [], "v", [0.5], ranks.MARGIN, ranks.ACCURACY)
    assert inside.count() < 1_000  # of about 45,000 distinct values


def test_ranks_match(skewed):
    groups, df = skewed
    rows = ranks.ranked_values(df, ["k"], "v").collect()
    for k, vs in groups.items():
        values, counts = np.unique(vs, return_counts=True)
        mine = {r["v"]: (r["n"], r["below"], r["total"]) for r in rows if r["k"] == k}
        assert mine == {v: (n, b, len(vs)) for v, n, b in zip(values, counts, np.cumsum(counts) - counts, strict=True)}


def test_whole_table_and_describe(skewed):
    groups, df = skewed
    every = np.concatenate(list(groups.values()))
    got = profile.describe_exact(df, "v", PROBS).first()
    assert got["n"] == len(every) and got["std"] == pytest.approx(every.std(ddof=1))
    assert got["p95"] == pytest.approx(np.quantile(every, 0.95))


def test_ranges_spread_the_hot_group(skewed):
    _, df = skewed
    counts = df.filter("k = 'hot'").filter(F.col("v").isNotNull())
    assert ranks.ranked_values(counts, [], "v", ranges=4).agg(F.max("below")).first()[0] < 20_000
    assert ranks.quantiles(counts, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.median(skewed[0]["hot"]))


def test_spearman_against_pandas(spark):
    rng = np.random.default_rng(9)
    import pandas as pd

    pdf = pd.DataFrame({"a": rng.integers(0, 9, 400).astype(float), "b": rng.normal(size=400), "c": np.ones(400)})
    pdf["b"] += pdf["a"] / 3
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in pdf.itertuples(index=False)], "a double, b double, c double")
    want = pdf["a"].rank().where(pdf["b"].notna())
    both = pdf.dropna()
    want = np.corrcoef(both["a"].rank(), both["b"].rank())[0, 1]
    got = {(r["a"], r["b"]): r["r"] for r in stats.corr_pairs(df, ["a", "b", "c"], "spearman").collect()}
    assert got["a", "b"] == pytest.approx(want)
    assert got["a", "c"] is None


def test_rank_correlation_sketches_both_columns_once(spark, monkeypatch):
    sketched = []
    monkeypatch.setattr(stats, "rank_cuts", lambda df, keys, values, cuts=ranks.rank_cuts: sketched.append(values) or cuts(df, keys, values))
    monkeypatch.setattr(ranks, "rank_cuts", None)
    df = spark.createDataFrame([(float(i % 7), float(i * i % 50)) for i in range(300)], "a double, b double")
    want = df.toPandas().rank().corr().loc["a", "b"]
    assert stats.corr_pairs(df, ["a", "b"], "spearman").first()["r"] == pytest.approx(want)
    assert sketched == [["x", "y"]]


def test_place_among_cut_points(spark):
    cuts = [1.0, 2.0, 2.0, 2.0, 5.0]
    rows = spark.createDataFrame([(v, cuts) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 5.0, 9.0)], "v double, _cuts array<double>")
    got = rows.select("v", ranks._range_of("v", 64).alias("reached"), ranks._range_of("v", 64, passed=True).alias("passed")).collect()
    assert {(r["reached"], r["passed"]) == (np.searchsorted(cuts, r["v"], "right"), np.searchsorted(cuts, r["v"], "left")) for r in got} == {True}


def test_ranks_of_a_hot_value(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    x = np.where(rng.random(6000) < 0.35, 5.0, np.round(rng.normal(5, 3, 6000), 1))
    pdf = pd.DataFrame({"k": "a", "x": x, "y": rng.permutation(6000).astype(float)})
    pdf = pd.concat([pdf, pd.DataFrame({"k": "b", "x": [1.0] * 40, "y": range(40)}), pd.DataFrame({"k": "c", "x": [3.0], "y": [1.0]})])
    df = spark.createDataFrame(list(pdf.itertuples(index=False, name=None)), "k string, x double, y double").withColumn("w", F.lit(1).cast("long"))
    rows = ranks.with_average_ranks(df, ["k"], "x", "w", "y", "rank", ranges=16)
    got = {(r["k"], r["y"]): r["rank"] for r in rows.collect()}
    want = pdf.groupby("k")["x"].rank()
    assert got == {(k, y): rank for k, y, rank in zip(pdf["k"], pdf["y"], want, strict=True)}
    weighted = df.groupBy("k", "x").agg(F.sum("w").alias("w"), F.min("y").alias("y"))
    light = {(r["k"], r["x"]): r["rank"] for r in ranks.with_average_ranks(weighted, ["k"], "x", "w", "y", "rank", ranges=16).collect()}
    assert light == {(k, x): rank for k, x, rank in zip(pdf["k"], pdf["x"], want, strict=True)}
    assert ranks.with_average_ranks(df.limit(0), ["k"], "x", "w", "y", "rank").count() == 0
