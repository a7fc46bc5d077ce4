"""Model jobs on small made panels: contracts, not accuracy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.operators import attribution, models, runs, scoring, splits
from panelweave.plans import gold, training


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    rows = []
    for region in ("europe", "asia"):
        for kind, level in (("crystal", 2.0), ("gf10", 3.0)):
            for i in range(60):
                rows.append((dt.date(2015 + i // 12, i % 12 + 1, 1), region, kind, float(level + 0.01 * i + rng.normal(0, 0.05))))
    return spark.createDataFrame(rows, "date date, region string, pc_type string, pc_price double")


def test_global_training_logs_and_predicts(spark, panel, tmp_path):
    table = gold.long_features(panel, 3, ())
    path = str(tmp_path / "runs")
    got = training.train_global(
        table, 3, ["crystal", "gf10"], "random_forest", grid={"numTrees": 5, "maxDepth": 4}, runs_path=path, min_train=40, min_validation=10, min_test=12
    )
    assert got.params == {"numTrees": 5, "maxDepth": 4}  # a given grid comes back
    assert 0 < got.metrics["global_mape"] < 0.5 and "gf10_MAPE" in got.metrics
    best = runs.best_runs(runs.read_runs(spark, path), {"function": "evaluation", "horizon": "3"}, "weighted_mape").first()
    assert best["run_name"] == "global_eval"
    ready = splits.encode_labels(table, ["region", "pc_type"])
    out = models.predict_at(got.predict_model, ready, "2019-12-01", 3)
    assert out.count() == 4 and {r["target_date"] for r in out.collect()} == {dt.date(2020, 3, 1)}
    assert models.stitch_forecasts([out, out]).count() == 2


def test_search_keeps_the_best(panel):
    parts = training.labelled_parts(gold.long_features(panel, 3, ()), 3, ["crystal", "gf10"], min_train=40, min_validation=10, min_test=12)
    val = splits.sample_weights(parts.filter("split = 'validation'"), "pc_type", "region", "europe")
    cols = ["pc_price", "pc_price_lag_1", "pc_type_encoded"]
    space = (("maxIter", 2, 4, "int"), ("stepSize", 0.05, 0.3, "log"))
    best, trials = models.random_search(parts.filter("split = 'train'"), val, cols, "target", "weight", "xgboost", n=2, seed=3, space=space)
    assert best == min(trials, key=lambda t: t[1])[0] and len(trials) == 2
    assert models.sample_params("catboost", 3, 5) == models.sample_params("catboost", 3, 5)
    with pytest.raises(ValueError):
        models.estimator("tft", {}, "y", None, 1)


def lasso_by_descent(x, y, alpha, rounds=3000):
    z, e = x - x.mean(0), y - y.mean()
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(len(b)):
            part = z[:, j] @ (e - z @ b + z[:, j] * b[j]) / len(y)
            b[j] = np.sign(part) * max(abs(part) - alpha, 0) / (z[:, j] @ z[:, j] / len(y))
    return b


def test_lasso_matches_descent(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 4)) * [1, 5, 0.2, 2]
    y = 3 * x[:, 0] - 0.4 * x[:, 1] + rng.normal(0, 0.1, 80)
    rows = [(dt.date(2010 + i // 12, i % 12 + 1, 1), float(y[i]), *map(float, x[i])) for i in range(80)]
    df = spark.createDataFrame(rows, "date date, target double, a double, b double, c double, d double")
    got = models.fit_lasso(df, ["a", "b", "c", "d"], n_alphas=5, desired_splits=3)
    scaled = (x - x.mean(0)) / x.std(0)
    assert got.coefs == pytest.approx(list(lasso_by_descent(scaled, y, got.alpha)), abs=1e-5)
    assert {"a", "b"} <= set(got.selected)
    fit = got.transform(df).agg(F.avg(F.abs(F.col("target") - F.col("prediction")))).first()[0]
    assert fit < 0.5
    assert models._folds(80, 3) == [(20, 40), (40, 60), (60, 80)]


def test_lasso_path_and_penalty(spark):
    """Every penalty's coefficients meet the optimality conditions; the penalty has the least mean error over the folds."""
    rng = np.random.default_rng(7)
    n = 120
    base = np.cumsum(rng.normal(size=(n, 3)), axis=0)
    x = np.column_stack([base, base[:, 0] + 0.01 * rng.normal(size=n), np.ones(n), rng.normal(size=(n, 5))])  # near copies, a constant
    y = base[:, 0] - 0.5 * base[:, 1] + rng.normal(0, 0.3, n) + 100
    names = [f"f{i}" for i in range(x.shape[1])]
    order = rng.permutation(n)
    rows = [(dt.date(2000 + i // 12, i % 12 + 1, 1), float(y[i]), *map(float, x[i])) for i in order]
    df = spark.createDataFrame(rows, f"date date, target double, {', '.join(f'{c} double' for c in names)}").repartition(5)
    got = models.fit_lasso(df, names, n_alphas=30)
    scale = np.where(x.std(0) > 0, x.std(0), 1)
    z = (x - x.mean(0)) / scale
    top = np.abs(z.T @ (y - y.mean())).max() / n
    alphas = top * 10 ** (-3 * np.arange(30) / 29)

    def holds(part, target, b, alpha):
        e = (target - target.mean()) - (part - part.mean(0)) @ b
        g = (part - part.mean(0)).T @ e / len(target)
        return np.all(np.where(b != 0, np.abs(g - alpha * np.sign(b)), np.maximum(np.abs(g) - alpha, 0)) < 1e-5 * top)

    def centred(part, target):
        whole = np.column_stack([np.ones(len(target)), part, target])
        return models._Centred(whole.T @ whole)

    errors = np.zeros(30)
    for stop, end in models._folds(n, 5):
        path = models.lasso_path(centred(z[:stop], y[:stop]), alphas, 10000, 1e-6)
        assert all(holds(z[:stop], y[:stop], b, a) for b, a in zip(path, alphas, strict=True))
        for k, b in enumerate(path):
            guess = y[:stop].mean() + (z[stop:end] - z[:stop].mean(0)) @ b
            errors[k] += np.mean((y[stop:end] - guess) ** 2)
    assert got.alpha == pytest.approx(alphas[errors.argmin()])
    assert holds(z, y, np.array(got.coefs), got.alpha) and got.coefs[4] == 0
    assert got.intercept == pytest.approx(y.mean())
    with pytest.raises(ValueError, match="repeats"):
        models.fit_lasso(df.unionByName(df), names)


def test_features_known_only_in_the_last_rows_are_left_out(panel):
    """They are empty where the target is known, so they must not empty the table."""
    wide = panel.filter("region = 'europe'").groupBy("date").pivot("pc_type", ["crystal", "gf10"]).agg(F.first("pc_price"))
    table = wide.withColumn("late", F.when(F.col("date") >= F.lit("2019-11-01").cast("date"), F.lit(1.0)))
    out, fitted = models.train_per_target(table, {"crystal": "crystal"}, 3, ["crystal", "gf10", "late"], variance=0.0, alpha=1.0, n_alphas=3, desired_splits=2)
    assert out.first()["n_features_before"] == 2 and set(fitted) == {"crystal"}


def test_per_target_training_skips_short_series(panel):
    wide = panel.filter("region = 'europe'").groupBy("date").pivot("pc_type", ["crystal", "gf10"]).agg(F.first("pc_price"))
    table = gold.wide_features(wide, 3, ["crystal"], ()).withColumn("late", F.when(F.col("date") >= F.lit("2019-06-01").cast("date"), F.col("gf10")))
    out, fitted = models.train_per_target(table, {"crystal": "crystal", "late": "late"}, 3, ["crystal", "crystal_lag_1", "crystal_diff_1", "crystal_roc_3"], n_alphas=3, desired_splits=2)
    row = out.collect()
    assert [r["target"] for r in row] == ["crystal"] and set(fitted) == {"crystal"}
    assert row[0]["n_test_samples"] == 11 and row[0]["n_features_before"] == 4
    means = scoring.combine_scores(out.withColumn("n", F.col("n_test_samples")), ["horizon"], "test_mape", "n").first()
    assert means["global_mape"] == pytest.approx(row[0]["test_mape"])


def test_permutation_keeps_values(panel):
    ids = ["date", "region", "pc_type"]
    mixed = attribution.permuted(panel, "pc_price", ids, 1, 3)
    a = sorted(r[0] for r in panel.select("pc_price").collect())
    b = sorted(r[0] for r in mixed.select("pc_price").collect())
    assert a == b
    moved = panel.join(mixed.withColumnRenamed("pc_price", "p2"), ids).filter("pc_price <> p2").count()
    assert moved > 0.9 * panel.count()


def test_table_widths(spark, panel):
    side = panel.select("date").distinct().select("date", *[F.month("date").cast("double").alias(c) for c in fv.EXOGENOUS_COLUMNS])
    base = panel.join(side, "date")
    assert [len(gold.long_features(base, h).columns) for h in (3, 6, 9)] == [72, 72, 74]
    names = list(fv.BASE_ENDOGENOUS_COLUMNS)
    wide = panel.select("date").distinct().join(side, "date").select("*", *[F.lit(1.5).alias(c) for c in names])
    assert len(gold.wide_features(wide, 3, names).columns) == 208
    assert len(gold.select_type_columns(wide.select("date", F.lit(1.0).alias("gf10"), F.lit(1.0).alias("recycled_gf10_grey")), "gf10").columns) == 3
