"""Spark ML jobs (M10-M15, M17, M19, M20): checked by rows and by tests, not by SQL."""

from pyspark.sql import functions as F

from panelweave.catalog.base import Tables, query
from panelweave.catalog.standins import TYPES, panel, regional_wide
from panelweave.operators import attribution, models, scoring, splits
from panelweave.operators.runs import read_runs
from panelweave.plans import gold, training
from panelweave.session import materialize, scratch_path

# Small fits: the search ranges of the library are far larger.
SMALL_BOOST = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1}
SMALL_FOREST = {"numTrees": 10, "maxDepth": 5}
SMALL_SPACE = (("numTrees", 5, 15, "int"), ("maxDepth", 3, 6, "int"))


def features(t: Tables, h: int):
    """Gold rows without side tables, stored once per query."""
    return materialize(gold.long_features(panel(t), h, ()), f"gold{h}")


def parts(t: Tables, h: int):
    return materialize(training.labelled_parts(features(t, h), h, TYPES, min_train=100, min_validation=30, min_test=30), "parts")


def scored_fit(t: Tables, family: str, params: dict):
    """Weighted fit on the earlier rows, score on the latest."""
    rows = parts(t, 3)
    weighted = splits.sample_weights(rows, "pc_type", "region", "EUROPE")
    cols = training.feature_columns(rows.drop("split", "target", "region_encoded", "pc_type_encoded"))
    model = models.fit_global(weighted.filter("split <> 'test'"), cols, "target", family, params, "weight")
    return scoring.mape(model.transform(weighted.filter("split = 'test'")), "target", "prediction", ["pc_type"], "weight")


@query("m10_boosted_xgboost_ranges")
def m10(t: Tables):
    return scored_fit(t, "xgboost", {**SMALL_BOOST, "minInstancesPerNode": 2})


@query("m10_boosted_lightgbm_ranges")
def m10_light(t: Tables):
    return scored_fit(t, "lightgbm", {**SMALL_BOOST, "subsamplingRate": 0.8})


@query("m10_boosted_catboost_ranges")
def m10_cat(t: Tables):
    return scored_fit(t, "catboost", {**SMALL_BOOST, "maxBins": 64})


@query("m11_random_forest")
def m11(t: Tables):
    return scored_fit(t, "random_forest", SMALL_FOREST)


@query("m12_random_search")
def m12(t: Tables):
    rows = parts(t, 3)
    cols = training.feature_columns(rows.drop("split", "target", "region_encoded", "pc_type_encoded"))
    val = splits.sample_weights(rows.filter("split = 'validation'"), "pc_type", "region", "EUROPE")
    _, trials = models.random_search(
        rows.filter("split = 'train'"), val, cols, "target", "weight", "random_forest", n=3, seed=7, space=SMALL_SPACE
    )
    table = [(i, p["numTrees"], p["maxDepth"], s) for i, (p, s) in enumerate(trials)]
    return t.spark.createDataFrame(table, "trial int, num_trees int, max_depth int, weighted_mape double")


@query("m13_global_training")
def m13(t: Tables):
    path = scratch_path(t.spark, "runs")
    training.train_global(
        features(t, 3),
        3,
        TYPES,
        "random_forest",
        target_region="EUROPE",
        n_trials=2,
        space=SMALL_SPACE,
        runs_path=path,
        min_train=100,
        min_validation=30,
        min_test=30,
    )
    runs = read_runs(t.spark, path)
    return runs.select("run_name", F.explode_outer("metrics").alias("metric", "value"))


def category_table(t: Tables):
    """Two category series of one region with their wide features."""
    wide = regional_wide(t, "EUROPE")
    pair = wide.select("date", F.col("pc_standard_best_price").alias("regular"), F.col("pc_economy_best_price").alias("green"))
    return materialize(gold.wide_features(pair, 3, ["regular", "green"], ()), "category")


@query("m14_lasso_path")
def m14(t: Tables):
    table = category_table(t)
    cols = splits.non_empty_columns(table, [c for c in table.columns if c != "date"])
    rows = materialize(splits.supervised(table, "green", 3, cols), "supervised")
    model = models.fit_lasso(rows, cols)
    pairs = list(zip(model.cols, model.coefs, strict=True))
    return t.spark.createDataFrame(pairs, "feature string, coef double")


@query("m15_lasso_per_category")
def m15(t: Tables):
    results, _ = models.train_per_target(category_table(t), {"regular": "regular", "green": "green"}, 3)
    return results.withColumn("selected_features", F.concat_ws(",", "selected_features"))


@query("m17_permutation_importance")
def m17(t: Tables):
    rows = parts(t, 3)
    cols = ["region_encoded", "pc_type_encoded", "pc_price", "pc_price_lag_1", "pc_price_rolling_mean_3", "month_sin"]
    model = models.fit_global(rows.filter("split <> 'test'"), cols, "target", "random_forest", SMALL_FOREST)
    return attribution.permutation_importance(rows.filter("split = 'test'"), model, "target", cols, ["date", "region", "pc_type"])


@query("m19_predict_at_date")
def m19(t: Tables):
    table = splits.encode_labels(features(t, 3), ["region", "pc_type"])
    rows = parts(t, 3)
    cols = ["region_encoded", "pc_type_encoded", "pc_price", "pc_price_lag_1", "pc_price_lag_3", "month_sin"]
    model = models.fit_global(rows, cols, "target", "random_forest", SMALL_FOREST)
    return models.predict_at(model, table, table.agg(F.max("date")).scalar(), 3)


@query("m20_stitched_forecast")
def m20(t: Tables):
    cols = ["region_encoded", "pc_type_encoded", "pc_price", "pc_price_lag_1", "pc_price_rolling_mean_12", "month_sin"]
    out = []
    # horizon and the ages, in months before the latest date, of the feature rows it predicts from
    for h, ages in ((3, (2, 1, 0)), (6, (2, 1, 0)), (9, (2, 1, 0))):
        table = materialize(splits.encode_labels(features(t, h), ["region", "pc_type"]), "encoded")
        ahead = splits.add_target(table, "pc_price", h, ["region", "pc_type"]).filter(F.col("target").isNotNull())
        model = models.fit_global(ahead, cols, "target", "random_forest", SMALL_FOREST)
        last = table.agg(F.max("date")).scalar()
        out += [models.predict_at(model, table, F.add_months(last, -a), h) for a in ages]
    return models.stitch_forecasts(out)
