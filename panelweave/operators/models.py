"""Spark ML fits, searches and predictions."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave import fixed_values as fv
from panelweave.operators.scoring import floored_error, mape
from panelweave.operators.splits import add_target, chrono_split, non_empty_columns, supervised
from panelweave.operators.stats import variance_filter
from panelweave.operators.unit_root import adf_filter
from panelweave.session import materialize

# Search ranges per family: (parameter, low, high, kind).
SEARCH_SPACE = {
    "xgboost": (
        ("maxIter", 100, 1000, "int"),
        ("maxDepth", 3, 12, "int"),
        ("stepSize", 0.001, 0.3, "log"),
        ("subsamplingRate", 0.6, 1.0, "float"),
        ("minInstancesPerNode", 1, 10, "int"),
        ("minInfoGain", 1e-8, 1.0, "log"),
    ),
    "lightgbm": (
        ("maxIter", 100, 1000, "int"),
        ("maxDepth", 3, 12, "int"),
        ("stepSize", 0.001, 0.3, "log"),
        ("subsamplingRate", 0.6, 1.0, "float"),
        ("minInstancesPerNode", 5, 100, "int"),
        ("minInfoGain", 1e-8, 1.0, "log"),
    ),
    "catboost": (
        ("maxIter", 100, 1000, "int"),
        ("maxDepth", 3, 10, "int"),
        ("stepSize", 0.001, 0.3, "log"),
        ("subsamplingRate", 0.6, 1.0, "float"),
        ("minInstancesPerNode", 1, 100, "int"),
        ("maxBins", 32, 255, "int"),
    ),
    "random_forest": (
        ("numTrees", 100, 500, "int"),
        ("maxDepth", 5, 20, "int"),
        ("minInstancesPerNode", 1, 10, "int"),
        ("subsamplingRate", 0.6, 1.0, "float"),
        ("minInfoGain", 0.0, 0.1, "float"),
        ("featureSubsetStrategy", ("sqrt", "log2", "all"), None, "choice"),
    ),
}


def estimator(family: str, params: Mapping, label: str, weight: str | None, seed: int):
    """Boosted trees for the three boosting families, a forest for the fourth."""
    if family not in SEARCH_SPACE:
        raise ValueError(f"unknown family: {family}; choose from {sorted(SEARCH_SPACE)}")
    kind = RandomForestRegressor if family == "random_forest" else GBTRegressor
    est = kind(featuresCol="features", labelCol=label, predictionCol="prediction", seed=seed)
    est.setParams(**params)
    return est.setWeightCol(weight) if weight else est


def sample_params(family: str, n: int, seed: int, space=None) -> list[dict]:
    """``n`` seeded draws from the search ranges."""
    rng = random.Random(seed)
    draws = []
    for _ in range(n):
        one = {}
        for name, low, high, kind in space or SEARCH_SPACE[family]:
            if kind == "int":
                one[name] = rng.randint(low, high)
            elif kind == "log":
                one[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            elif kind == "float":
                one[name] = rng.uniform(low, high)
            else:
                one[name] = rng.choice(low)
        draws.append(one)
    return draws


@dataclass
class FeaturePrep:
    """Median imputation, missing flags and vector assembly learned on the training rows.

    Leading lags are NULL by construction and the tree fits reject NULL, so a
    gap becomes the training median plus a 0/1 flag the trees can split on.
    """

    cols: list[str]
    model: PipelineModel

    @staticmethod
    def _inputs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
        safe = [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(cols)]
        flags = [F.col(f"`{c}`").isNull().cast("double").alias(f"m{i}") for i, c in enumerate(cols)]
        return df.select("*", *safe, *flags)

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> FeaturePrep:
        cols = non_empty_columns(df, cols)
        raw = [f"f{i}" for i in range(len(cols))]
        full = [f"g{i}" for i in range(len(cols))]
        flags = [f"m{i}" for i in range(len(cols))]
        steps = [
            Imputer(inputCols=raw, outputCols=full, strategy="median"),
            VectorAssembler(inputCols=[*full, *flags], outputCol="features"),
        ]
        return cls(list(cols), Pipeline(stages=steps).fit(cls._inputs(df, cols)))

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._inputs(df, self.cols))
        helper = [f"{p}{i}" for p in "fgm" for i in range(len(self.cols))]
        return out.drop(*helper)

    @property
    def names(self) -> list[str]:
        return [*self.cols, *[f"{c}_missing" for c in self.cols]]


@dataclass
class PanelModel:
    """A fitted regressor with the preparation it expects."""

    prep: FeaturePrep
    model: object
    family: str
    params: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.prep.transform(df)).drop("features")


def fit_global(
    df: DataFrame, cols: Sequence[str], label: str, family: str, params: Mapping, weight: str | None = None, seed: int = 42
) -> PanelModel:
    """One model over all series."""
    prep = FeaturePrep.fit(df, cols)
    ready = materialize(prep.transform(df).select("features", label, *([weight] if weight else [])), "fit")
    return PanelModel(prep, estimator(family, params, label, weight, seed).fit(ready), family, dict(params))


def random_search(
    train: DataFrame,
    val: DataFrame,
    cols: Sequence[str],
    label: str,
    weight: str,
    family: str,
    n: int = 50,
    seed: int = 42,
    grid: Mapping | None = None,
    space=None,
) -> tuple[dict, list[tuple[dict, float]]]:
    """Parameters with the least weighted error on ``val``, and every trial.

    Search fits do not use training weights, the score does. A given ``grid``
    is scored as the only trial and returned. Prepared rows are stored once
    and read by every trial.
    """
    prep = FeaturePrep.fit(train, cols)
    fit_rows = materialize(prep.transform(train).select("features", label), "search-train")
    val_rows = materialize(prep.transform(val).select("features", label, weight), "search-val")
    trials = []
    for params in [dict(grid)] if grid is not None else sample_params(family, n, seed, space):
        model = estimator(family, params, label, None, seed).fit(fit_rows)
        score = mape(model.transform(val_rows), label, "prediction", weight=weight).first()["weighted_mape"]
        trials.append((params, score))
    return min(trials, key=lambda t: t[1])[0], trials


@dataclass
class LassoModel:
    """Linear model on standardized features."""

    cols: list[str]
    means: list[float]
    scales: list[float]
    coefs: list[float]
    intercept: float
    alpha: float

    @property
    def selected(self) -> list[str]:
        return [c for c, b in zip(self.cols, self.coefs, strict=True) if abs(b) > fv.LASSO_COEF_THRESHOLD]

    def scaled(self, c: str):
        i = self.cols.index(c)
        return (F.col(f"`{c}`") - F.lit(self.means[i])) / F.lit(self.scales[i])

    def transform(self, df: DataFrame) -> DataFrame:
        out = F.lit(self.intercept)
        for c in self.selected:
            out = out + F.lit(self.coefs[self.cols.index(c)]) * self.scaled(c)
        return df.withColumn("prediction", out)


def _folds(n: int, desired: int) -> list[tuple[int, int]]:
    """(train rows, test end) per expanding fold."""
    k = 2 if n < 4 else max(2, min(desired, n - 1))
    size = n // (k + 1)
    return [(n - (k - i) * size, n - (k - i - 1) * size) for i in range(k)]


def _segments(df: DataFrame, order: str, folds: Sequence[tuple[int, int]]) -> Column:
    """0 for rows before the first fold's test, i + 1 for those of the test of fold i, by date.

    The dates come to the driver: one row each, so no more than the days of the calendar.
    """
    if not isinstance(df.schema[order].dataType, T.DateType):
        raise TypeError(f"{order} must be a DATE, one row each")
    counts = df.groupBy(order).agg(F.count(F.lit(1)).alias("n")).orderBy(order).collect()
    if any(r["n"] > 1 for r in counts):
        raise ValueError(f"{order} repeats; a series has one row per date")
    out = F.lit(0)
    for i, (stop, _) in enumerate(folds):
        out = F.when(F.col(order) >= F.lit(counts[stop][order]), i + 1).otherwise(out)
    return out


def _moments(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of the products of all pairs of entries, added up where the rows are."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("features"), "features")
    return RowMatrix(vectors, 0, size).computeGramianMatrix().toArray()


@dataclass
class _Centred:
    """Covariances of features and label about their means, from moments of (1, features, label)."""

    moments: np.ndarray

    def __post_init__(self):
        n = self.moments[0, 0]
        mean = self.moments[0, 1:] / n
        spread = self.moments[1:, 1:] / n - np.outer(mean, mean)
        self.x, self.xy, self.yy = spread[:-1, :-1], spread[:-1, -1], spread[-1, -1]
        self.mean_x, self.mean_y = mean[:-1], mean[-1]

    def intercept(self, coefs: np.ndarray) -> float:
        return float(self.mean_y - self.mean_x @ coefs)


def _settle(c: _Centred, alpha: float, b: np.ndarray) -> None:
    """Exact coefficients of the features in use while their signs hold; those that reach zero leave."""
    while len(on := np.flatnonzero(b)):
        sign, part = np.sign(b[on]), c.x[np.ix_(on, on)]
        # A trace of ridge gives copies of one feature a solution, which the sign rule then cuts off.
        part = part + np.eye(len(on)) * (1e-9 * np.trace(part) / len(on))
        goal = np.linalg.solve(part, c.xy[on] - alpha * sign)
        gap = np.where(np.sign(goal) == sign, 1.0, b[on] - goal)
        share = np.where(np.sign(goal) == sign, 1.0, b[on] / gap)
        step = float(share.min())
        if step >= 1.0:
            b[on] = goal
            return
        b[on] += step * (goal - b[on])
        b[on[share <= step]] = 0.0


def _descend(c: _Centred, alpha: float, coefs: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """The coefficients at a penalty, from ``coefs``, to ``tol`` times the largest gradient.

    A round moves every feature that fails its optimality condition down its own axis, then solves for
    the features in use.
    """
    b, size = coefs.copy(), np.diag(c.x)
    usable = size > 1e-12
    slack = tol * max(float(np.abs(c.xy).max(initial=0.0)), 1e-300)
    _settle(c, alpha, b)
    for _ in range(max_iter):
        gradient = c.xy - c.x @ b
        apart = np.where(b != 0, np.abs(gradient - alpha * np.sign(b)), np.maximum(np.abs(gradient) - alpha, 0.0)) * usable
        if apart.max(initial=0.0) <= slack:
            break
        for j in np.flatnonzero(apart > slack):
            pull = gradient[j] + size[j] * b[j]
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / size[j]
            gradient -= c.x[j] * (new - b[j])
            b[j] = new
        _settle(c, alpha, b)
    return b


def lasso_path(c: _Centred, alphas: Sequence[float], max_iter: int, tol: float) -> list[np.ndarray]:
    """Coefficients for falling penalties, each starting from the one before."""
    out, b = [], np.zeros(len(c.xy))
    for alpha in alphas:
        b = _descend(c, alpha, b, max_iter, tol)
        out.append(b)
    return out


def fit_lasso(
    df: DataFrame, cols: Sequence[str], order: str = "date", label: str = "target", n_alphas: int = 100, desired_splits: int = 5,
    max_iter: int = 10000, tol: float = 1e-3, threads: int = 4,
) -> LassoModel:
    """Lasso with the penalty chosen over expanding time folds.

    ``order`` is a DATE that does not repeat. Features are scaled by the population deviation of the
    training rows. One pass over the stored rows gives the moments of each stretch between folds; they
    add up to those of every fold's training rows, give its path by coordinate descent, and the squared
    error on its test rows too. What the driver holds is features squared, whatever the rows.
    """
    cols = list(cols)
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(label).alias("y"),
        *[F.avg(F.col(f"`{c}`")).alias(f"a{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    means = [first[f"a{i}"] for i in range(len(cols))]
    scales = [first[f"s{i}"] or 1.0 for i in range(len(cols))]
    folds = _folds(first["n"], desired_splits)
    unit = [((F.col(f"`{c}`") - F.lit(m)) / F.lit(s)).cast("double") for c, m, s in zip(cols, means, scales, strict=True)]
    label_ = F.col(label).cast("double") - F.lit(first["y"])
    rows = df.select(_segments(df, order, folds).alias("segment"), array_to_vector(F.array(F.lit(1.0), *unit, label_)).alias("features"))
    rows = materialize(rows, "lasso")
    with ThreadPool(threads) as pool:
        parts = pool.map(lambda i: _moments(rows.filter(F.col("segment") == i), len(cols) + 2), range(len(folds) + 1))
    whole = _Centred(sum(parts))
    top = float(np.abs(whole.xy).max(initial=0.0))
    alphas = [top * 10 ** (-3 * i / max(n_alphas - 1, 1)) for i in range(n_alphas)]
    tol = tol * 1e-3
    errors = np.zeros(n_alphas)
    for i in range(len(folds)):
        train, test = _Centred(sum(parts[: i + 1])), parts[i + 1]
        for k, b in enumerate(lasso_path(train, alphas, max_iter, tol)):
            residual = np.r_[-train.intercept(b), -b, 1.0]
            errors[k] += residual @ test @ residual / test[0, 0] / len(folds)
    best = int(np.argmin(errors))
    final = lasso_path(whole, alphas[: best + 1], max_iter, tol)[-1]
    return LassoModel(cols, means, scales, [float(b) for b in final], float(first["y"] + whole.intercept(final)), alphas[best])


RESULT_SCHEMA = (
    "target string, horizon int, n_test_samples bigint, n_features_before int, n_features_after_stationarity int, "
    "n_lasso_features int, train_mape double, test_mape double, selected_features array<string>"
)


def train_per_target(
    df: DataFrame,
    targets: Mapping[str, str],
    horizon: int,
    features: Sequence[str] | None = None,
    variance: float = fv.VARIANCE_THRESHOLD,
    alpha: float = fv.STATIONARITY_ALPHA,
    test_ratio: float = 0.2,
    n_alphas: int = 100,
    desired_splits: int = 5,
    order: str = "date",
) -> tuple[DataFrame, dict[str, LassoModel]]:
    """One lasso per target column (M15); targets with too few rows are skipped.

    The loop runs over the handful of targets; every step inside is a Spark job.
    """
    spark: SparkSession = df.sparkSession
    rows, models = [], {}
    for name, col in targets.items():
        # Features are looked for where the target is known: those filled in the last rows only are empty there.
        known = materialize(add_target(df.withColumns({"_y": F.col(f"`{col}`"), "_one": F.lit(0)}), "_y", horizon, ["_one"], order), "ahead")
        cols = non_empty_columns(known.filter(F.col("target").isNotNull()), features or [c for c in df.columns if c != order])
        known = known.drop("target", "_one")
        table = materialize(supervised(known, "_y", horizon, cols, order=order), "supervised")
        n = table.count()
        if n < fv.MIN_SERIES_SAMPLES or n - max(1, math.floor(n * test_ratio)) < fv.MIN_TRAIN_SAMPLES:
            continue
        parts = materialize(chrono_split(table, order, test_ratio), "split")
        train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
        steady = adf_filter(train, variance_filter(train, cols, variance), order, alpha)
        model = fit_lasso(train, steady, order, n_alphas=n_alphas, desired_splits=desired_splits)
        err = floored_error(F.col("target"), F.col("prediction"))
        scores = {
            r["split"]: r for r in model.transform(parts).groupBy("split").agg(F.avg(err).alias("m"), F.count(F.lit(1)).alias("n")).collect()
        }
        models[name] = model
        rows.append(
            (name, horizon, scores["test"]["n"], len(cols), len(steady), len(model.selected), scores["train"]["m"], scores["test"]["m"], model.selected)
        )
    return spark.createDataFrame(rows, RESULT_SCHEMA), models


def predict_at(model: PanelModel, df: DataFrame, at, h: int, keys: Sequence[str] = ("region", "pc_type"), date: str = "date") -> DataFrame:
    """Predictions from the features of one date for the date ``h`` months later."""
    now = df.filter(F.col(date) == (at if not isinstance(at, str) else F.lit(at).cast("date")))
    return model.transform(now).select(
        *keys, F.col(date).alias("data_date"), F.add_months(date, h).alias("target_date"), F.col("prediction").alias("predicted_price")
    )


def stitch_forecasts(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of forecasts, then the cheapest region per (target date, type)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("target_date", "pc_type").agg(F.min("predicted_price").alias("predicted_price"))
