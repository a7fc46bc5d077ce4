"""Gold table to scored global model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.operators.models import PanelModel, fit_global, random_search
from panelweave.operators.runs import log_run
from panelweave.operators.scoring import mape
from panelweave.operators.splits import add_target, encode_labels, sample_weights, split_dates, tag_split
from panelweave.session import materialize

META = ("date", "region", "pc_type", "pc_price")


@dataclass
class GlobalResult:
    params: dict
    metrics: dict
    eval_model: PanelModel
    predict_model: PanelModel
    features: list[str] = field(default_factory=list)


def feature_columns(gold: DataFrame) -> list[str]:
    return ["region_encoded", "pc_type_encoded", *[c for c in gold.columns if c not in META]]


def labelled_parts(
    gold: DataFrame,
    horizon: int,
    targets: Sequence[str] | None,
    use_validation: bool = True,
    min_train: int = 20,
    min_validation: int = 5,
    min_test: int = 5,
    test_ratio: float | None = None,
    validation_ratio: float = 0.1,
) -> DataFrame:
    """Encoded rows with ``split`` and ``target``; the target never crosses a split border."""
    dates = split_dates(
        gold,
        "date",
        ["pc_type"],
        targets,
        min_train,
        min_test,
        min_validation if use_validation else None,
        test_ratio if test_ratio is not None else (0.1 if use_validation else 0.2),
        validation_ratio,
    )
    tagged = tag_split(encode_labels(gold, ["region", "pc_type"]), "date", dates)
    ahead = add_target(tagged, "pc_price", horizon, ["region", "pc_type", "split"])
    return ahead.filter(F.col("target").isNotNull())


def train_global(
    gold: DataFrame,
    horizon: int,
    targets: Sequence[str] | None = None,
    family: str = "random_forest",
    use_validation: bool = True,
    weighting: str = "balanced",
    target_region: str = fv.EUROPE,
    n_trials: int = 50,
    grid: Mapping | None = None,
    space=None,
    seed: int = 42,
    runs_path: str | None = None,
    run_name: str = "global",
    **split_args,
) -> GlobalResult:
    """Split, search, score on the test rows, then refit on everything for prediction.

    Without a validation split the search and the score share the test rows;
    the run is tagged so that such scores can be told apart.
    """
    cols = feature_columns(gold)
    parts = materialize(labelled_parts(gold, horizon, targets, use_validation, **split_args), "parts")

    def weighted(df: DataFrame) -> DataFrame:
        return sample_weights(df, "pc_type", "region", target_region, weighting)

    train = parts.filter("split = 'train'")
    test = weighted(parts.filter("split = 'test'"))
    check = weighted(parts.filter("split = 'validation'")) if use_validation else test
    best, trials = random_search(train, check, cols, "target", "weight", family, n_trials, seed, grid, space)
    seen = weighted(parts.filter("split <> 'test'"))
    evaluated = fit_global(seen, cols, "target", family, best, "weight", seed)
    scored = materialize(evaluated.transform(test).select("pc_type", "target", "prediction", "weight"), "scored")
    total = mape(scored, "target", "prediction", weight="weight").first()
    metrics = {"global_mape": total["mape"], "weighted_mape": total["weighted_mape"]}
    metrics |= {f"{r['pc_type']}_MAPE": r["mape"] for r in mape(scored, "target", "prediction", by=["pc_type"]).collect()}
    final = fit_global(weighted(parts), cols, "target", family, best, "weight", seed)
    if runs_path:
        tags = {
            "model_philosophy": "multivariate",
            "model_type": family,
            "horizon": horizon,
            "use_validation_set": use_validation,
        }
        log_run(gold.sparkSession, runs_path, f"{run_name}_eval", {**tags, "function": "evaluation"}, best, metrics)
        log_run(gold.sparkSession, runs_path, f"{run_name}_predict", {**tags, "function": "prediction"}, best, {})
    return GlobalResult(best, metrics, evaluated, final, cols)
