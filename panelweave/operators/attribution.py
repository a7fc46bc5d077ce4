"""What drives a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.operators.models import PanelModel
from panelweave.operators.scoring import floored_error


def linear_attribution(background: DataFrame, sample: DataFrame, coefs: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Top ``k`` features by mean absolute ``coef * (x - mean)``.

    ``coefs`` is (feature, coef). Means come from all background rows,
    contributions from all sample rows.
    """
    means = background.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols])
    mean = means.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("mean")) for c in cols])))
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols]
    long = sample.select(F.inline(F.array(*cells)))
    share = F.abs(F.col("coef") * (F.col("x") - F.col("mean")))
    return (
        long.join(mean, "feature")
        .join(coefs, "feature")
        .groupBy("feature")
        .agg(F.avg(share).alias("mean_abs"))
        .orderBy(F.desc("mean_abs"), "feature")
        .limit(k)
    )


def permuted(df: DataFrame, feature: str, id_cols: Sequence[str], seed: int, blocks: int) -> DataFrame:
    """The table with one column shuffled: inside hash blocks each row takes the next row's value.

    Blocks keep any one task small; the order inside a block is a hash too, so
    the neighbour is unrelated, and the multiset of values is unchanged.
    """
    ids = [F.col(c).cast("string") for c in id_cols]
    block = F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(blocks))
    place = F.xxhash64(F.lit(seed + 1), F.lit(feature), *ids)
    w = W.partitionBy("_block").orderBy("_place", *id_cols)
    src = df.select("*", block.alias("_block"), place.alias("_place"))
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = F.lead(F.struct(F.col(f"`{feature}`").alias("v")), 1).over(w)
    first = F.first(F.struct(F.col(f"`{feature}`").alias("v"))).over(whole)
    return src.withColumn(feature, F.coalesce(nxt, first)["v"]).drop("_block", "_place")


def permutation_importance(
    df: DataFrame, model: PanelModel, label: str, cols: Sequence[str], id_cols: Sequence[str], seed: int = 42, rows_per_block: int = 50_000
) -> DataFrame:
    """(feature, mape_increase): error added when a feature is shuffled. One rescoring per feature, no refit."""
    blocks = max(1, df.count() // rows_per_block)
    err = floored_error(F.col(label), F.col("prediction"))
    base = model.transform(df).agg(F.avg(err)).first()[0]
    parts = [
        model.transform(permuted(df, c, id_cols, seed, blocks))
        .agg((F.avg(err) - F.lit(base)).alias("mape_increase"))
        .select(F.lit(c).alias("feature"), "mape_increase")
        for c in cols
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("mape_increase"), "feature")
