"""Time splits, targets, supervised tables, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave import fixed_values as fv
from panelweave.functions.columns import finite
from panelweave.operators.joins import lookup_join
from panelweave.operators.ranks import ranked_values
from panelweave.operators.series import PLACE, SIZE, series
from panelweave.operators.windows import add_target, fill_both, fill_forward
from panelweave.session import materialize


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct labels numbered from 0; a null label has the first number, an empty table no rows.

    Distinct labels are cut into value ranges and numbered per range behind the ranges below, so no task sorts
    them all. The input is read once and its distinct labels are stored.
    """
    names = materialize(df.select(col).distinct(), "labels")
    known = ranked_values(names, [], col).select(col, "below")
    nulls = names.filter(F.col(col).isNull()).select(col, F.lit(0).cast("long").alias("below"))
    some = F.broadcast(nulls.agg(F.count(F.lit(1)).alias("_nulls")).withColumn("_one", F.lit(0)))
    shifted = known.withColumn("_one", F.lit(0)).join(some, "_one").select(col, (F.col("below") + F.col("_nulls")).alias("below"))
    return shifted.unionByName(nulls).select(col, F.col("below").cast("int").alias(f"{col}_encoded"))


def encode_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with one code column per label column; stores each small code table (runs a job)."""
    source = df
    for c in cols:
        df = lookup_join(df, label_codes(source, c), [c])
    return df


def _latest_date(counts: DataFrame, groups: Sequence[str], n_groups: Column, before: int, after: int) -> DataFrame:
    """Latest date with at least ``before`` earlier and ``after`` later-or-equal rows in every group.

    Counts only fall or rise along time, so each group allows one stretch of
    dates: later than the date its ``before``-th row falls on, and not later
    than the last date with ``after`` rows still to come. The stretches meet
    between the largest lower and the smallest upper end.
    """
    up = W.partitionBy(*groups).orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*groups).orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, 0)
    run = counts.filter("is_target").select(
        *groups, "d", F.sum("n").over(up).alias("past"), F.sum("n").over(down).alias("ahead")
    )
    ends = run.groupBy(*groups).agg(
        F.min(F.when(F.col("past") >= before, F.col("d"))).alias("lo"),
        F.max(F.when(F.col("ahead") >= after, F.col("d"))).alias("hi"),
    )
    if before <= 0:
        ends = ends.withColumn("lo", F.lit("0001-01-01").cast("date"))
    stretch = ends.agg(
        F.struct(
            F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.count_if(F.col("lo").isNotNull() & F.col("hi").isNotNull()).alias("k")
        ).alias("s")
    ).scalar()
    dates = counts.select("d", stretch.alias("s"), n_groups.alias("g"))
    fits = (F.col("s.k") == F.col("g")) & (F.col("g") > 0) & (F.col("d") > F.col("s.lo")) & (F.col("d") <= F.col("s.hi"))
    return dates.agg(F.max(F.when(fits, F.col("d"))).alias("d"))


def _date_at(counts: DataFrame, index: Column) -> Column:
    """Date at a 0-based position among the distinct dates (a calendar-sized list)."""
    dates = counts.agg(F.sort_array(F.collect_set("d")).alias("ds"))
    return dates.select(F.get("ds", index(F.size("ds"))).alias("d")).scalar()


def split_dates(
    df: DataFrame,
    date: str,
    groups: Sequence[str],
    targets: Sequence | None = None,
    min_train: int = 20,
    min_test: int = 5,
    min_validation: int | None = None,
    test_ratio: float = 0.2,
    validation_ratio: float = 0.1,
    fallback: str = "last",
) -> DataFrame:
    """One row (validation_date, test_date, adaptive).

    Works on row counts per (group, date), never on the rows; the counts are
    stored first (runs a job), as every step below reads them. ``targets`` are
    the group values that must be satisfied (default: all that occur). Without
    a valid date the ratio decides and ``adaptive`` is false: ``fallback`` is
    ``"last"`` (the last ``int(dates * ratio)`` dates, the first date when that
    is zero) or ``"first"`` (position ``int(dates * (1 - ratio))``).
    """
    is_target = F.lit(True) if targets is None else F.col(groups[0]).isin(list(targets))
    counts = materialize(
        df.groupBy(*groups, F.col(date).alias("d")).agg(F.count(F.lit(1)).alias("n")).withColumn("is_target", is_target), "counts"
    )
    if targets is None:
        n_groups = counts.agg(F.count_distinct(*[F.col(g) for g in groups])).scalar()
    else:
        n_groups = F.lit(len(set(targets))).cast("bigint")
    test = _latest_date(counts, groups, n_groups, 0 if min_validation else min_train, min_test)
    session = df.sparkSession
    row = session.range(1)
    if not min_validation:
        if fallback == "last":
            spare = _date_at(
                counts,
                lambda n: F.when(F.floor(n * F.lit(test_ratio)) > 0, n - F.floor(n * F.lit(test_ratio))).otherwise(0).cast("int"),
            )
        else:
            spare = _date_at(counts, lambda n: F.floor(n * F.lit(1 - test_ratio)).cast("int"))
        found = row.select(test.scalar().alias("t"))
        return found.select(
            F.lit(None).cast("date").alias("validation_date"),
            F.coalesce("t", spare).alias("test_date"),
            F.col("t").isNotNull().alias("adaptive"),
        )
    earlier = counts.filter(F.col("d") < test.scalar())
    validation = _latest_date(earlier, groups, n_groups, min_train, min_validation)
    found = row.select(validation.scalar().alias("v"), test.scalar().alias("t"))
    ok = F.col("v").isNotNull() & F.col("t").isNotNull()
    v_spare = _date_at(counts, lambda n: F.floor(n * F.lit(1 - test_ratio - validation_ratio)).cast("int"))
    t_spare = _date_at(counts, lambda n: F.floor(n * F.lit(1 - test_ratio)).cast("int"))
    return found.select(
        F.when(ok, F.col("v")).otherwise(v_spare).alias("validation_date"),
        F.when(ok, F.col("t")).otherwise(t_spare).alias("test_date"),
        ok.alias("adaptive"),
    )


def tag_split(df: DataFrame, date: str, dates: DataFrame) -> DataFrame:
    """Mark every row train, validation or test, in the column ``split``."""
    at = dates.select(F.struct("validation_date", "test_date")).scalar()
    tagged = df.withColumn("_at", at)
    split = (
        F.when(F.col(date) >= F.col("_at.test_date"), "test")
        .when(F.col(date) >= F.col("_at.validation_date"), "validation")
        .otherwise("train")
    )
    return tagged.withColumn("split", split).drop("_at")


def cutoff_split(df: DataFrame, date: str, cutoff: str = fv.CUTOFF_DATE) -> tuple[DataFrame, DataFrame]:
    """Rows before a literal date and rows from it on."""
    at = F.lit(cutoff).cast("date")
    return df.filter(F.col(date) < at), df.filter(F.col(date) >= at)


def chrono_split(
    df: DataFrame, order: str, ratio: float = 0.2, keys: Sequence[str] = (), min_train: int = fv.MIN_TRAIN_SAMPLES
) -> DataFrame:
    """Last ``max(1, floor(n * ratio))`` rows of each series are test; too short a series fails the job.

    ``order`` is a DATE that does not repeat in a series. Without keys the table is one series.
    """
    s = series(df, keys, order)
    n = F.col(SIZE)
    train = n - F.greatest(F.lit(1), F.floor(n * F.lit(ratio)))
    enough = F.when(train >= min_train, True).otherwise(
        F.raise_error(F.lit(f"not enough samples: need {min_train} training rows")).cast("boolean")
    )
    split = F.when(F.col(PLACE) <= train, "train").otherwise("test")
    return s.own(s.rows.filter(enough).withColumn("split", split))


def supervised(
    df: DataFrame, col: str, h: int, features: Sequence[str], keys: Sequence[str] = (), order: str = "date", fill: str = "both"
) -> DataFrame:
    """Complete rows of features with the value ``h`` rows ahead as ``target`` (M6).

    ``fill="both"`` fills gaps forward then backward over the whole series and
    so lets later values reach early rows; ``fill="forward"`` does not.
    """
    by = list(keys) or ["_one"]
    src = df if keys else df.withColumn("_one", F.lit(0))
    ahead = add_target(src, col, h, by, order).filter(F.col("target").isNotNull())
    clean = ahead.select(*by, order, "target", *[finite(F.col(f"`{f}`").cast("double")).alias(f) for f in features])
    how = fill_both if fill == "both" else fill_forward
    filled = clean.select(*by, order, "target", *[how(F.col(f"`{f}`"), by, order).alias(f) for f in features])
    return filled.dropna(subset=list(features)).drop("_one")


def non_empty_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with at least one value (P4). Runs one job."""
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [c for c, n in zip(cols, one, strict=True) if n]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def weight_table(
    df: DataFrame, group: str, region: str, target_region: str, method: str = "balanced", multiplier: float = fv.REGION_WEIGHT
) -> DataFrame:
    """(group, region, weight) from counts alone; the weights of all rows sum to the row count."""
    counts = df.groupBy(group, region).agg(F.count(F.lit(1)).alias("n"))
    per_group = counts.groupBy(group).agg(F.sum("n").alias("ng"))
    total = per_group.agg(F.struct(F.sum("ng").alias("rows"), F.count(F.lit(1)).alias("groups")).alias("t")).scalar()
    base = counts.join(per_group, group).withColumn("t", total)
    raw = {
        "inverse_frequency": F.lit(1.0) / F.col("ng"),
        "sqrt_inverse": F.lit(1.0) / F.sqrt("ng"),
        "balanced": F.col("t.rows") / (F.col("t.groups") * F.col("ng")),
    }
    if method not in raw:
        raise ValueError(f"invalid method: {method}; choose from {sorted(raw)}")
    boost = F.when(F.col(region) == target_region, F.lit(multiplier)).otherwise(F.lit(1.0))
    weighted = base.select(group, region, "n", F.col("t.rows").alias("total"), (raw[method] * boost).alias("w"))
    mass = weighted.agg(F.sum(F.col("w") * F.col("n"))).scalar()
    return weighted.select(group, region, (F.col("w") * F.col("total") / mass).alias("weight"))


def sample_weights(df: DataFrame, group: str, region: str, target_region: str, method="balanced", multiplier=fv.REGION_WEIGHT) -> DataFrame:
    """Rows with their weight (M5); stores the small weight table (runs a job)."""
    return lookup_join(df, weight_table(df, group, region, target_region, method, multiplier), [group, region])
