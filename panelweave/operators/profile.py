"""Data profiling (A1, A11-A28) and ordered reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.columns import ratio
from panelweave.operators.ranks import quantiles


def date_statistics(df: DataFrame, date: str, col: str, suffix: str) -> DataFrame:
    """Min, max, mean, median and sample deviation per date (A1).

    The mergeable four come from one aggregation; the median takes the ranked
    path, so one very full date does not land in a single buffer.
    """
    base = df.groupBy(date).agg(
        F.min(col).alias(f"min_{suffix}"),
        F.max(col).alias(f"max_{suffix}"),
        F.avg(col).alias(f"avg_{suffix}"),
        F.stddev_samp(col).alias(f"std_{suffix}"),
    )
    middle = quantiles(df, [date], col, {f"median_{suffix}": 0.5})
    return base.join(middle, date, "left").select(
        date, *[f"{s}_{suffix}" for s in ("min", "max", "avg", "median", "std")]
    )


def coverage(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(F.lit(1)).alias("rows")
    )


def mapping_audit(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many partners each value has, in both directions; more than one breaks a 1:1 map."""
    pairs = df.select(a, b).distinct()
    sides = [
        pairs.groupBy(F.col(x).cast("string").alias("value"))
        .agg(F.count(y).alias("partners"))
        .select(F.lit(f"{x}->{y}").alias("direction"), "value", "partners")
        for x, y in ((a, b), (b, a))
    ]
    return sides[0].unionByName(sides[1])


def onboarding(df: DataFrame, key: str, date: str) -> DataFrame:
    """Keys first seen in each month: count, sorted list, running total.

    ``key`` must be a dictionary-sized column (country, type); the list is
    bounded by its number of values. The running total works on one row per
    month, which the calendar bounds.
    """
    first = df.groupBy(key).agg(F.trunc(F.min(date), "MM").alias("first_month"))
    per_month = first.groupBy("first_month").agg(
        F.count(F.lit(1)).alias("added"), F.sort_array(F.collect_list(key)).alias("added_keys")
    )
    w = W.partitionBy(F.lit(0)).orderBy("first_month").rowsBetween(W.unboundedPreceding, 0)
    return per_month.withColumn("cumulative", F.sum("added").over(w))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percentage per column, from a single pass."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    long = one.unpivot(["_n"], [F.col(f"`{c}`") for c in cols], "column_name", "missing_count")
    return long.select(
        "column_name", "missing_count", (ratio(F.col("missing_count"), F.col("_n")) * 100).alias("missing_pct")
    )


def rows_with_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    test = F.lit(False)
    for c in cols or df.columns:
        test = test | F.col(f"`{c}`").isNull()
    return df.filter(test)


def describe_exact(df: DataFrame, col: str, probs: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, extremes and exact interpolated percentiles."""
    base = df.groupBy(*keys).agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )
    marks = quantiles(df, keys, col, probs)
    if keys:
        return base.join(marks, list(keys), "left")
    packed = marks.select(F.struct(*probs).alias("q")).scalar()
    return base.withColumn("_q", packed).select(*base.columns, *[F.col(f"_q.{p}").alias(p) for p in probs])


def calendar_profile(df: DataFrame, date: str, col: str, part: str) -> DataFrame:
    """Mean, median and deviation by month of year or by year."""
    unit = {"month": F.month, "year": F.year}[part](F.col(date)).alias(part)
    src = df.select(unit, F.col(col).alias("_v"))
    base = src.groupBy(part).agg(
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )
    return base.join(quantiles(src, [part], "_v", {"median": 0.5}), part, "left")


def year_month_matrix(df: DataFrame, date: str, col: str) -> DataFrame:
    names = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    wide = (
        df.select(F.year(date).alias("year"), F.month(date).alias("_m"), F.col(col).alias("_v"))
        .groupBy("year")
        .pivot("_m", list(range(1, 13)))
        .agg(F.avg("_v"))
    )
    return wide.withColumnsRenamed({str(i + 1): n for i, n in enumerate(names)})


def extreme_rows(df: DataFrame, by: Sequence[str], key: str, col: str) -> DataFrame:
    """Key and value of the smallest and largest row per group; ties go to the smallest key.

    One aggregation serves both ends, so the min rows and max rows need no join.
    """
    seen = df.filter(F.col(col).isNotNull())
    low = F.min(F.struct(F.col(col).alias("v"), F.col(key).alias("k")))
    high = F.min(F.struct((-F.col(col)).alias("v"), F.col(key).alias("k")))
    return (
        seen.groupBy(*by)
        .agg(low.alias("_lo"), high.alias("_hi"))
        .select(
            *by,
            F.col("_lo.k").alias(f"min_{key}"),
            F.col("_lo.v").alias(f"min_{col}"),
            F.col("_hi.k").alias(f"max_{key}"),
            (-F.col("_hi.v")).alias(f"max_{col}"),
        )
    )


def frequency(df: DataFrame, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """Counts, most common first; ``k`` keeps the top of the list."""
    out = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols)
    return out if k is None else out.limit(k)


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between the extremes, the last bin closed on the right."""
    lim = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("b")).scalar()
    src = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("_v"), lim.alias("_b"))
    width = (F.col("_b.hi") - F.col("_b.lo")) / bins
    place = F.coalesce(F.floor(ratio(F.col("_v") - F.col("_b.lo"), width)), F.lit(0))
    bucket = F.greatest(F.lit(0), F.least(F.lit(bins - 1), place))
    return src.groupBy(bucket.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("smallest"), F.max("_v").alias("largest")
    )


def group_summary(df: DataFrame, keys: Sequence[str], col: str, digits: int = 2) -> DataFrame:
    aggs = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return df.groupBy(*keys).agg(
        *[F.round(f(col), digits).alias(n) for n, f in aggs.items()], F.count(col).alias("n")
    )


def variation(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Coefficient of variation in percent."""
    return df.groupBy(*keys).agg(*[(ratio(F.stddev_samp(c), F.avg(c)) * 100).alias(f"{c}_cv") for c in cols])


BOX = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}


def boxplot(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Five-number summary per group, exact."""
    return quantiles(df, keys, col, BOX)


def latest_extremes(df: DataFrame, date: str, key: str, col: str, k: int = 5) -> DataFrame:
    """Highest and lowest ``k`` rows of the latest period (O3)."""
    latest = df.filter(F.col(date) == df.agg(F.max(date)).scalar()).select(date, key, col)
    top = latest.orderBy(F.desc(col), key).limit(k).withColumn("side", F.lit("high"))
    low = latest.orderBy(col, key).limit(k).withColumn("side", F.lit("low"))
    return top.unionByName(low)


def missing_values(df: DataFrame, col: str, expected: Sequence[str]) -> DataFrame:
    """Expected values the column never holds."""
    want = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in expected])).alias(col))
    return want.join(df.select(col).distinct(), col, "left_anti")


def largest_group(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Most records any key has within one month."""
    sizes = df.groupBy(*keys, F.trunc(date, "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("max_records"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order``; merged map-side, so hot keys shuffle little."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.min(F.struct(*[F.col(c) for c in [*order, *rest]])).alias("_r")
    out = df.groupBy(*keys).agg(pick)
    return out.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]])
