"""Product price tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave import fixed_values as fv
from panelweave.functions.columns import ratio, row_min


def product_price(df: DataFrame, average: str, sites: Sequence[str]) -> DataFrame:
    """Average price, or the cheapest site where it is missing, with its origin."""
    own = F.col(average)
    return df.select(
        "*",
        F.coalesce(own, row_min(sites)).alias("product_price"),
        F.when(own.isNotNull(), "average").otherwise("min_website").alias("price_source"),
    )


def monthly_with_source(df: DataFrame, date: str, price: str = "product_price", source: str = "price_source") -> DataFrame:
    """Monthly mean over every month from first to last.

    A month is ``average`` when all its days are; a month without days counts as such.
    """
    daily = df.select(F.trunc(date, "MM").alias("date"), F.col(price).alias("_p"), F.col(source).alias("_s"))
    months = daily.groupBy("date").agg(F.avg("_p").alias(price), F.bool_and(F.col("_s") == "average").alias("_all"))
    span = months.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    spine = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("date"))
    flag = F.when(F.coalesce(F.col("_all"), F.lit(True)), "average").otherwise("includes_min")
    return spine.join(months, "date", "left").select("date", price, flag.alias(source))


SCENARIOS = {
    f"{kind}_{tier}": (fv.BASE_COST, fv.SENSITIVITY[kind], fv.MARKUP[tier])
    for kind in (fv.REGULAR, fv.GREEN)
    for tier in ("base", "premium")
}


def cost_plus(
    df: DataFrame, prices: Mapping[str, str], scenarios: Mapping[str, tuple[float, float, float]] | None = None
) -> DataFrame:
    """One recommended-price column per scenario; ``prices`` maps regular/green to a price column."""
    cols = []
    for name, (base, sens, markup) in (scenarios or SCENARIOS).items():
        p = F.col(prices[name.rsplit("_", 1)[0]])
        cost = F.lit(base) + (p - F.lit(fv.REFERENCE_PRICE)) * F.lit(sens)
        cols.append((cost * F.lit(1 + markup)).alias(f"price_{name}"))
    return df.select("*", *cols)


def scenario_summary(
    forecast: DataFrame, history: DataFrame, date: str, price: str, scenarios: Sequence[str], months: int = 6, source: str = "price_source"
) -> DataFrame:
    """Mean, range and ratio to the mean of the last months of history, per scenario.

    Of the history only months count whose price is an average on all days.
    """
    recent = history.filter(F.col(source) == "average").orderBy(F.desc(date)).limit(months).agg(F.avg(price)).scalar()
    aggs = [F.avg(s).alias(f"{s}@mean") for s in scenarios]
    aggs += [F.min(s).alias(f"{s}@min") for s in scenarios] + [F.max(s).alias(f"{s}@max") for s in scenarios]
    one = forecast.agg(*aggs).withColumn("_h", recent)
    cells = [
        F.struct(
            F.lit(s).alias("scenario"),
            F.col(f"`{s}@mean`").alias("mean"),
            F.col(f"`{s}@min`").alias("low"),
            F.col(f"`{s}@max`").alias("high"),
            ratio(F.col(f"`{s}@mean`"), F.col("_h")).alias("ratio_to_recent"),
        )
        for s in scenarios
    ]
    return one.select(F.inline(F.array(*cells)))


def material_cost(df: DataFrame, price: str, weight: float = fv.PRODUCT_WEIGHT_KG, share: float = fv.PRODUCT_CONTENT_SHARE) -> DataFrame:
    """Material mass of one unit and its cost at a price per kilo."""
    mass = F.lit(weight * share)
    return df.select("*", mass.alias("material_kg"), (mass * F.col(price)).alias("material_cost"))
