"""Run table: tags, parameters and metrics per model run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "run_name string, logged_at timestamp, tags map<string,string>, params map<string,string>, metrics map<string,double>"
)


def log_run(spark: SparkSession, path: str, run_name: str, tags: Mapping, params: Mapping, metrics: Mapping) -> None:
    """Append one run to the table at ``path``."""
    row = (
        run_name,
        {k: str(v) for k, v in tags.items()},
        {k: str(v) for k, v in params.items()},
        {k: float(v) for k, v in metrics.items() if v is not None},
    )
    plain = "run_name string, tags map<string,string>, params map<string,string>, metrics map<string,double>"
    df = spark.createDataFrame([row], plain).withColumn("logged_at", F.current_timestamp())
    df.select("run_name", "logged_at", "tags", "params", "metrics").coalesce(1).write.mode("append").parquet(path)


def best_runs(runs: DataFrame, filters: Mapping[str, str], metric: str, n: int = 1) -> DataFrame:
    """Runs whose tags fit, smallest value of the metric first."""
    value = F.try_element_at("metrics", F.lit(metric))
    out = runs.withColumn("value", value).filter(F.col("value").isNotNull())
    for k, v in filters.items():
        out = out.filter(F.try_element_at("tags", F.lit(k)) == F.lit(str(v)))
    return out.orderBy("value", "run_name").limit(n)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
