"""Registration and small helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 4
# Sums of a few decimals often end exactly between two rounded values, where the
# order of addition decides. The nudge moves such ties to the same side in both engines.
NUDGE = 3e-8


class Tables:
    """Driver tables by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Every double column rounded; the final 0.0 turns a negative zero positive."""
    return df.select(
        *[
            F.expr(f"round(`{f.name}` + {NUDGE:e}D, {digits}) + 0.0D AS `{f.name}`")
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(Tables(spark, folder)))

        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def sql_with(ctes: Sequence[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body


def r(*exprs: str) -> str:
    """Rounded SQL outputs: ``"x"`` or ``"expr AS x"``."""
    out = []
    for e in exprs:
        expr, _, name = e.rpartition(" AS ")
        expr, name = (expr, name) if expr else (e, e)
        out.append(f"round(CAST({expr} AS DOUBLE) + {NUDGE}, {DIGITS}) + 0.0 AS {name}")
    return ", ".join(out)
