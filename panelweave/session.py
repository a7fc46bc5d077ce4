"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "panelweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on and UTC dates.

    ``conf`` keys use ``__`` for dots, e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) is one made up here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = _own_dir()
    return folder.rstrip("/")


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="panelweave-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/panelweave/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing a table to shared storage and reading it back.

    Survives executor loss, and the file sizes give the optimizer true
    statistics, so a small result is broadcast and a large one is not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
