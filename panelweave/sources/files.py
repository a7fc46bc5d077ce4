"""Scans, header cleaning, file discovery and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave import fixed_values as fv
from panelweave.functions.columns import finite
from panelweave.operators.splits import cutoff_split


def clean_header(names: Iterable[str]) -> list[str]:
    """Trim, newline to space, lower case."""
    return [n.strip().replace("\n", " ").lower() for n in names]


def dedupe_header(names: Iterable[str | None]) -> list[str]:
    """Repeat copies get ``.1``, ``.2``; blanks become ``Unnamed: i``. Case-sensitive."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        base = name if name else f"Unnamed: {i}"
        k = seen.get(base, 0)
        seen[base] = k + 1
        out.append(base if k == 0 else f"{base}.{k}")
    return out


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: T.StructType | None = None,
    drop: Sequence[str] = (),
    clean: bool = False,
) -> DataFrame:
    """CSV with a header row.

    With ``schema`` the file is scanned as declared. Without it the header is
    read first (one row), because names that differ only in case or repeat
    would otherwise be renamed by position: copies get a suffix, ``drop`` names
    columns to leave out (exact case), ``clean`` normalizes the rest, and every
    column is text. The file stays splittable unless a header cell itself holds
    a newline.
    """
    base = spark.read.option("sep", sep).option("mode", "FAILFAST")
    if schema is not None:
        raw = base.schema(schema).option("header", True).csv(path)
        return raw.select(
            *[
                finite(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                for f in schema
            ]
        )
    first = base.option("header", False).option("multiLine", True).option("inferSchema", False).csv(path).head()
    if first is None:
        raise ValueError(f"no header in {path}")
    names = dedupe_header(first)
    multiline = any("\n" in n for n in names)
    positional = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = base.schema(positional).option("header", True).option("enforceSchema", True).option("multiLine", multiline).csv(path)
    kept = [(i, n) for i, n in enumerate(names) if n not in drop]
    final = dedupe_header(clean_header(n for _, n in kept)) if clean else [n for _, n in kept]
    return raw.select(*[F.col(f"c{i}").alias(n) for (i, _), n in zip(kept, final, strict=True)])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with floating NaN cells read as NULL."""
    df = spark.read.parquet(path)
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns]
    )


def first_match(spark: SparkSession, folder: str, pattern: str) -> str:
    """First path in sort order that fits the pattern; ``FileNotFoundError`` if none does."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    path = listing.agg(F.min("path")).first()[0]
    if path is None:
        raise FileNotFoundError(f"no file like {pattern} in {folder}")
    return path


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sort: Sequence[str] = ()) -> None:
    """One folder per table, replaced as a whole; ``sort`` orders files and rows by range."""
    out = df.orderBy(*sort) if sort else df
    writer = out.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def holdout(df: DataFrame, date: str, cols: Sequence[str], cutoff: str = fv.CUTOFF_DATE) -> DataFrame:
    """Rows from the cutoff on, narrowed to the named columns."""
    return cutoff_split(df, date, cutoff)[1].select(*cols)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished write lies at ``path``."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return done.getFileSystem(conf).exists(done)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], sort: Sequence[str] = ("date",)) -> DataFrame:
    """Stored table if there is a finished one, else build and store it; sorted."""
    if not table_exists(spark, path):
        write_table(build(), path)
    return spark.read.parquet(path).orderBy(*sort)
