"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space, and what lies between them.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that one Arrow batch may hold; texts are long, so batches stay small.
BATCH_ROWS = 512
#: Bytes of texts in one Arrow batch, beyond which it ends early.
BATCH_BYTES = 8 << 20
#: Folds of labelled rows; fold 0 is held out.
FOLDS = 5


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the memory of a Python worker: no more than ``rows`` texts and about 8 MB in one Arrow batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document belongs to the fold that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def numbered(written: DataFrame, name: str = "row_no") -> DataFrame:
    """``written``, as ``materialize`` returned it, with rows numbered from 0 in the order of its files.

    What the driver gets is one count for each file, as many as tasks wrote. These few rows go to every
    task; their size is not known to the optimizer, which would else shuffle ``written`` to meet them.
    """
    name_of, place_of, start_of = (free_name(written, n) for n in ("file", "place", "start"))
    file = F.col("_metadata.file_name")
    counts = written.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, at = [], 0
    for row in sorted(counts, key=lambda r: (int(r["file"].split("-")[1]), r["file"])):
        starts.append((row["file"], at))
        at += row["n"]
    first = written.sparkSession.createDataFrame(starts, f"{name_of} string, {start_of} long")
    placed = written.select("*", file.alias(name_of), F.col("_metadata.row_index").alias(place_of))
    own = [F.col(f"`{c}`") for c in written.columns]
    return placed.join(F.broadcast(first), name_of).select(*own, (F.col(start_of) + F.col(place_of)).alias(name))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
