"""Whitened embeddings by distributed block matrices.

Entries are put on a grid of whole numbers, so that counts and sums are exact and a centred row is an
exact fraction rounded once. Centred rows get consecutive indices and become blocks of a Spark MLlib
BlockMatrix; its transpose times itself is the scatter matrix, whose eigenvectors are found on the
driver (dimensions squared, whatever the rows); a further multiplication projects the rows.

Rows are dealt with in slabs of a fixed number of entries: one slab bounds what a task of a block
multiplication may hold, and several slabs run at a time. Every slab is read again from the written
rows, so a lost executor costs only the blocks it held.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.shared import numbered
from panelweave.session import materialize, scratch_path

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries of a block, blocks of a slab, blocks one task multiplies, slabs at a time.
BLOCK_ENTRIES, SLAB_BLOCKS, TASK_BLOCKS, SLABS_AT_ONCE = 1 << 16, 256, 8, 4

RESULT = "vec_id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """Mean as ``sums / n``; ``axes`` (dimensions x components) are eigenvectors over the roots of ``values``."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float


def on_grid(embedding: str = "embedding") -> Column:
    """floor(SCALE * entry) + SHIFT of every entry, as long."""
    return F.transform(F.col(f"`{embedding}`"), lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT))


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor empty and has finite entries only."""
    column = F.col(f"`{embedding}`")
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.filter(column.isNotNull() & (F.size(column) > 0) & finite)


def _centred(n: int, sums: tuple[int, ...]) -> Column:
    return F.zip_with("x", F.lit(list(sums)), lambda v, s: (n * v - s).cast("double") / float(n))


def _rows_per_block(dims: int) -> int:
    return max(1, BLOCK_ENTRIES // dims)


def _slab(rows: DataFrame, slab: int, total: int, n: int, sums: tuple[int, ...]) -> BlockMatrix:
    """The centred rows of a slab as blocks; ``rows`` has x and row_no."""
    dims = len(sums)
    per_block = _rows_per_block(dims)
    size = per_block * SLAB_BLOCKS
    part = rows.filter((F.col("row_no") >= slab * size) & (F.col("row_no") < (slab + 1) * size))
    part = part.select((F.col("row_no") - slab * size).alias("index"), array_to_vector(_centred(n, sums)).alias("vector"))
    part = MLUtils.convertVectorColumnsFromML(part, "vector")
    return IndexedRowMatrix(part, min(size, total - slab * size), dims).toBlockMatrix(per_block, dims)


def _times(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a * b, the common dimension dealt over ``splits`` tasks, whose products are added."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def _gram(m: BlockMatrix) -> np.ndarray:
    """Transpose times itself: dimensions squared."""
    return _times(m.transpose(), m, max(1, m.numRowBlocks // TASK_BLOCKS)).toLocalMatrix().toArray()


def _projected(m: BlockMatrix, axes: np.ndarray, spark: SparkSession) -> BlockMatrix:
    dims, k = axes.shape
    block = ((0, 0), Matrices.dense(dims, k, axes.flatten("F").tolist()))
    return _times(m, BlockMatrix(spark.sparkContext.parallelize([block], 1), dims, k, dims, k))


def _each_slab(total: int, dims: int, work: Callable[[int], object]) -> list:
    slabs = -(-total // (_rows_per_block(dims) * SLAB_BLOCKS))
    with ThreadPoolExecutor(SLABS_AT_ONCE) as pool:
        return list(pool.map(work, range(slabs)))


def fit(vectors: DataFrame, components: int = COMPONENTS, embedding: str = "embedding") -> Whitening:
    """Whitening of the distinct vectors of ``vectors``, on the grid.

    Components run by falling eigenvalue; those whose eigenvalue is zero to double precision have no
    whitened value and are left out, so a table without rows, or with one distinct vector, has none.
    Vectors of unequal lengths fail.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, embedding).select(on_grid(embedding).alias("x")).distinct(), "fit_rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    n, dims = size["n"], size["high"] or 0
    if not n:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    if size["low"] != dims:
        raise ValueError(f"vectors have between {size['low']} and {dims} entries")
    sums = rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    sums = tuple(r["s"] for r in sums)
    rows = materialize(numbered(rows), "fit_numbered")
    scatter = sum(_each_slab(n, dims, lambda i: _gram(_slab(rows, i, n, n, sums)))) / n
    values, vectors_ = np.linalg.eigh((scatter + scatter.T) / 2)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    k = min(components, int((values > values[0] * dims * np.finfo(float).eps).sum())) if values[0] > 0 else 0
    axes = vectors_[:, :k] / np.sqrt(values[:k])
    error = 0.0
    if k:  # measured on the projected rows; their means are zero, since the centred rows add up to zero
        spread = sum(_each_slab(n, dims, lambda i: _gram(_projected(_slab(rows, i, n, n, sums), axes, spark)))) / n
        error = float(np.abs(spread - np.eye(k)).max())
    return Whitening(n, sums, values[:k], axes, float(np.trace(scatter)), error)


def whiten(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each usable row of ``vectors`` and component of ``model``.

    vec_id, component (from 1), n (fitted vectors), deviation (sum over dimensions of (n * x - sum)^2,
    exact), whitened, explained (share of the trace) and identity_error (largest absolute entry of the
    whitened covariance of the fitted vectors minus the identity). Null, empty and non-finite vectors
    give no rows; repeated rows are whitened each; null ids stay null; other columns are dropped; an
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[vec_id].dataType.simpleString()
    dims, k = model.axes.shape
    if not k:
        return spark.createDataFrame([], RESULT.format(id=id_type))
    rows = materialize(usable(vectors, embedding).select(F.col(f"`{vec_id}`").alias("vec_id"), on_grid(embedding).alias("x")), "rows")
    rows = materialize(numbered(rows), "rows_numbered")
    total = rows.count()
    folder = scratch_path(spark, "projected")

    def project(slab: int) -> None:
        blocks = _projected(_slab(rows, slab, total, model.n, model.sums), model.axes, spark)
        held = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        start = slab * _rows_per_block(dims) * SLAB_BLOCKS
        held.select((F.col("index") + start).alias("row_no"), vector_to_array("vector").alias("w")).write.parquet(f"{folder}/slab={slab}")

    _each_slab(total, dims, project)
    projected = spark.read.schema("row_no long, w array<double>").parquet(folder).select("row_no", "w")
    apart = F.zip_with("x", F.lit(list(model.sums)), lambda v, s: (model.n * v - s).cast("decimal(19,0)"))
    deviation = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda total, d: (total + d * d).cast("decimal(38,0)"))
    shares = F.lit([float(v / model.trace) for v in model.values])
    return (
        rows.select("row_no", "vec_id", deviation.alias("deviation"))
        .join(projected, "row_no")
        .select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
        .select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.element_at(shares, F.col("at") + 1).alias("explained"),
            F.lit(model.identity_error).alias("identity_error"),
        )
    )
