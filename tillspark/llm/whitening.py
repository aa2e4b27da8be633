"""Operator 12 -- embedding whitening with Spark MLlib's BlockMatrix.

Entries become whole numbers, so that counts, sums and deviations are exact.
Every distinct vector is a row of the fit list.  Its centred rows are indexed
into blocks of ``BLOCK_ROWS`` rows; the transposed matrix times the matrix is
the scatter (a dimension x dimension matrix, the only thing that reaches the
driver); numpy's ``eigh`` gives its eigenvectors; the centred rows of the whole
table times the whitening matrix are the projections.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.common import scratch_table, with_position

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 4096
#: components whose variance is below this share of the largest have none but rounding
RANK_TOLERANCE = 1e-12
#: entries that still have a whole number of 64 bits
LARGEST = 2.0**62


def quantized(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry as longs; null if the vector is null
    or empty, or an entry is null, not finite or too large for a long."""
    c = vector.cast("array<double>")
    fit = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) * SCALE < LARGEST), F.lit(False)))
    return F.when((F.size(c) > 0) & fit, F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + F.lit(OFFSET).cast("long")))


def _block_matrix(rows: DataFrame, n: int, dim: int) -> BlockMatrix:
    """(index, vector: array<double>) -> its BlockMatrix."""
    vectors = rows.select("index", array_to_vector("vector").alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dim).toBlockMatrix(BLOCK_ROWS, dim)


def _gram(m: BlockMatrix) -> np.ndarray:
    """Transpose times matrix.  The rows are the middle dimension: split over
    tasks, so that no task gets more than its share of the blocks."""
    splits = max(1, min(m.numRowBlocks, 4 * m._java_matrix_wrapper._sc.defaultParallelism))
    left = m.transpose()
    product = left._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    g = BlockMatrix(product, left.rowsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()
    return (g + g.T) / 2


def _times(m: BlockMatrix, right: np.ndarray) -> BlockMatrix:
    sc = m._java_matrix_wrapper._sc
    block = DenseMatrix(*right.shape, right.ravel(order="F").tolist())
    return m.multiply(BlockMatrix(sc.parallelize([((0, 0), block)], 1), right.shape[0], right.shape[1]))


def _rows(m: BlockMatrix) -> DataFrame:
    """BlockMatrix -> (index, vector: array<double>) without leaving the JVM."""
    rows = callMLlibFunc("getIndexedRows", m.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("vector"))


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row and component: the id column, ``component`` (from 1,
    by falling variance), ``n`` (size of the fit list), ``deviation``,
    ``whitened``, ``explained`` (share of the variance) and ``identity_error``.

    x is ``quantized`` of the vector.  The fit list holds each distinct x once;
    S is its sum per dimension.  ``deviation`` is the exact sum of (n * x - S)^2
    over the dimensions, null where it exceeds a long.  ``whitened`` is x - S / n
    on the component's unit eigenvector, over the root of its eigenvalue;
    ``identity_error`` is measured on the projected fit list.

    Rows whose vector is null, empty, or holds null, non-finite or (beyond 64
    bits) too large entries are left out.  The dimension is the commonest length
    (of equally common ones the smallest); rows of another length are left out.
    Repeated rows and ids each come back; a null id stays null.  Components
    without variance (constant or dependent dimensions, fewer vectors than
    components) have no whitening and are not returned; with one distinct vector
    or an empty table the result is empty.  Other columns are ignored.
    """
    spark = rows.sparkSession
    usable = rows.select(F.col(id_col).alias("__id"), quantized(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    usable = scratch_table(usable)
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "d").first()
    empty = spark.createDataFrame([], OUTPUT).withColumnRenamed("vec_id", id_col)
    if lengths is None:
        return empty
    dim = lengths.d
    fit = scratch_table(usable.where(F.size("x") == dim).select("x").distinct())
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n, total = sums[0].n, {r.i: int(r.s) for r in sums}
    # S = n * q + r: n * x - S = n * (x - q) - r stays small
    q = F.array(*[F.lit(total[i] // n).cast("long") for i in range(dim)])
    r = F.array(*[F.lit(total[i] % n).cast("long") for i in range(dim)])
    count = F.lit(n).cast("long")
    off = F.zip_with(F.zip_with("x", q, lambda a, b: F.try_subtract(a, b)), r, lambda a, b: F.try_subtract(F.try_multiply(a, count), b))
    deviation = F.aggregate("off", F.lit(0).cast("long"), lambda acc, t: F.try_add(acc, F.try_multiply(t, t)))
    # for entries whose exact product leaves 64 bits
    wide = F.zip_with(F.zip_with("x", q, lambda a, b: a.cast("double") - b), r, lambda a, b: a - b / F.lit(float(n)))
    centred = F.zip_with("off", wide, lambda t, w: F.coalesce(t / F.lit(float(n)), w))

    def indexed(table: DataFrame) -> DataFrame:
        return with_position(table, "index").withColumn("off", off).withColumn("vector", centred)

    fit_matrix = _block_matrix(indexed(fit), n, dim)
    values, vectors = np.linalg.eigh(_gram(fit_matrix) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int(min(components, (values > max(values[0], 0) * RANK_TOLERANCE).sum()))
    if not kept:
        return empty
    whitening = vectors[:, :kept] / np.sqrt(values[:kept])
    error = float(np.abs(_gram(_times(fit_matrix, whitening)) / n - np.eye(kept)).max())
    share = F.array(*[F.lit(float(v)) for v in values[:kept] / values.clip(0).sum()])
    table = scratch_table(usable.where(F.size("x") == dim))
    every = indexed(table)
    projected = _rows(_times(_block_matrix(every, table.count(), dim), whitening))
    found = every.select("index", "__id", deviation.alias("deviation")).join(projected, "index")
    return found.select("__id", "deviation", F.posexplode("vector").alias("i", "whitened")).select(
        F.col("__id").alias(id_col),
        (F.col("i") + 1).alias("component"),
        count.alias("n"),
        "deviation",
        "whitened",
        share[F.col("i")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
