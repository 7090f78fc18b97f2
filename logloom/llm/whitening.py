"""Whitening of embeddings with MLlib block matrices.

Every usable vector becomes one of whole numbers, ``floor(scale * c)`` per entry. The fit list holds each distinct vector
once. Its centred rows are indexed into a ``BlockMatrix``; transpose times matrix gives the scatter, whose eigenvectors
(d x d numbers, on the driver) make the whitening matrix; matrix times whitening matrix projects the rows.

Rows whose vector is null or holds a null or non-finite entry take no part, nor do vectors of another length than the most
frequent one (ties: the longest). A null or repeated id is an ordinary row, repeated vectors count once in the fit and get
the same values. Components whose eigenvalue is 0 to double precision cannot be whitened and are left out, so equal
vectors alone, vectors without entries and an empty table give no rows. Whole-number results beyond 64 bits end the job.
Extra columns with clashing names do no harm: only the two named ones are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import pick, stored

#: Bytes of one block, and blocks that one task of a product holds at a time.
BLOCK_BYTES, BLOCKS_A_TASK = 2 << 20, 16
COLUMNS_A_BLOCK = 1024

RESULT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint"))


def common_length(rows: DataFrame) -> int:
    """The most frequent number of entries (ties: the largest); 0 without rows."""
    counts = rows.groupBy(F.size("x").alias("d")).count()
    best = counts.agg(F.max_by("d", F.struct("count", "d")).alias("d")).first()
    return best["d"] or 0


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once with ``index``: 0, 1, 2, ... over all rows.

    The numbers within a task are fixed by the written table; the tasks' counts alone meet in one place.
    """
    kept = stored(df.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33)
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = kept.groupBy(part.alias("_part")).count().select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (kept.withColumn("_part", part).join(bases, "_part")
            .select((F.col("_base") + place).alias("index"), *df.columns))


def block_matrix(rows: DataFrame, vector: Column, n: int, d: int) -> BlockMatrix:
    """Rows (``index`` from 0) as blocks of bounded size; stays in the JVM."""
    columns = min(d, COLUMNS_A_BLOCK)
    per_block = max(1, BLOCK_BYTES // (8 * columns))
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(vector).alias("vector")), "vector")
    parts = -(-n * d * 8 // (BLOCK_BYTES * BLOCKS_A_TASK))
    if indexed.rdd.getNumPartitions() < parts:
        indexed = indexed.repartition(parts)
    matrix = IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", indexed, n, d))
    return matrix.toBlockMatrix(per_block, columns)


def gram(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, in as many independent sums as the row blocks need, as one small local matrix."""
    turned = matrix.transpose()
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_A_TASK))
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def local_blocks(spark, values: np.ndarray, rows: int) -> BlockMatrix:
    """A small matrix (d x components) as blocks of ``rows`` rows."""
    parts = [((i // rows, 0), DenseMatrix(len(values[i:i + rows]), values.shape[1], values[i:i + rows].ravel(order="F").tolist()))
             for i in range(0, len(values), rows)]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), rows, values.shape[1], *values.shape)


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues in falling order and their unit eigenvectors (columns); none that are 0 to double precision."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(initial=0.0), 0.0) * len(values) * np.finfo(float).eps]
    return values[order], vectors[:, order]


def whiten(df: DataFrame, components: int = 4, scale: int = 256, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per usable row and component: vec_id, component (from 1, by falling eigenvalue), n (vectors of the fit
    list), deviation (sum over dimensions of (n*x - S)^2), whitened, explained (eigenvalue over trace), identity_error
    (largest entry of the whitened fit list's covariance minus the identity)."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], RESULT)
    rows = pick(df, id_column, column).toDF("vec_id", "e").filter(usable(F.col("e")))
    rows = rows.select(F.col("vec_id").cast("bigint"), whole_numbers(F.col("e"), scale).alias("x"))
    rows = stored(rows, "whitening-rows")
    d = common_length(rows)
    if d == 0:
        return empty
    rows = rows.filter(F.size("x") == d)
    fit = numbered(rows.select("x").distinct(), "whitening-fit")
    totals = fit.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)]).first()
    n, sums = totals[0], list(totals[1:])
    centred = F.zip_with("x", F.lit([float(s) / n for s in sums]), lambda a, m: a.cast("double") - m)
    matrix = block_matrix(fit, centred, n, d)
    covariance = gram(matrix) / n
    values, vectors = principal(covariance, components)
    if not len(values):
        return empty
    projected = matrix.multiply(local_blocks(spark, vectors / np.sqrt(values), matrix.colsPerBlock))
    error = float(np.abs(gram(projected) / n - np.eye(len(values))).max())
    back = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    white = back.toDF("index", "w").select("index", vector_to_array("w").alias("w"))
    off = F.zip_with("x", F.lit(sums).cast("array<bigint>"), lambda a, s: F.lit(n).cast("bigint") * a - s)
    deviation = F.aggregate(F.transform(off, lambda v: v * v), F.lit(0).cast("bigint"), lambda a, b: a + b)
    known = fit.select("index", "x", deviation.alias("deviation")).join(white, "index")
    share = F.lit((values / np.trace(covariance)).tolist())
    return (rows.join(known, "x").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
