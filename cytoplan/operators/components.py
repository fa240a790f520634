"""Principal components of sparse expression, found by blocks of products with the covariance, without a dense matrix of genes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import discard, staged

KEY = ["sample_id", "cell_id"]
#: Directions beyond those asked for, products with the covariance, and cells multiplied at once.
EXTRA, PASSES, CELLS = 10, 6, 256


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of batches, and for each its values' rows, genes and values."""
    for whole in batches:
        for i in range(0, whole.num_rows, CELLS):
            part = whole.slice(i, CELLS)
            lists = part.column(column)
            if lists.null_count:
                lists = lists.fill_null(pa.scalar([], lists.type))
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            gene, value = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            yield part, owner, gene, value


def _summed(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row number ``at``."""
    out = np.zeros((rows, values.shape[1]))
    if len(at):
        order = np.argsort(at, kind="stable")
        heads = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
        out[at[order][heads]] = np.add.reduceat(values[order], heads)
    return out


def sparse_rows(cells: DataFrame, expression: DataFrame) -> tuple[DataFrame, list[str]]:
    """Each cell with the numbers and values of its genes, and the genes in order. Missing values are 0."""
    spark = cells.sparkSession
    genes = sorted(r[0] for r in expression.select("gene").distinct().collect())
    numbers = spark.createDataFrame(list(zip(genes, range(len(genes)))), "gene string, g int")
    packed = expression.where("value is not null and value <> 0").join(numbers, "gene").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("g", "value"))).alias("x"))
    return cells.select(*KEY).join(packed, KEY, "left").select(*[F.col(c).cast("long").alias(c) for c in KEY], "x"), genes


def expression_components(cells: DataFrame, expression: DataFrame, n: int = 50, passes: int = PASSES, seed: int = 0) -> DataFrame:
    """sample_id, cell_id, features: scores of the first ``n`` principal components of all cells' expression, centred.

    Subspace iteration: a random orthonormal block of n + ``EXTRA`` directions is multiplied by the covariance ``passes`` times, each a
    pass over the cells that sums genes x directions numbers by gene; then the covariance within the block is solved. With as many
    directions as genes the result is exact. The driver holds genes x directions numbers, never genes x genes. A component's sign makes
    its largest loading positive.
    """
    rows, genes = sparse_rows(cells, expression)
    rows = staged(rows, "sparse-expression")
    spark = cells.sparkSession
    count, wide = rows.count(), len(genes)
    if not count or not wide:
        return rows.select(*KEY, F.array().cast("array<double>").alias("features"))
    mean = np.zeros(wide)
    for r in rows.select(F.inline("x")).groupBy("g").agg(F.sum("value").alias("s")).collect():
        mean[r["g"]] = r["s"] / count
    k = min(n + EXTRA, wide)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(wide, k)))[0]

    def times_covariance(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((q, mean))
        names = [f"d{i}" for i in range(k)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, mean = shared.value
            total, weight = np.zeros((wide, k)), np.zeros(k)
            for part, owner, gene, value in _blocks(batches, 2):
                p = _summed(part.num_rows, owner, value[:, None] * q[gene]) - mean @ q
                total += _summed(wide, gene, value[:, None] * p[owner])
                weight += p.sum(0)
            total -= np.outer(mean, weight)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide, dtype=np.int32)), *[pa.array(np.ascontiguousarray(total[:, i])) for i in range(k)]], ["g", *names])

        parts = rows.mapInArrow(run, "g int, " + ", ".join(f"{c} double" for c in names))
        found = parts.groupBy("g").agg(*[F.sum(c).alias(c) for c in names]).orderBy("g").toArrow()
        return np.stack([found.column(c).to_numpy() for c in names], 1) / max(1, count - 1)

    for step in range(passes):
        z = times_covariance(q)
        if step == passes - 1 or k == wide:
            break
        q = np.linalg.qr(z)[0]
    small = q.T @ z
    value, vector = np.linalg.eigh((small + small.T) / 2)
    loadings = q @ vector[:, np.argsort(value)[::-1][: min(n, wide)]]
    loadings *= np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
    shared = spark.sparkContext.broadcast((loadings, mean @ loadings))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loadings, middle = shared.value
        for part, owner, gene, value in _blocks(batches, 2):
            p = _summed(part.num_rows, owner, value[:, None] * loadings[gene]) - middle
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(list(p), pa.list_(pa.float64()))], [*KEY, "features"])

    out = staged(rows.mapInArrow(project, "sample_id long, cell_id long, features array<double>"), "components")
    discard(rows)
    return out
