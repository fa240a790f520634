"""Batch correction by soft clusters that are pressed to hold all samples alike, and a ridge regression on samples in each cluster.

Rounds alternate between clustering and correction. Clustering gives a cell to each of K centres by exp(-2 (1 - cosine) / sigma), times
((expected + 1) / (observed + 1)) ** theta for its sample in that cluster; centres and observed counts are sums over cells. All cells are
updated at once, so the observed counts of two passes are averaged lest they swing. Correction fits, in each cluster, the vectors by a mean and
a ridge-penalised shift of each sample, and takes the shifts away from the cells by their shares; the normal equations have arrow
form, so they are solved from the sums of each sample.

Cells stay in Spark: a pass sums shares and vectors within partitions. The driver holds centres and observed counts (K times width, and
K for each sample); the sums of a sample in each cluster (K times width) stay in a table and meet the cells of their sample in a sorted
stream, a large sample dealt over many tasks.

Null vectors are left out; one sample, or no rows, come back as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import discard, staged

#: Numbers that the driver may hold for samples and clusters.
MOST_NUMBERS = 20_000_000
#: Cells of a sample that one task corrects.
SPAN = 100_000
CELL = "sample_id long, cell_id long, first array<double>, features array<double>"


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-300)


def shares(z: np.ndarray, centres: np.ndarray, press: np.ndarray, sigma: float) -> np.ndarray:
    """Shares of rows in clusters: ``press`` is each row's factor by cluster."""
    d = -2 * (1 - unit(z) @ centres.T) / sigma
    r = np.exp(d - d.max(1, keepdims=True)) * press
    return r / np.maximum(r.sum(1, keepdims=True), 1e-300)


def _summed(parts: DataFrame) -> DataFrame:
    """sample_id and the sum of ``x`` by position, as an array. parts: sample_id, x."""
    flat = parts.select("sample_id", F.posexplode("x").alias("pos", "v")).groupBy("sample_id", "pos").agg(F.sum("v").alias("v"))
    return flat.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("x"))


def _rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["sample_id", "x"])


def _pass(cells: DataFrame, centres: np.ndarray, press: dict[int, np.ndarray], sigma: float, with_first: bool) -> DataFrame:
    """sample_id and an array: the sum of shares by cluster, then of shares times (unit, or ``first``) vectors, cluster by cluster."""
    shared = cells.sparkSession.sparkContext.broadcast((centres, press))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c, by_sample), held = shared.value, {}
        for batch in batches:
            samples = batch.column(0).to_numpy()
            z = matrix(batch.column(3), len(samples))
            value = matrix(batch.column(2), len(samples)) if with_first else unit(z)
            names, at = np.unique(samples, return_inverse=True)
            r = shares(z, c, np.stack([by_sample[s] for s in names.tolist()])[at], sigma)
            for k, s in enumerate(names.tolist()):
                own = at == k
                held[s] = held.get(s, 0) + np.concatenate([r[own].sum(0), (r[own].T @ value[own]).ravel()])
            if len(held) > 256:
                yield _rows(held)
                held = {}
        yield _rows(held)

    return _summed(cells.mapInArrow(run, "sample_id long, x array<double>"))


def _shifts(sums: DataFrame, k: int, width: int, penalty: float) -> DataFrame:
    """sample_id and its shift in each cluster, by the ridge regression with an unpenalised mean. sums: those of :func:`_pass` with ``first``."""

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (1 + width))
        for batch in batches:
            x = matrix(batch.column(1), batch.num_rows)
            n = x[:, :k]
            total[:k] += (n - n * n / (n + penalty)).sum(0)
            total[k:] += (x[:, k:].reshape(-1, k, width) * (1 - n / (n + penalty))[:, :, None]).sum(0).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["sample_id", "x"])

    found = _summed(sums.mapInArrow(means, "sample_id long, x array<double>")).first()["x"]
    n, s = np.array(found[:k]), np.array(found[k:]).reshape(k, width)
    mean = s / np.maximum(n, 1e-300)[:, None]
    shared = sums.sparkSession.sparkContext.broadcast(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), batch.num_rows)
            n = x[:, :k, None]
            shift = (x[:, k:].reshape(-1, k, width) - n * shared.value) / (n + penalty)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shift.reshape(len(x), -1).tolist(), pa.list_(pa.float64()))], ["sample_id", "x"])

    return sums.mapInArrow(run, "sample_id long, x array<double>")


def _moved(cells: DataFrame, shifts: DataFrame, counts: DataFrame, centres: np.ndarray, press: dict[int, np.ndarray], sigma: float) -> DataFrame:
    """cells with features = first less the shifts of their sample by their shares."""
    shared = cells.sparkSession.sparkContext.broadcast((centres, press))
    parts = counts.select("sample_id", F.ceil(F.col("n") / SPAN).cast("int").alias("parts"))
    empty = F.array().cast("array<double>")
    sent = shifts.join(parts, "sample_id").select("sample_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("cell_id"), F.col("x").alias("first"), empty.alias("features"))
    rows = cells.join(parts, "sample_id").select("sample_id", F.pmod(F.xxhash64("cell_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "cell_id", "first", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c, by_sample), shift = shared.value, None
        for batch in batches:
            kind, samples = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            edge = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (samples[1:] != samples[:-1]))) if len(kind) else []
            for i, j in zip(edge, [*edge[1:], len(kind)], strict=True):
                part = batch.slice(i, j - i)
                if kind[i] == 0:
                    shift = matrix(part.column(4).slice(0, 1), 1).reshape(len(c), -1)
                    continue
                first, z = (matrix(part.column(k), j - i) for k in (4, 5))
                r = shares(z, c, np.broadcast_to(by_sample[int(samples[i])], (j - i, len(c))), sigma)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(4), pa.array((first - r @ shift).tolist(), pa.list_(pa.float64()))], ["sample_id", "cell_id", "first", "features"])

    key = ["sample_id", "part"]
    both = sent.union(rows).repartition(*key).sortWithinPartitions(*key, "kind")
    return both.mapInArrow(run, CELL)


def corrected(rows: DataFrame, clusters: int | None = None, theta: float = 2.0, sigma: float = 0.1, penalty: float = 1.0, rounds: int = 5, passes: int = 4, seed: int = 0, start: np.ndarray | None = None) -> DataFrame:
    """sample_id, cell_id, features after correction. ``start``: centres to begin with instead of those of k-means."""
    cells = staged(rows.where("features is not null").select("sample_id", "cell_id", F.col("features").cast("array<double>").alias("first")).withColumn("features", F.col("first")), "harmony")
    counts = staged(cells.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")), "harmony-counts")
    n_samples, total = counts.count(), counts.agg(F.sum("n")).first()[0] or 0
    if n_samples < 2:
        return cells.select("sample_id", "cell_id", "features")
    k = clusters or max(2, min(100, total // 30))
    if k * n_samples > MOST_NUMBERS:
        raise ValueError(f"{k} clusters of {n_samples} samples are more than {MOST_NUMBERS} numbers; take fewer clusters")
    width = cells.select(F.size("features").alias("w")).first()["w"]
    if start is None:
        norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x * x))
        vec = cells.select(array_to_vector(F.transform("features", lambda x: x / F.greatest(norm, F.lit(1e-300)))).alias("x"))
        start = np.stack(KMeans(k=k, seed=seed, featuresCol="x").fit(vec).clusterCenters())
    centres = unit(np.asarray(start, float))
    k = len(centres)
    share = {r["sample_id"]: r["n"] / total for r in counts.collect()}
    press = {s: np.ones(k) for s in share}
    observed: dict[int, np.ndarray] | None = None
    for _ in range(rounds):
        for _ in range(passes):
            sums = staged(_pass(cells, centres, press, sigma, False), "harmony-sums")
            vectors = _summed(sums.select(F.lit(0).cast("long").alias("sample_id"), F.slice("x", k + 1, k * width).alias("x"))).first()["x"]
            centres = unit(np.array(vectors).reshape(k, width))
            found = {r["sample_id"]: np.array(r["n"]) for r in sums.select("sample_id", F.slice("x", 1, k).alias("n")).collect()}
            discard(sums)
            observed = {s: n if observed is None else (n + observed[s]) / 2 for s, n in found.items()}
            mass = sum(observed.values())
            press = {s: ((mass * share[s] + 1) / (o + 1)) ** theta for s, o in observed.items()}
        shifts = staged(_shifts(_pass(cells, centres, press, sigma, True), k, width, penalty), "harmony-shifts")
        cells, before = staged(_moved(cells, shifts, counts, centres, press, sigma), "harmony"), cells
        discard(shifts, before)
    return cells.select("sample_id", "cell_id", "features")

