"""Embeddings and niches: centering, principal components, neighbour graphs, k-means, community sweeps and a graph encoder."""

from __future__ import annotations

import copy
from collections import Counter, deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stage import discard, staged
from . import graph

KEY = ["sample_id", "cell_id"]
#: Edges that a community search may hold in one task; larger cohorts are clustered by sample or by k-means.
MOST_EDGES = 20_000_000
#: Cells whose samples train the encoder in one task.
GROUP_CELLS = 100_000
#: Cells that a step's hidden layer is computed for at once, so that it stays in the cache.
STEP_ROWS = 1024


def centred(rows: DataFrame, column: str = "features", by: str = "sample_id") -> DataFrame:
    """Each vector minus its sample's mean plus the mean of all."""
    long = rows.select(by, F.posexplode(column).alias("pos", "x"))
    sums = long.groupBy(by, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("pos")
    shift = sums.select(by, "pos", (F.sum("s").over(w) / F.sum("n").over(w) - F.col("s") / F.col("n")).alias("d"))
    shift = shift.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("d"))
    return rows.join(shift, by).withColumn(column, F.zip_with(column, F.transform("d", lambda p: p["d"]), lambda x, d: x + d)).drop("d")


def principal_components(rows: DataFrame, n: int = 50, column: str = "features") -> DataFrame:
    """rows with ``column`` replaced by its first n principal components, fitted on all rows, centred."""
    vec = rows.withColumn("_v", array_to_vector(column))
    width = len(rows.select(column).where(F.col(column).isNotNull()).first()[0])
    scaled = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(vec).transform(vec)
    model = PCA(k=min(n, width), inputCol="_c", outputCol="_p").fit(scaled)
    return model.transform(scaled).withColumn(column, vector_to_array("_p")).drop("_v", "_c", "_p")


def kmeans(rows: DataFrame, k: int, seed: int = 0, scope: str = "cohort", column: str = "features") -> DataFrame:
    """sample_id, cell_id, niche_id. ``cohort`` fits all samples together, ``sample`` each by itself."""
    if scope == "cohort":
        # Fitting takes several passes, assignment one more: the rows are computed once.
        vec = staged(rows.select(*KEY, column), "kmeans-rows").withColumn("_v", array_to_vector(column))
        return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="niche_id").fit(vec).transform(vec).select(*KEY, "niche_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id", kind="stable")
        x = np.stack(pdf[column].to_numpy())
        rng = np.random.default_rng(seed)
        centre = x[[int(rng.integers(len(x)))]]
        while len(centre) < min(k, len(x)):  # far points are likely to be the next centre
            d = ((x[:, None] - centre[None]) ** 2).sum(2).min(1)
            centre = np.concatenate([centre, x[[int(rng.choice(len(x), p=d / d.sum()))]] if d.sum() else x[[len(centre)]]])
        for _ in range(100):
            label = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            new = np.stack([x[label == c].mean(0) if (label == c).any() else centre[c] for c in range(len(centre))])
            if np.allclose(new, centre):
                break
            centre = new
        return pd.DataFrame({"sample_id": pdf["sample_id"], "cell_id": pdf["cell_id"], "niche_id": label.astype(np.int32)})

    return rows.select(*KEY, column).groupBy("sample_id").applyInPandas(run, "sample_id long, cell_id long, niche_id int")


def _closest(x: np.ndarray, y: np.ndarray, mine: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, row of y and squared distance of the k nearest rows of y with another id, ties by id, those beyond a row's ``limit`` left out. ``ids`` ascends. Exact.

    Distances by products tell which pairs can be among the nearest, with room for their rounding; only these are computed by differences.
    """
    k = min(k, len(y))
    square, own = (y * y).sum(1), (x * x).sum(1)
    kind = np.float32 if np.abs(square).max() < 1e30 and np.abs(own).max() < 1e30 else np.float64
    room = 8 * (y.shape[1] + 4) * np.finfo(kind).eps * (own + square.max())
    twice, other, own, square = (-2 * x).astype(kind), y.astype(kind), own.astype(kind)[:, None], square.astype(kind)
    limit = np.full(len(x), np.inf) if limit is None else limit
    rows, places, most, after = [], [], limit, 0
    for i in range(0, len(y), 2048):
        d = twice @ other[i : i + 2048].T
        d += own
        d += square[i : i + 2048]
        begin, end = (np.searchsorted(ids[i : i + 2048], mine, side=side) for side in ("left", "right"))
        for r in np.flatnonzero(begin < end).tolist():
            d[r, begin[r] : end[r]] = np.inf
        # The k-th distance so far is looked for in parts ever farther apart; with fewer than k rows in a part all of it counts.
        if i >= after and d.shape[1] >= k:
            most, after = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1]), 2 * i + 1
        r, c = np.nonzero(d <= (most + room)[:, None].astype(kind))
        rows.append(r)
        places.append(c + i)
    r, c = np.concatenate(rows), np.concatenate(places)
    apart = mine[r] != ids[c]
    r, c = r[apart], c[apart]
    d2 = np.concatenate([np.zeros(0), *[((x[r[i : i + 65536]] - y[c[i : i + 65536]]) ** 2).sum(1) for i in range(0, len(r), 65536)]])
    order = np.lexsort((c, d2, r))
    r, c, d2 = r[order], c[order], d2[order]
    best = (np.arange(len(r)) - np.searchsorted(r, r) < k) & np.isfinite(d2) & (d2 <= limit[r])
    return r[best], c[best], d2[best]


def knn(rows: DataFrame, k: int = 15, id_col: str = "vec_id", column: str = "embedding", asks: int = 8192, has: int = 65_536) -> DataFrame:
    """a, b, rank, d2: the k nearest other rows of each row by squared distance, ties by id. Exact.

    Rows are dealt into blocks of ``asks`` rows that ask and of ``has`` rows that are searched; a task holds one of each and keeps the k best
    of each of its rows. All pairs are looked at, so the time grows with the square of the rows; what a task holds does not grow.
    """
    n = rows.count()
    p, q = max(1, -(-n // asks)), max(1, -(-n // has))
    single = rows.schema[column].dataType == T.ArrayType(T.FloatType(), rows.schema[column].dataType.containsNull)
    data = rows.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<float>" if single else "array<double>").alias("v"))
    of = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left, right = data.select(of(p).alias("i"), every(q).alias("j"), "id", "v"), data.select(every(p).alias("i"), of(q).alias("j"), "id", "v")

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"a": [], "b": [], "d2": []}).astype({"a": "int64", "b": "int64", "d2": "float64"})
        d = d.sort_values("id", kind="stable")
        x, y, mine, ids = np.stack(q["v"].to_numpy()).astype(float), np.stack(d["v"].to_numpy()).astype(float), q["id"].to_numpy(), d["id"].to_numpy()
        out = []
        for i in range(0, len(x), 128):
            r, c, d2 = _closest(x[i : i + 128], y, mine[i : i + 128], ids, k)
            out.append((mine[i + r], ids[c], d2))
        return pd.DataFrame(dict(zip(("a", "b", "d2"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    # Dealt by number: adaptive execution would put several small blocks into one task.
    left, right = (df.repartition(4 * p * q, "i", "j").groupBy("i", "j") for df in (left, right))
    near = left.cogroup(right).applyInPandas(run, "a long, b long, d2 double")
    w = Window.partitionBy("a").orderBy("d2", "b")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_graph(nearest: DataFrame) -> DataFrame:
    """Undirected edges lo < hi of a nearest-neighbour list, each once."""
    return nearest.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


# ---------------------------------------------------------------- communities


def _rows(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and weights of the given links, each once, by their first end and then as they come; the weights of equal links are added up."""
    key, first, at = np.unique(src * n + dst, return_index=True, return_inverse=True)
    order = np.lexsort((first, key // n))
    return key[order] // n, key[order] % n, np.bincount(at, w, len(key))[order]


def _lists(n: int, src: np.ndarray, column: np.ndarray) -> list[list]:
    """The column's values for each of n nodes; ``src`` ascends. Node numbers are one object each, so that a large graph's lists stay small."""
    cut = np.searchsorted(src, np.arange(n + 1)).tolist()
    if column.dtype == np.int64:
        names = np.empty(n, object)
        names[:] = range(n)
        column = names[column]
    flat = column.tolist()
    return [flat[i:j] for i, j in zip(cut, cut[1:])]


def _gains(groups: Iterable[int], weights: list[float]) -> dict[int, float]:
    """Sums of the weights by group."""
    out: dict[int, float] = {}
    for g, w in zip(groups, weights, strict=True):
        out[g] = out.get(g, 0.0) + w
    return out


def _moved(near: list[list[int]], weights: list[list[float]] | None, strength: list[float], group: list[int], mass: list[float], total: float, resolution: float, rng: np.random.Generator) -> None:
    """Nodes move to the group of a neighbour, or to one of their own, while that helps; ``group`` and ``mass`` follow. Without ``weights`` links are counted."""
    queue = deque(rng.permutation(len(near)).tolist())
    waiting = bytearray(b"\1") * len(near)
    group_of = group.__getitem__
    while queue:
        i = queue.popleft()
        waiting[i] = 0
        old, own = group[i], strength[i]
        gain = Counter(map(group_of, near[i])) if weights is None else _gains(map(group_of, near[i]), weights[i])
        mass[old] -= own
        factor = resolution * own
        # The most gain; of equals the own group, then the smallest.
        best, top = old, gain.pop(old, 0.0) - factor * mass[old] / total
        for g, w in gain.items():
            value = w - factor * mass[g] / total
            if value > top or (value == top and best != old and g < best):
                best, top = g, value
        if top < 0:
            best = len(mass)
            mass.append(0.0)
        mass[best] += own
        if best != old:
            group[i] = best
            for j in near[i]:
                if not waiting[j] and group[j] != best:
                    waiting[j] = 1
                    queue.append(j)


def _refined(near: list[list[int]], weights: list[list[float]] | None, strength: list[float], total: float, resolution: float, rng: np.random.Generator) -> list[int]:
    """Parts of each group: nodes that are still alone join the part of a neighbour where that helps most. near: neighbours in a node's own group."""
    part, mass, alone = list(range(len(near))), list(strength), [True] * len(near)
    part_of = part.__getitem__
    for i in rng.permutation(len(near)).tolist():
        if not alone[i] or not near[i]:
            continue
        gain = Counter(map(part_of, near[i])) if weights is None else _gains(map(part_of, near[i]), weights[i])
        factor, best, top = resolution * strength[i], -1, 0.0
        for p, w in gain.items():
            value = w - factor * mass[p] / total
            if value > top or (value == top and 0 <= p < best):
                best, top = p, value
        if best >= 0:
            mass[best] += strength[i]
            mass[i] -= strength[i]
            part[i], alone[i], alone[best] = best, False, False
    return part


def _pieces(near: list[list[int]], group: list[int]) -> list[int]:
    """Connected pieces of the groups, numbered from 0."""
    piece = [-1] * len(near)
    count = 0
    for i in range(len(near)):
        if piece[i] < 0:
            piece[i] = count
            stack = [i]
            while stack:
                for j in near[stack.pop()]:
                    if piece[j] < 0 and group[j] == group[i]:
                        piece[j] = count
                        stack.append(j)
            count += 1
    return piece


def communities(n: int, a: np.ndarray, b: np.ndarray, resolution: float, seed: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Labels by Leiden's method for modularity with a resolution (edges weigh 1 unless ``weight`` is given; loops count): nodes move, groups are refined into parts that hang together, and the
    parts become the nodes of the next round, which begins with the groups found; until no part has two nodes.

    Graphs are built and reduced on arrays; only the moves themselves, each of which depends on those before, go node by node."""
    if not n:
        return np.arange(n)
    rng = np.random.default_rng(seed)
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    loop = a == b
    loops = np.zeros(n) if weight is None else np.bincount(a[loop], np.asarray(weight, float)[loop], n)
    # Both directions of each edge, side by side.
    w = np.repeat(np.ones(len(a)) if weight is None else np.asarray(weight, float), 2)
    src, dst, apart = np.stack([a, b], 1).ravel(), np.stack([b, a], 1).ravel(), np.repeat(~loop, 2)
    src, dst, w = _rows(n, src[apart], dst[apart], w[apart])
    total = float(w.sum() + 2 * loops.sum()) or 1.0
    node, group = np.arange(n), list(range(n))
    while True:
        size = len(loops)
        strength = np.bincount(src, w, size) + 2 * loops
        mass = np.bincount(group, strength).tolist()
        near = _lists(size, src, dst)
        single = bool((w == 1).all())
        _moved(near, None if single else _lists(size, src, w), strength.tolist(), group, mass, total, resolution, rng)
        of = np.array(group)
        own = of[src] == of[dst]
        inside = src[own]
        parts = _refined(_lists(size, inside, dst[own]), None if single else _lists(size, inside, w[own]), strength.tolist(), total, resolution, rng)
        names, part = np.unique(parts, return_inverse=True)
        if len(names) == size:
            return np.array(_pieces(near, group), int)[node]
        p, q = part[src], part[dst]
        same = p == q
        loops = np.bincount(part, loops, len(names)) + np.bincount(p[same], w[same], len(names)) / 2
        above = np.zeros(len(names), np.int64)
        above[part] = group
        src, dst, w = _rows(len(names), p[~same], q[~same], w[~same])
        group, node = above.tolist(), part[node]


def modularity(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> float:
    m = max(1, len(a))
    degree = np.bincount(label[a], minlength=label.max() + 1) + np.bincount(label[b], minlength=label.max() + 1)
    return float((label[a] == label[b]).sum() / m - ((degree / (2 * m)) ** 2).sum())


def nmi_of(x: np.ndarray, y: np.ndarray) -> float:
    table = np.zeros((x.max() + 1, y.max() + 1))
    np.add.at(table, (x, y), 1 / len(x))
    px, py = table.sum(1), table.sum(0)
    at = table > 0
    mi = float((table[at] * np.log(table[at] / np.outer(px, py)[at])).sum())
    h = -float((px[px > 0] * np.log(px[px > 0])).sum() + (py[py > 0] * np.log(py[py > 0])).sum()) / 2
    return mi / h if h else 0.0


def silhouette(rows: DataFrame, labels: DataFrame, column: str = "features", sample: int = 10_000) -> float:
    """Mean silhouette (squared Euclidean distance) of at most ``sample`` cells, the first by hash; nan with one cluster."""
    both = rows.join(labels.where("niche_id is not null"), KEY).orderBy(F.xxhash64(*KEY)).limit(sample)
    vec = both.select(array_to_vector(column).alias("features"), F.col("niche_id").alias("prediction")).persist()
    try:
        if vec.select("prediction").distinct().count() < 2:
            return float("nan")
        return ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(vec)
    finally:
        vec.unpersist()


def winner(scores: DataFrame, least: float = 0.005) -> DataFrame:
    """The row of the best setting: min_frac of ``least`` or more if any has it, then by stability, modularity, silhouette and resolution."""
    fits = (F.col("min_frac") >= least).cast("int")
    order = [fits.desc(), F.desc("stability"), F.desc("modularity"), F.desc("silhouette"), F.col("resolution")]
    return scores.orderBy(*order).limit(1)


# ---------------------------------------------------------------- encoder


def _normalised(n: int, a: np.ndarray, b: np.ndarray):
    """The graph convolution: symmetric normalisation with self-loops, as a function of features."""
    degree = np.bincount(a, minlength=n) + 1.0
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    w = 1 / np.sqrt(degree[a] * degree[b])

    def apply(x: np.ndarray) -> np.ndarray:
        out = x / degree[:, None]
        for k in range(x.shape[1]):
            out[:, k] += np.bincount(a, w * np.ascontiguousarray(x[:, k])[b], n)
        return out

    return apply


class Encoder:
    """Two graph convolutions trained to tell nodes from row-shuffled ones by the graph's summary (deep graph infomax), with Adam."""

    def __init__(self, wide: int, hidden: int = 64, out: int = 32, rate: float = 1e-3, decay: float = 1e-4, dropout: float = 0.2, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.shapes = [(wide, hidden), (hidden, out), (out, out)]
        self.w = [rng.normal(0, np.sqrt(2 / sum(s)), s) for s in self.shapes]
        self.m, self.v = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        self.rate, self.decay, self.dropout, self.steps = rate, decay, dropout, 0

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (*self.w, *self.m, *self.v)])

    def load(self, flat: np.ndarray, steps: int) -> None:
        cuts = np.cumsum([a * b for a, b in self.shapes] * 3)[:-1]
        parts = [p.reshape(s) for p, s in zip(np.split(np.asarray(flat, float), cuts), self.shapes * 3, strict=True)]
        self.w, self.m, self.v, self.steps = parts[:3], parts[3:6], parts[6:], steps

    def step(self, x: np.ndarray, ax: np.ndarray, conv, rng: np.random.Generator) -> float:
        """One step on one graph of features ``x`` and convolved features ``ax``; the loss before it."""
        w, n = self.w, len(x)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        bx = conv(x[rng.permutation(n)])
        # Of both convolutions' outputs only the mean and the products with one vector are asked for. The convolution is symmetric and
        # linear, so it is applied to single columns on the far side of the products, never to the hidden layer.
        first, h = w[0] / (1 - self.dropout), []
        for y in (ax, bx):
            h.append(np.empty((n, first.shape[1])))
            for i in range(0, n, STEP_ROWS):
                part = h[-1][i : i + STEP_ROWS]
                np.maximum(y[i : i + STEP_ROWS] @ first, 0, out=part)
                part *= rng.random(part.shape) >= self.dropout
        even = conv(np.ones((n, 1)))[:, 0]
        mean = even @ h[0]
        s = sigmoid(mean @ w[1] / n)
        u = w[2] @ s
        v = w[1] @ u
        p = sigmoid(conv(np.stack([y @ v for y in h], 1)))
        loss = -float(np.log(p[:, 0] + 1e-9).mean() + np.log(1 - p[:, 1] + 1e-9).mean())
        d = conv(np.stack([(p[:, 0] - 1) / n, p[:, 1] / n], 1))
        dh = h[0].T @ d[:, 0] + h[1].T @ d[:, 1]
        du = w[1].T @ dh
        ds = (w[2].T @ du) * s * (1 - s) / n
        g = [np.zeros_like(w[0]), np.outer(dh, u) + np.outer(mean, ds), np.outer(du, s)]
        for y, hh, backs in ((ax, h[0], ((d[:, 0], v), (even, w[1] @ ds))), (bx, h[1], ((d[:, 1], v),))):
            for i in range(0, n, STEP_ROWS):
                at = slice(i, i + STEP_ROWS)
                on = (hh[at] > 0) / (1 - self.dropout)
                for column, row in backs:
                    g[0] += ((y[at] * column[at, None]).T @ on) * row
        self.steps += 1
        for k in range(3):
            grad = g[k] + self.decay * w[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * grad
            self.v[k] = 0.999 * self.v[k] + 0.001 * grad * grad
            w[k] = w[k] - self.rate * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.999**self.steps)) + 1e-8)
        return loss


class Stopper:
    """Whether the mean loss has failed to improve for ``patience`` epochs, after ``min_epochs`` at least."""

    def __init__(self, patience: int = 20, min_delta: float = 1e-4, min_epochs: int = 50):
        self.patience, self.min_delta, self.min_epochs = patience, min_delta, min_epochs
        self.best, self.since, self.epoch = np.inf, 0, 0

    def done(self, loss: float) -> bool:
        self.epoch += 1
        better = not np.isfinite(self.best) or loss < self.best - self.min_delta * max(abs(self.best), 1.0)
        self.best, self.since = (loss, 0) if better else (self.best, self.since + 1)
        return self.epoch >= self.min_epochs and self.since >= self.patience


Graph = tuple[np.ndarray, np.ndarray, np.ndarray]


def train_on(encoder: Encoder, graphs: list[Graph], epochs: int, seed: int, stopper: Stopper | None = None) -> list[float]:
    """Epochs over ``graphs`` (features, a, b) in random order, one graph a step; the mean loss of each epoch."""
    rng = np.random.default_rng(seed)
    ready = [(x, conv(x), conv) for x, a, b in graphs for conv in [_normalised(len(x), a, b)]]
    out = []
    for _ in range(epochs):
        out.append(float(np.mean([encoder.step(*ready[i], rng) for i in rng.permutation(len(ready))])))
        if stopper and stopper.done(out[-1]):
            break
    return out


def train_encoder(x: np.ndarray, a: np.ndarray, b: np.ndarray, hidden: int = 64, out: int = 32, epochs: int = 300, patience: int = 20, min_delta: float = 1e-4, min_epochs: int = 50, seed: int = 0) -> list[np.ndarray]:
    """The weights after training on one graph."""
    encoder = Encoder(x.shape[1], hidden, out, seed=seed)
    train_on(encoder, [(x, a, b)], epochs, seed, Stopper(patience, min_delta, min_epochs))
    return encoder.w


def _graphs(nodes: pd.DataFrame, links: pd.DataFrame) -> list[Graph]:
    """One graph a sample, by sample_id."""
    ends = dict(list(links.groupby("sample_id")))
    out = []
    for sample, own in nodes.sort_values(KEY, kind="stable").groupby("sample_id"):
        ids, edges = own["cell_id"].to_numpy(np.int64), ends.get(sample, links.iloc[:0])
        out.append((np.stack(own["features"].to_numpy()), np.searchsorted(ids, edges["a"]), np.searchsorted(ids, edges["b"])))
    return out


def _round(shared, epochs: int, seed: int, stopper: Stopper | None):
    """Training of one group's samples, as a function of the group's key, nodes and links."""

    def run(key: tuple, own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"n": [], "samples": [], "losses": [], "steps": [], "flat": []})
        graphs, mine = _graphs(own, edges), copy.deepcopy(shared.value)
        losses = train_on(mine, graphs, epochs, seed + int(key[0]), copy.deepcopy(stopper))
        return pd.DataFrame({"n": [len(own)], "samples": [len(graphs)], "losses": [losses], "steps": [mine.steps], "flat": [mine.flat()]})

    return run


def fit_encoder(features: DataFrame, adj: DataFrame, epochs: int = 300, hidden: int = 64, out: int = 32, seed: int = 0, patience: int = 20, min_delta: float = 1e-4, min_epochs: int = 50, group_cells: int = GROUP_CELLS) -> Encoder:
    """An encoder trained on every sample, one graph a step.

    Samples are dealt by hash into groups of about ``group_cells`` cells, one task each. A group trains by itself for a round of
    ``patience`` epochs from the common weights; then weights and moments are averaged by cells. One group is trained in one go. The
    loss that stops training is the mean over all samples.
    """
    total = features.count()
    groups = max(1, -(-total // group_cells))
    number = F.pmod(F.xxhash64("sample_id"), F.lit(groups)).cast("int").alias("group")
    nodes, links = staged(features.select(number, *KEY, "features"), "encoder-nodes"), staged(adj.select(number, "sample_id", "a", "b"), "encoder-links")
    first = nodes.select(F.size("features").alias("n")).first()
    encoder = Encoder(first["n"] if first else 0, hidden, out, seed=seed)
    if first is None:
        return encoder
    stopper = Stopper(patience, min_delta, min_epochs)
    spark, epoch = features.sparkSession, 0
    while epoch < epochs:
        span = epochs if groups == 1 else min(patience, epochs - epoch)
        shared = spark.sparkContext.broadcast(encoder)
        run = _round(shared, span, seed + 7919 * epoch, stopper if groups == 1 else None)
        # Dealt by number: adaptive execution would put several small groups into one task.
        dealt = [df.repartition(8 * groups, "group").groupBy("group") for df in (nodes, links)]
        trained = dealt[0].cogroup(dealt[1]).applyInPandas(run, "n long, samples long, losses array<double>, steps long, flat array<double>")
        trained = staged(trained, "encoder-round")
        weighted = lambda column, by: trained.select(by, F.posexplode(column).alias("i", "x")).groupBy("i").agg((F.sum(F.col(by) * F.col("x")) / F.sum(by)).alias("x")).orderBy("i")
        flat = weighted("flat", "n").toArrow().column("x").to_numpy()
        losses = [r["x"] for r in weighted("losses", "samples").collect()]
        encoder.load(flat, int(trained.agg(F.max("steps")).first()[0]))
        discard(trained)
        epoch += span
        if any([stopper.done(x) for x in losses]):
            break
    discard(nodes, links)
    return encoder


def encode(features: DataFrame, adj: DataFrame, epochs: int = 300, hidden: int = 64, out: int = 32, seed: int = 0, group_cells: int = GROUP_CELLS, **stop: float) -> DataFrame:
    """sample_id, cell_id, features: the embedding of each cell by :func:`fit_encoder`; every sample is encoded in its own task."""
    encoder = fit_encoder(features, adj, epochs, hidden, out, seed, group_cells=group_cells, **stop)
    shared = features.sparkSession.sparkContext.broadcast(encoder.w)

    def run(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("cell_id", kind="stable")
        if not len(nodes):
            return pd.DataFrame({"sample_id": [], "cell_id": [], "features": []})
        ids = nodes["cell_id"].to_numpy(np.int64)
        conv = _normalised(len(ids), np.searchsorted(ids, links["a"]), np.searchsorted(ids, links["b"]))
        w = shared.value
        z = conv(np.maximum(conv(np.stack(nodes["features"].to_numpy())) @ w[0], 0) @ w[1])
        return pd.DataFrame({"sample_id": nodes["sample_id"], "cell_id": ids, "features": list(z)})

    return features.groupBy("sample_id").cogroup(adj.select("sample_id", "a", "b").groupBy("sample_id")).applyInPandas(run, "sample_id long, cell_id long, features array<double>")


def labelled(cells: DataFrame, adj: DataFrame, labels: DataFrame) -> DataFrame:
    """niche_id of every cell, null for cells without a neighbour."""
    inside = graph.connected(labels, adj)
    return cells.select(*KEY).join(inside.select(*KEY, "niche_id"), KEY, "left")
