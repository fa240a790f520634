"""What large tables need of the learned niches: narrow convolutions, searches in tasks of their own, rows computed once."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cytoplan.operators import cluster, communities, outlines
from cytoplan.sources.stage import CLEANS, staged


def test_a_training_step_convolves_single_columns_only():
    rng = np.random.default_rng(0)
    n, edges = 60, rng.integers(0, 60, (150, 2))
    edges = np.unique(np.sort(edges[edges[:, 0] != edges[:, 1]], 1), axis=0)
    a, b = np.concatenate([edges, edges[:, ::-1]]).T
    conv, x, seen = cluster._normalised(n, a, b), rng.normal(size=(n, 5)), []
    dense = np.zeros((n, n))
    degree = np.bincount(a, minlength=n) + 1.0
    dense[a, b] = 1 / np.sqrt(degree[a] * degree[b])
    dense += np.diag(1 / degree)
    assert np.allclose(conv(x), dense @ x)
    encoder = cluster.Encoder(5, 64, 32)
    w = [p.copy() for p in encoder.w]

    def counted(y):
        seen.append(y.shape[1])
        return conv(y)

    loss = encoder.step(x, conv(x), counted, np.random.default_rng(1))
    assert sum(seen) <= 5 + 1 + 2 + 2  # the shuffled features and columns; the hidden layer has 64
    # The loss by the plain formula, with the same random numbers.
    again = np.random.default_rng(1)
    h = [np.maximum(dense @ y @ w[0], 0) for y in (x, x[again.permutation(n)])]
    z = [dense @ (y * (again.random(y.shape) >= 0.2) / 0.8) @ w[1] for y in h]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    p = [sigmoid(y @ (w[2] @ sigmoid(z[0].mean(0)))) for y in z]
    assert abs(loss + np.log(p[0] + 1e-9).mean() + np.log(1 - p[1] + 1e-9).mean()) < 1e-12


def test_every_search_of_a_small_graph_is_a_task(spark):
    rows = [(0, i, (i + 1) % 40 if (i + 1) % 40 > i else i, 1.0) for i in range(39)]
    found = communities.runs(spark.createDataFrame(rows, "grp long, lo long, hi long, w double"))
    assert found.select("resolution", "repeat").distinct().count() == 15
    assert found.select(F.input_file_name()).distinct().count() >= 10


def test_searches_read_graphs_and_shuffle_no_edge(spark, monkeypatch):
    plans, plain = {}, communities.staged

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(communities, "staged", spy)
    rng = np.random.default_rng(4)
    edges = np.unique(np.sort(rng.integers(0, 90, (500, 2)), 1), axis=0)
    rows = [(g, int(a) * 11, int(b) * 11, float(1 + g * (a % 3))) for g in (0, 5) for a, b in edges if a < b]
    found = communities.runs(spark.createDataFrame(rows, "grp long, lo long, hi long, w double").repartition(3), (0.5, 2.0), 2)
    assert "Exchange" in plans["graphs"] and "Exchange" not in plans["communities"]
    got = {(r.grp, r.resolution, r.repeat): r.labels for r in found.collect()}
    assert len(got) == 8
    for (g, resolution, repeat), labels in got.items():
        own = np.array([r[1:] for r in rows if r[0] == g])
        own = own[np.lexsort((own[:, 1], own[:, 0]))]
        nodes, at = np.unique(own[:, :2].astype(int), return_inverse=True)
        at = at.reshape(-1, 2)
        assert labels == cluster.communities(len(nodes), at[:, 0], at[:, 1], resolution, repeat, own[:, 2]).tolist()


def test_shuffle_files_of_a_staged_plan_go(spark):
    blocks = lambda: sum(b.isShuffle() for b in _all(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()))
    before = blocks()
    out = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(100):
        if blocks() <= before:
            break
        time.sleep(0.1)
    assert blocks() <= before and out.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get(CLEANS, None) is None


def _all(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_nearest_by_products_equal_those_by_differences(spark):
    rng = np.random.default_rng(2)
    v = rng.random((300, 6)).astype(np.float32)
    v[40:80], v[100:103] = v[40], v[100] + np.float32(1e-6)  # copies, and rows that single precision can hardly tell apart
    rows = spark.createDataFrame([(i * 3, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    got = {(r.a, r["rank"]): (r.b, r.d2) for r in cluster.knn(rows, 7, asks=50, has=120).collect()}
    v = v.astype(float)
    want = {}
    for i in range(300):
        d = ((v - v[i]) ** 2).sum(1)
        d[i] = np.inf
        want.update({(i * 3, k + 1): (int(j) * 3, d[j]) for k, j in enumerate(np.lexsort((np.arange(300), d))[:7])})
    assert got == want


def test_kmeans_computes_its_rows_once(spark):
    count = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            count.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame(pd.DataFrame({"sample_id": 1, "cell_id": range(90), "features": [[float(i % 3), float(i)] for i in range(90)]}), "sample_id long, cell_id long, features array<double>")
    assert cluster.kmeans(rows.mapInPandas(run, rows.schema), 3).count() == 90 and count.value == 90


def test_many_shells_and_holes_are_assembled_in_seconds():
    rng = np.random.default_rng(3)
    cells = np.argwhere(rng.random((8, 4000)) < 0.6)
    there = {tuple(c) for c in cells.tolist()}
    around = (((0, 0), (1, 0), (0, -1)), ((1, 0), (1, 1), (1, 0)), ((1, 1), (0, 1), (0, 1)), ((0, 1), (0, 0), (-1, 0)))
    sides = np.array([(i + a, j + b, i + c, j + d) for i, j in there for (a, b), (c, d), (u, v) in around if (i + u, j + v) not in there], float)
    began = time.perf_counter()
    polygons = outlines.assembled(outlines.rings_of(sides))
    assert time.perf_counter() - began < 20  # before: minutes
    assert abs(sum(outlines.signed_area(r) for p in polygons for r in p) - len(cells)) < 1e-6
    shells = [p[0] for p in polygons][::-1]
    for p in polygons[:40]:
        for hole in p[1:][:5]:
            x, y = (hole[0] + hole[1]) / 2
            inside = []
            for r in shells:
                u, v = np.roll(r, -1, 0).T
                cross = (r[:, 1] > y) != (v > y)
                at = r[cross, 0] + (y - r[cross, 1]) / (v[cross] - r[cross, 1]) * (u[cross] - r[cross, 0])
                inside.append((at > x).sum() % 2)
            assert np.array_equal(shells[int(np.argmax(inside))], p[0])


def test_sides_shorter_than_the_overlap_make_no_pairs(spark, monkeypatch):
    rows = [(1, 0, i, 0.0, 0.25 * i, 0.5, 0.25 * i) for i in range(30)] + [(1, 0, 100, 0.0, 20.0, 4.0, 20.0), (1, 0, 101, 1.0, 20.0, 5.0, 20.0)]
    df = spark.createDataFrame(rows, "sample_id long, label int, owner long, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in outlines.overlapping_sides(df).collect()] == [(1, 100, 101)]
    # Whatever comes to the test of a pair passes it.
    for name in ("boxes_meet", "parallel", "within"):
        monkeypatch.setattr(outlines.S, name, lambda *_: F.lit(True))
    monkeypatch.setattr(outlines.S, "common_length", lambda *_: F.lit(9.0))
    assert [tuple(r) for r in outlines.overlapping_sides(df).collect()] == [(1, 100, 101)]


def test_centres_are_fitted_in_many_tasks_and_the_same_each_time(spark, monkeypatch):
    seen, fit = [], communities.KMeans.fit
    monkeypatch.setattr(communities.KMeans, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), self.getInitMode())) or fit(self, df))
    data = spark.range(2000).selectExpr("id", "array(sin(id), cos(id * 7), cast(id % 13 AS double) / 3) AS v")
    a, b = (communities._centres(df, 2000, 64, 0) for df in (data, data.repartition(5)))
    assert np.array_equal(a, b) and len(a) == 32
    assert seen == [(communities.TASKS, "random")] * 2  # in one task, begun by a clustering in the driver, before


def test_queries_of_embeddings_stage_no_cells(spark):
    from cytoplan.plans import catalog

    world = catalog.World(spark, "/root/testdata/sf0.001")
    world.embeddings().count()
    assert world._cells is None and world.cells.count() == world.cells.distinct().count() > 0
