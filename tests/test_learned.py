"""Queries whose results SQL cannot say, against what must hold of them."""

import numpy as np
import pytest

import __spark_entry__ as entry
from cytoplan.operators import cluster, graph
from cytoplan.plans.catalog import World
from cytoplan.sources.stage import staged

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def world(spark):
    return World(spark, SF)


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_components_of_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x -= x.mean(0)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    got = {r.vec_id: r.features for r in run(spark, "pca_features")}
    got = np.array([got[r.vec_id] for r in rows])
    assert np.allclose(np.abs(got), np.abs(x @ vt[:8].T), atol=2e-3) and np.allclose((got**2).sum(0), s[:8] ** 2, rtol=1e-3)


@pytest.mark.parametrize("name", ["kmeans_niches", "kmeans_by_sample"])
def test_cells_are_in_their_nearest_cluster(spark, world, name):
    x = {(r.sample_id, r.cell_id): np.array(r.features) for r in world.cell_features().collect()}
    found = {}
    for r in run(spark, name):
        if r.niche_id is not None:
            found.setdefault(r.sample_id if name == "kmeans_by_sample" else 0, []).append((x[r.sample_id, r.cell_id], r.niche_id))
    wrong = total = 0
    for rows in found.values():
        v, label = np.stack([a for a, _ in rows]), np.array([n for _, n in rows])
        names = np.unique(label)
        centre = np.stack([v[label == n].mean(0) for n in names])
        wrong += int((names[((v[:, None] - centre[None]) ** 2).sum(2).argmin(1)] != label).sum())
        total += len(label)
        assert len(names) <= 4
    assert total > 1400 and wrong <= 0.03 * total


def test_communities_of_embeddings(spark):
    edges = cluster.knn_graph(cluster.knn(spark.read.parquet(f"{SF}/embeddings.parquet"))).collect()
    rows = run(spark, "leiden_sweep")
    best = []
    for resolution in {r.resolution for r in rows}:
        label = {r.node: r.niche_id for r in rows if r.resolution == resolution}
        degree, inside = {}, 0
        for e in edges:
            inside += label[e.lo] == label[e.hi]
            for end in (e.lo, e.hi):
                degree[label[end]] = degree.get(label[end], 0) + 1
        q = inside / len(edges) - sum((d / (2 * len(edges))) ** 2 for d in degree.values())
        stated = {(r.modularity, r.min_frac) for r in rows if r.resolution == resolution}
        sizes = np.bincount(list(label.values()))
        assert len(stated) == 1 and abs(stated.copy().pop()[0] - q) < 1e-9 and abs(stated.pop()[1] - sizes.min() / sizes.sum()) < 1e-9
        best.append(q)
        # Communities hang together.
        root = {n: n for n in label}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for e in edges:
            if label[e.lo] == label[e.hi]:
                a, b = sorted((find(e.lo), find(e.hi)))
                root[b] = a
        assert len({find(n) for n in label}) == len(sizes)
    assert max(best) > 0.25


def test_communities_of_planted_groups():
    rng = np.random.default_rng(2)
    group = np.repeat(np.arange(8), 30)
    i, j = np.triu_indices(240, 1)
    keep = rng.random(len(i)) < np.where(group[i] == group[j], 0.4, 0.01)
    for seed in range(3):
        found = cluster.communities(240, i[keep], j[keep], 1.0, seed)
        assert cluster.nmi_of(found, group) > 0.95
        assert cluster.modularity(i[keep], j[keep], found) >= cluster.modularity(i[keep], j[keep], group) - 0.01
    # Two cliques and a bridge; without edges every node is alone.
    assert len(set(cluster.communities(5, np.array([0]), np.array([1]), 1.0, 0))) == 4


def test_embeddings_tell_neighbourhoods_apart(spark, world):
    rows = run(spark, "dgi_embeddings")
    assert len(rows) == world.cell_features().count() and all(len(r.features) == 32 for r in rows)
    z = {(r.sample_id, r.cell_id): np.array(r.features) for r in rows}
    near = world.adj.select("sample_id", "a", "b").collect()
    rng = np.random.default_rng(0)
    keys = list(z)
    beside = np.mean([((z[r.sample_id, r.a] - z[r.sample_id, r.b]) ** 2).sum() for r in near])
    apart = np.mean([((z[keys[i]] - z[keys[j]]) ** 2).sum() for i, j in rng.integers(0, len(keys), (4000, 2))])
    assert np.isfinite(beside) and beside < 0.6 * apart


def test_expression_components_over_hops(spark, world):
    x = {}
    for r in world.expression.collect():
        x.setdefault((r.sample_id, r.cell_id), {})[r.gene] = r.value or 0.0
    genes = sorted({g for v in x.values() for g in v})
    keys = [(r.sample_id, r.cell_id) for r in world.cells.collect()]
    m = np.array([[x.get(k, {}).get(g, 0.0) for g in genes] for k in keys])
    m -= m.mean(0)
    scores = dict(zip(keys, m @ np.linalg.svd(m, full_matrices=False)[2][:2].T, strict=True))
    rings = {}
    for r in staged(graph.rings(world.cells, world.adj, 2), "rings").collect():
        rings.setdefault((r.sample_id, r.a, r.hop), []).append(scores[r.sample_id, r.b])
    got = run(spark, "niche_expression_pca")
    assert len(got) == len(keys)
    for r in got:
        want = np.concatenate([np.mean(rings[r.sample_id, r.cell_id, h], 0) if (r.sample_id, r.cell_id, h) in rings else np.zeros(2) for h in range(3)])
        assert np.allclose(np.abs(r.features), np.abs(want), atol=2e-3 * max(1, np.abs(want).max()))
