import numpy as np
import pandas as pd
import pytest

from cytoplan.operators import graph, tiling


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(5)
    even = rng.random((900, 2)) * 500
    ring = rng.normal(size=(700, 2))
    ring = ring / np.linalg.norm(ring, axis=1)[:, None] * (100 + 60 * rng.random((700, 1)))  # a hole wider than any halo
    clumps = np.concatenate([rng.normal(c, 4, (250, 2)) for c in ((0, 0), (300, 10), (40, 280))])
    twice = np.concatenate([even[:300], even[:40], [[9e3, -7e3]]])  # equal places and an outlier
    grid = np.array([(x, y) for x in range(28) for y in range(28)], float)
    line = np.stack([np.arange(300.0), 2 * np.arange(300.0)], 1)
    places = [even, ring, clumps, twice, grid, line, even[:7], np.zeros((40, 2))]
    rows = [pd.DataFrame({"sample_id": k, "cell_id": rng.permutation(len(p)) * 3 + k, "x_um": p[:, 0], "y_um": p[:, 1]}) for k, p in enumerate(places)]
    return spark.createDataFrame(pd.concat(rows)), places


def _set(df):
    return set(map(tuple, df.toPandas().itertuples(index=False)))


def test_tiles_give_the_triangles_of_whole_samples(samples, monkeypatch):
    cells, places = samples
    monkeypatch.setattr(tiling, "TILE_CELLS", 60)
    monkeypatch.setattr(tiling, "HALO", 3.0)
    kept = tiling.split(cells, 20)
    assert {r.sample_id for r in kept[0].select("sample_id").distinct().collect()} == {6}
    whole, tiled = (graph.delaunay_triangles(cells, n).toPandas() for n in (10**9, 20))
    assert not tiled.duplicated().any()
    for k in range(len(places)):
        a, b = (set(map(tuple, t[t["sample_id"] == k].itertuples(index=False))) for t in (whole, tiled))
        assert len(a) == len(b)
        if k != 4:  # squares of a grid may be cut either way
            assert a == b
    assert len(tiled[tiled["sample_id"] == 4]) == 2 * 27 * 27


def test_edges_of_tiles_are_those_of_their_triangles(samples, monkeypatch):
    cells, _ = samples
    cells = cells.where("sample_id in (1, 2, 6)")
    monkeypatch.setattr(tiling, "TILE_CELLS", 60)
    assert _set(graph.delaunay_edges(cells, 20)) == _set(graph.delaunay_edges(cells, 10**9))


def test_most_triangles_come_from_tiles(samples, monkeypatch):
    cells, _ = samples
    seen = []
    monkeypatch.setattr(tiling, "TILE_CELLS", 60)
    monkeypatch.setattr(tiling, "staged", lambda df, name, real=tiling.staged: seen.append((name, real(df, name))) or seen[-1][1])
    total = graph.delaunay_triangles(cells.where("sample_id = 0"), 20).count()
    sides = dict(seen)["tile-sides"]
    assert sides.count() > 0.85 * 3 * total and sides.select("src", "dst", "w").distinct().count() == sides.count()
