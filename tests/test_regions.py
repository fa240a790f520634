"""Regions by shared boundaries against circumcentres, and their written forms."""

import struct

import numpy as np

from cytoplan.functions.geometry import clip_half_plane, multipolygon_wkb
from cytoplan.operators import graph, regions
from cytoplan.sources import tables
from cytoplan.sources.stage import staged


def overlap(xy, triangles, i, j, radius):
    """Length of the Voronoi edge of two points within the disks about them, from the circumcentres beside it."""
    centres = []
    for t in triangles:
        if i in t and j in t:
            (ax, ay), (bx, by), (cx, cy) = xy[t]
            d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
            u = np.array([(ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by), (ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)]) / d
            third = next(k for k in t if k not in (i, j))
            centres.append((u, xy[third]))
    middle, side = (xy[i] + xy[j]) / 2, xy[j] - xy[i]
    along = np.array([-side[1], side[0]]) / np.hypot(*side)
    half = np.sqrt(max(0, radius**2 - (side @ side) / 4))
    low, high = -half, half
    for u, third in centres:  # the edge ends at the circumcentre on the third point's side
        t, towards = (u - middle) @ along, (third - middle) @ along
        if towards > 0 and len(centres) == 1 or len(centres) == 2 and u is max(centres, key=lambda c: (c[0] - middle) @ along)[0]:
            high = min(high, t)
        else:
            low = max(low, t)
    return max(0.0, high - low)


def test_cells_merge_over_shared_boundaries(spark):
    rng = np.random.default_rng(8)
    xy = rng.random((90, 2)) * 260  # some neighbours within reach, some not
    cells = spark.createDataFrame([(1, k, float(x), float(y), "x") for k, (x, y) in enumerate(xy)], tables.CELLS)
    edges = staged(graph.delaunay_edges(cells), "edges")
    triangles = np.array([(r.a, r.b, r.c) for r in graph.delaunay_triangles(cells).collect()])
    niche = [k % 2 for k in range(90)]
    root = list(range(90))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    unsure = 0
    for r in edges.collect():
        shared = overlap(xy, triangles, r.src, r.dst, 15.0)
        unsure += abs(shared - regions.BORDER) < 0.1
        if shared > regions.BORDER and niche[r.src] == niche[r.dst]:
            a, b = sorted((find(r.src), find(r.dst)))
            root[b] = a
    labels = spark.createDataFrame([(1, k, n) for k, n in enumerate(niche)], "sample_id long, cell_id long, niche_id int")
    got = regions.niche_regions(cells, labels, edges).collect()
    want = {}
    for k in range(90):
        want[find(k)] = want.get(find(k), 0) + 1
    assert unsure == 0 and {r.region_id: r.n_cells for r in got} == want and 10 < len(want) < 80
    assert abs(sum(r.area for r in got) - sum(r.area for r in regions.voronoi_cells(cells, edges).collect())) < 1e-6
    r = max(got, key=lambda r: r.n_cells)
    assert r.wkt.startswith("MULTIPOLYGON (((") and struct.unpack_from("<BII", r.wkb) == (1, 6, r.n_cells)
    hot = regions.one_hot(spark.createDataFrame(got), 2).where(f"region_id = {r.region_id}").first()
    assert (hot.niche_0, hot.niche_1) == ((1.0, 0.0) if r.niche_id == 0 else (0.0, 1.0))


def test_areas_equal_a_fine_grid(spark):
    rng = np.random.default_rng(9)
    xy = rng.random((30, 2)) * 60
    cells = spark.createDataFrame([(1, k, float(x), float(y), "x") for k, (x, y) in enumerate(xy)], tables.CELLS)
    got = {r.cell_id: r.area for r in regions.voronoi_cells(cells, graph.delaunay_edges(cells)).collect()}
    step = 0.1
    g = np.stack(np.meshgrid(np.arange(-20, 80, step), np.arange(-20, 80, step)), -1).reshape(-1, 2)
    d = np.stack([((g - p) ** 2).sum(1) for p in xy])
    own = d.argmin(0)[d.min(0) < 225]
    for k, n in zip(*np.unique(own, return_counts=True), strict=True):
        assert abs(n * step * step - got[k]) < 0.02 * got[k] + 0.3


def test_clipping_and_binary():
    square = np.array([[0.0, 0], [2, 0], [2, 2], [0, 2]])
    half = clip_half_plane(square, np.array([1.0, 1]), np.array([1.0, 0]))
    assert {tuple(p) for p in half.tolist()} == {(0, 0), (1, 0), (1, 2), (0, 2)}
    assert len(clip_half_plane(square, np.array([-1.0, 0]), np.array([1.0, 0]))) == 0
    assert len(multipolygon_wkb([square])) == 9 + 13 + 5 * 16 and multipolygon_wkb([]) == struct.pack("<BII", 1, 6, 0)
