import numpy as np
import pytest

from cytoplan.functions import geometry as G


@pytest.mark.parametrize("n", [3, 4, 10, 60, 400])
def test_delaunay_has_empty_circles_and_eulers_number(n):
    p = np.random.default_rng(n).random((n, 2)) * 100
    t = G.delaunay(p)
    e = G.triangle_edges(t)
    assert n - len(e) + len(t) == 1 and len(t) == 2 * n - 2 - len(G.convex_hull(p))
    for a, b, c in t[:80]:
        m = 2 * np.array([p[b] - p[a], p[c] - p[a]])
        u = np.linalg.solve(m, [p[b] @ p[b] - p[a] @ p[a], p[c] @ p[c] - p[a] @ p[a]])
        assert (((p - u) ** 2).sum(1) >= ((p[a] - u) ** 2).sum() - 1e-6).all()


def test_delaunay_of_degenerate_points():
    assert len(G.delaunay(np.zeros((0, 2)))) == 0
    assert len(G.delaunay(np.array([(i, 2 * i) for i in range(9)]))) == 0
    assert len(G.delaunay(np.array([(0, 0), (1, 0), (0, 1), (0, 0), (1, 0)]))) == 1
    grid = np.array([(x, y) for x in range(12) for y in range(12)])
    assert len(G.delaunay(grid)) == 2 * 11 * 11


def test_hull_and_area():
    p = np.array([(0, 0), (4, 0), (4, 3), (0, 3), (2, 1), (2, 0)])
    assert G.polygon_area(G.convex_hull(p)) == 12
    assert G.polygon_area(G.convex_hull(p[[0, 1, 5]])) == 0


def test_capped_voronoi_cells_tile_the_inside():
    p = np.array([(x, y) for x in range(0, 50, 10) for y in range(0, 50, 10)], float)
    cell = G.voronoi_cell(p, 12, np.array([7, 11, 13, 17]), 100.0)
    assert abs(G.polygon_area(cell) - 100) < 1e-9
    alone = G.voronoi_cell(p, 0, np.array([], int), 15.0)
    assert abs(G.polygon_area(alone) - np.pi * 225) < 2
