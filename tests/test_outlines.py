"""Sides of polygons: links, merging, dissolved outlines against nested loops and cell sets."""

import json
import math
import re
import struct

import numpy as np
import pytest

from cytoplan.functions import geometry as G
from cytoplan.operators import graph, outlines, regions
from cytoplan.sources import tables
from cytoplan.sources.stage import staged

KEPT = ("sample_id", "label", "owner")


def squares(spark, places, size=1.0):
    """Polygons: (sample, label, owner, x, y of the lower left corner)."""
    rows = [(s, lab, o, [float(x + d) for d in (0, size, size, 0)], [float(y + d) for d in (0, 0, size, size)]) for s, lab, o, x, y in places]
    return outlines.sides(spark.createDataFrame(rows, "sample_id long, label int, owner long, x array<double>, y array<double>"), *KEPT)


def rings_in(wkt):
    return [np.array([[float(v) for v in p.split()] for p in r.split(",")]) for r in re.findall(r"\(([-\d. ,]+)\)", wkt)]


def test_a_region_with_a_hole_and_one_that_touches_itself(spark):
    frame = [(1, 0, i, x, y) for i, (x, y) in enumerate((x, y) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 2)))]
    sides, owner, rounds = outlines.merged(squares(spark, frame), overlap=0.9)
    (r,) = outlines.outlines(sides).collect()
    assert (r.region_id, r.n_shells, r.n_holes, r.area, r.perimeter, rounds) == (0, 1, 2, 14.0, 24.0, 1) and {x.region for x in owner.collect()} == {0}
    shell, *holes = rings_in(r.wkt)
    assert r.wkt.startswith("POLYGON ((") and outlines.signed_area(shell[:-1]) == 16 and [outlines.signed_area(h[:-1]) for h in holes] == [-1, -1]
    assert struct.unpack_from("<BII", r.wkb) == (1, 3, 3) and np.allclose(json.loads(r.coords), shell)
    assert all((ring[0] == ring[-1]).all() and len({tuple(p) for p in ring[:-1].tolist()}) == len(ring) - 1 for ring in (shell, *holes))


def test_corners_alone_do_not_join_and_labels_and_samples_keep_apart(spark):
    places = [(1, 0, 0, 0, 0), (1, 0, 1, 1, 1), (1, 1, 2, 1, 0), (2, 0, 3, 1, 0), (1, 0, 4, 0, 1)]
    sides, _, _ = outlines.merged(squares(spark, places), overlap=0.9)
    got = {(r.sample_id, r.label, r.region_id): (r.n_shells, r.area) for r in outlines.outlines(sides).collect()}
    assert got == {(1, 0, 0): (1, 3.0), (1, 1, 2): (1, 1.0), (2, 0, 3): (1, 1.0)}


def test_sides_of_half_the_length_join_by_overlap(spark):
    """Squares beside a twice as large one have no side in common with it, but run along it."""
    large = squares(spark, [(1, 0, 9, 2, 0)], 4.0)
    small = squares(spark, [(1, 0, 1, 0, 1)], 2.0)
    assert outlines.shared_sides(large.union(small)).count() == 0
    assert [tuple(r) for r in outlines.overlapping_sides(large.union(small)).collect()] == [(1, 1, 9)]
    sides, _, rounds = outlines.merged(large.union(small))
    (r,) = outlines.outlines(sides).collect()
    assert rounds == 1 and r.area == 20.0
    chain = large.union(small).union(squares(spark, [(1, 0, 5, 6, 1), (1, 0, 7, 8, 1)], 2.0))
    assert outlines.merged(chain)[2] == 1 and outlines.merged(chain, most_rounds=0)[2] == 0


def common(s, t):
    """The rule of overlapping sides, written out for one pair."""
    (a, b, c, d), (e, f, g, h) = s, t
    if min(a, c) > max(e, g) or min(e, g) > max(a, c) or min(b, d) > max(f, h) or min(f, h) > max(b, d):
        return 0.0
    u, v = np.array([c - a, d - b]), np.array([g - e, h - f])
    turn = math.acos(max(-1.0, min(1.0, float(u @ v) / (np.hypot(*u) * np.hypot(*v)))))
    if min(turn, math.pi - turn) > math.radians(3):
        return 0.0
    # Segments that do not cross are nearest at an end of one of them.
    cross = lambda o, w, x: w[0] * (x[1] - o[1]) - w[1] * (x[0] - o[0])
    crossing = cross(s[:2], u, t[:2]) * cross(s[:2], u, t[2:]) < 0 and cross(t[:2], v, s[:2]) * cross(t[:2], v, s[2:]) < 0
    away = lambda x, o, w: np.hypot(*(np.array(x) - o - w * np.clip((np.array(x) - o) @ w / (w @ w), 0, 1)))
    if not crossing and min(*(away(x, np.array(t[:2]), v) for x in (s[:2], s[2:])), *(away(x, np.array(s[:2]), u) for x in (t[:2], t[2:]))) > 0.5:
        return 0.0
    spans = [sorted((x[0], x[2]) if abs(x[2] - x[0]) >= abs(x[3] - x[1]) else (x[1], x[3])) for x in (s, t)]
    return max(0.0, min(spans[0][1], spans[1][1]) - max(spans[0][0], spans[1][0]))


def test_overlaps_equal_a_nested_loop(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        turn, at = rng.choice([0.3, 0.32, 1.2, 2.5]) + rng.normal(0, 0.02), rng.random(2) * 40
        to = at + rng.choice([2, 6, 25]) * np.array([math.cos(turn), math.sin(turn)])
        rows.append((1, 0, i, *map(float, np.round(np.concatenate([at, to]) * 4) / 4)))
    df = spark.createDataFrame(rows, "sample_id long, label int, owner long, x0 double, y0 double, x1 double, y1 double")
    want = {(i, j) for i in range(240) for j in range(i + 1, 240) if common(rows[i][3:], rows[j][3:]) >= 1}
    for bucket in (outlines.BUCKET, 3.0, 1000.0):
        found = outlines.overlapping_sides(df, bucket=bucket)
        assert {(r.a, r.b) for r in found.collect()} == want and len(want) > 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_repeated_polygons_are_linked_by_stars(spark):
    many = squares(spark, [(1, 0, i, 0, 0) for i in range(300)], 2.0)
    assert sorted(r.b for r in outlines.shared_sides(many).collect()) == list(range(1, 300))
    assert sorted(r.b for r in outlines.overlapping_sides(many).collect()) == list(range(1, 300))


def test_empty_and_flat_polygons(spark):
    schema = "sample_id long, label int, owner long, x array<double>, y array<double>"
    odd = spark.createDataFrame([(1, 0, 1, [], []), (1, 0, 2, [0.0, 1.0], [0.0, 1.0]), (1, 0, 3, None, None), (1, 0, 4, [0.0, 1e-5, 0.0], [0.0, 0.0, 1e-5])], schema)
    rows = outlines.sides(odd, *KEPT)
    assert outlines.outlines(outlines.merged(rows)[0]).count() == 0 and outlines.merged(rows.limit(0))[2] == 0


@pytest.fixture(scope="module")
def tissue(spark):
    rng = np.random.default_rng(12)
    xy = rng.random((500, 2)) * 330
    niche = ((xy[:, 0] // 60 + xy[:, 1] // 80) % 3).astype(int)
    cells = staged(spark.createDataFrame([(1, k, float(x), float(y), "x") for k, (x, y) in enumerate(xy)], tables.CELLS), "tissue")
    labels = spark.createDataFrame([(1, k, int(n)) for k, n in enumerate(niche)], "sample_id long, cell_id long, niche_id int")
    return xy, niche, cells, labels, staged(graph.delaunay_edges(cells), "tissue-edges")


def test_outlines_of_500_cells(tissue):
    xy, niche, cells, labels, edges = tissue
    shapes = {r.cell_id: r for r in regions.voronoi_cells(cells, edges).collect()}
    found, rounds = regions.niche_outlines(cells, labels, edges)
    got = found.collect()
    # Cells of one niche with a boundary that the grid shows are one region.
    root = list(range(500))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in shapes.items():
        for b in s.borders:
            if b.length > 0.6 and niche[k] == niche[b.b]:
                x, y = sorted((find(k), find(b.b)))
                root[y] = x
    area = {}
    for k in range(500):
        area[find(k)] = area.get(find(k), 0) + shapes[k].area
    assert rounds >= 1 and len(got) <= len(area)
    for r in got:
        own = [k for k in area if k == r.region_id]
        rings = rings_in(r.wkt)
        signed = [outlines.signed_area(x[:-1]) for x in rings]
        assert len(own) == 1 and r.n_shells == 1 and r.wkt.startswith("POLYGON") and signed[0] > 0 and all(v < 0 for v in signed[1:])
        assert abs(sum(signed) - r.area) < 1e-2
    assert abs(sum(r.area for r in got) - sum(area.values())) < 1e-5
    exact = {r.region_id: r.area for r in got}
    same = [k for k in exact if abs(exact[k] - area[k]) < 1e-6]
    assert len(same) > 0.8 * len(exact)  # others have grown over boundaries shorter than that


def test_cells_share_corners_bit_by_bit(tissue):
    xy, _, cells, _, edges = tissue
    rows = {r.cell_id: np.stack([r.x, r.y], 1) for r in regions.voronoi_cells(cells, edges).collect()}
    sides = {}
    for k, p in rows.items():
        for a, b in zip(p.tolist(), np.roll(p, -1, 0).tolist()):
            sides.setdefault((tuple(a), tuple(b)), []).append(k)
    inner = sum((b, a) in sides for a, b in sides)
    borders = sum(b.length > 1e-6 for r in regions.voronoi_cells(cells, edges).collect() for b in r.borders)
    assert all(len(v) == 1 for v in sides.values()) and inner >= borders - 4


def test_capped_cells_equal_clipping(tissue):
    xy, _, _, _, _ = tissue
    t = G.delaunay(xy)
    e = G.triangle_edges(t)
    near = [np.concatenate([e[e[:, 0] == i, 1], e[e[:, 1] == i, 0]]) for i in range(len(xy))]
    first = np.append(0, np.cumsum([len(x) for x in near]))
    shapes, _ = G.capped_cells(np.arange(len(xy)), xy, first, np.concatenate(near), xy[np.concatenate(near)], 15.0)
    turn = np.arange(2048) * 2 * np.pi / 2048
    for i in range(0, 500, 7):
        cell = xy[i] + 15.0 * np.stack([np.cos(turn), np.sin(turn)], 1)
        for j in near[i]:
            cell = G.clip_half_plane(cell, (xy[i] + xy[j]) / 2, xy[j] - xy[i])
        assert abs(G.polygon_area(cell) - G.polygon_area(shapes[i])) < 0.1


def test_regular_places_with_four_cells_at_a_corner(spark):
    cells = spark.createDataFrame([(1, 8 * i + j, 10.0 * i, 10.0 * j, "x") for i in range(8) for j in range(8)], tables.CELLS)
    labels = spark.createDataFrame([(1, 8 * i + j, int(2 <= i < 6 and 2 <= j < 6)) for i in range(8) for j in range(8)], "sample_id long, cell_id long, niche_id int")
    got = {r.label: r for r in regions.niche_outlines(cells, labels, graph.delaunay_edges(cells))[0].collect()}
    assert abs(got[1].area - 1600) < 1e-6 and (got[0].n_shells, got[0].n_holes, got[1].n_holes) == (1, 1, 0) and abs(got[1].perimeter - 160) < 1e-6
