"""Plane geometry on numpy arrays: Delaunay triangulation, convex hulls, capped Voronoi cells."""

from __future__ import annotations

import struct
from fractions import Fraction

import numpy as np

_GHOST = -1
#: Relative rounding bounds under which a determinant's sign is decided exactly.
_ORIENT_EPS, _CIRCLE_EPS = 4e-16, 2e-15
#: Triangles with less than this share of the squared extent as twice their area are no triangles.
FLAT = 1e-13


def _orient(a, b, c) -> float:
    """Positive if a, b, c turn left."""
    l, r = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    d = l - r
    if abs(d) > _ORIENT_EPS * (abs(l) + abs(r)):
        return d
    a, b, c = ([Fraction(v) for v in p] for p in (a, b, c))
    exact = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (exact > 0) - (exact < 0)


def _in_circle(a, b, c, p) -> bool:
    """Whether p lies strictly inside the circle through the left-turning a, b, c."""
    ax, ay, bx, by, cx, cy = a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1], c[0] - p[0], c[1] - p[1]
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    t1, t2, t3 = bx * cy - cx * by, cx * ay - ax * cy, ax * by - bx * ay
    d = a2 * t1 + b2 * t2 + c2 * t3
    size = a2 * (abs(bx * cy) + abs(cx * by)) + b2 * (abs(cx * ay) + abs(ax * cy)) + c2 * (abs(ax * by) + abs(bx * ay))
    if abs(d) > _CIRCLE_EPS * size:
        return d > 0
    a, b, c, p = ([Fraction(v) for v in q] for q in (a, b, c, p))
    ax, ay, bx, by, cx, cy = a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1], c[0] - p[0], c[1] - p[1]
    return (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three indices) of the Delaunay triangulation.

    Incremental insertion into a map from directed edges to opposite vertices; a ghost vertex closes the hull, so no point is made
    up. Of equal points the first is used. Fewer than three distinct points, or points on one line, give no triangles.
    """
    pts = [tuple(p) for p in np.asarray(points, float).tolist()]
    first: dict[tuple, int] = {}
    for i, p in enumerate(pts):
        first.setdefault(p, i)
    ids = list(first.values())
    if len(ids) < 3:
        return np.zeros((0, 3), np.int64)
    # Neighbours in the order are neighbours in the plane: rows of a grid, every other one backwards.
    xy = np.array([pts[i] for i in ids])
    side = max(1, int(np.sqrt(len(ids) / 2)))
    span = np.maximum(xy.max(0) - xy.min(0), 1e-300)
    cell = np.minimum(((xy - xy.min(0)) / span * side).astype(int), side - 1)
    order = np.lexsort((np.where(cell[:, 1] % 2, -xy[:, 0], xy[:, 0]), cell[:, 1]))
    ids = [ids[i] for i in order]
    a, b = ids[0], ids[1]
    third = next((k for k in range(2, len(ids)) if _orient(pts[a], pts[b], pts[ids[k]]) != 0), None)
    if third is None:
        return np.zeros((0, 3), np.int64)
    c = ids.pop(third)
    if _orient(pts[a], pts[b], pts[c]) < 0:
        a, b = b, a
    opposite: dict[tuple[int, int], int] = {}

    def add(u: int, v: int, w: int) -> None:
        opposite[u, v], opposite[v, w], opposite[w, u] = w, u, v

    def conflicts(u: int, v: int, w: int, p) -> bool:
        if _GHOST not in (u, v, w):
            return _in_circle(pts[u], pts[v], pts[w], p)
        while w != _GHOST:
            u, v, w = v, w, u
        turn = _orient(pts[u], pts[v], p)
        if turn:
            return turn > 0
        (ux, uy), (vx, vy) = pts[u], pts[v]
        return min(ux, vx) <= p[0] <= max(ux, vx) and min(uy, vy) <= p[1] <= max(uy, vy)

    for u, v, w in ((a, b, c), (b, a, _GHOST), (c, b, _GHOST), (a, c, _GHOST)):
        add(u, v, w)
    now = (a, b, c)
    for i in ids[2:]:
        p = pts[i]
        u, v, w = now
        for _ in range(len(pts) + 10):
            if _orient(pts[u], pts[v], p) < 0:
                u, v = v, u
            elif _orient(pts[v], pts[w], p) < 0:
                u, v = w, v
            elif _orient(pts[w], pts[u], p) < 0:
                u, v = u, w
            else:
                break
            w = opposite[u, v]
            if w == _GHOST:
                break
        else:
            u, v, w = next((x, y, z) for (x, y), z in opposite.items() if conflicts(x, y, z, p))
        # The triangles whose circles hold the point make a star-shaped hole; its rim is joined to the point.
        hole, stack, rim = {frozenset((u, v, w))}, [(u, v, w)], []
        dead = []
        while stack:
            t = stack.pop()
            dead.append(t)
            for x, y in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                z = opposite[y, x]
                name = frozenset((x, y, z))
                if name in hole:
                    continue
                if conflicts(y, x, z, p):
                    hole.add(name)
                    stack.append((y, x, z))
                else:
                    rim.append((x, y))
        for x, y, z in dead:
            for e in ((x, y), (y, z), (z, x)):
                opposite.pop(e, None)
        for x, y in rim:
            add(x, y, i)
            if _GHOST not in (x, y):
                now = (x, y, i)
    out = {tuple(sorted((u, v, w))) for (u, v), w in opposite.items() if _GHOST not in (u, v, w)}
    found = np.array(sorted(out), np.int64).reshape(-1, 3)
    # Along the hull, points on a line but for rounding make triangles without area.
    p, q, r = (np.array(pts)[found[:, k]] for k in range(3))
    area = np.abs((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]))
    return found[area > FLAT * float(span.max()) ** 2]


def triangle_edges(triangles: np.ndarray) -> np.ndarray:
    """Distinct sides, smaller index first."""
    if not len(triangles):
        return np.zeros((0, 2), np.int64)
    sides = np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [0, 2]]])
    return np.unique(np.sort(sides, axis=1), axis=0)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, turning left; fewer than three if the points are on one line."""
    pts = sorted(set(map(tuple, np.asarray(points, float).tolist())))
    if len(pts) < 3:
        return np.array(pts).reshape(-1, 2)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and _orient(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def polygon_area(polygon: np.ndarray) -> float:
    """Area of a simple polygon, 0 with fewer than three corners."""
    if len(polygon) < 3:
        return 0.0
    x, y = polygon[:, 0], polygon[:, 1]
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def clip_half_plane(polygon: np.ndarray, point: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """The part of a convex polygon with (q - point) . normal <= 0."""
    if not len(polygon):
        return polygon
    d = (polygon - point) @ normal
    if (d <= 0).all():
        return polygon
    after, to = np.roll(d, -1), np.roll(polygon, -1, axis=0)
    crosses = ((d < 0) & (after > 0)) | ((d > 0) & (after < 0))
    share = np.divide(d, d - after, out=np.zeros_like(d), where=crosses)
    both = np.stack([polygon, polygon + (to - polygon) * share[:, None]], 1)
    return both.reshape(-1, 2)[np.stack([d <= 0, crosses], 1).ravel()]


def _centre_of(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Circumcentres of triples (columns); the same bits in whatever order a triple comes."""
    order = np.argsort(ids, axis=1, kind="stable")
    (ax, bx, cx), (ay, by, cy) = (np.take_along_axis(v, order, 1).T for v in (x, y))
    bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
    b2, c2, d = bx * bx + by * by, cx * cx + cy * cy, 2 * (bx * cy - by * cx)
    with np.errstate(divide="ignore", invalid="ignore"):
        return ax + (cy * b2 - by * c2) / d, ay + (bx * c2 - cx * b2) / d


def capped_cells(ids: np.ndarray, xy: np.ndarray, first: np.ndarray, near: np.ndarray, near_xy: np.ndarray, radius: float, corners: int = 256) -> tuple[list[np.ndarray], np.ndarray]:
    """Voronoi cells cut to disks: the corners of each, turning left, and the length of the boundary with each neighbour.

    ``first[i]`` is the first of cell i's neighbours in ``near`` (ids) and ``near_xy``; they are its Delaunay neighbours, of which those
    nearer than twice the radius count. A cell's side with a neighbour lies on their bisector between the bisectors of the others and the
    disk, which is a computation on the line; so all sides of a batch are found at once. Corners are computed from the ids in order:
    cells that share one have the same bits. Arcs have the corners of a regular polygon.
    """
    n, count = len(ids), np.diff(first)
    out, length = [np.zeros((0, 2))] * n, np.zeros(len(near))
    turn = np.arange(corners) * 2 * np.pi / corners
    circle = radius * np.stack([np.cos(turn), np.sin(turn)], 1)
    by_degree = np.argsort(count, kind="stable")
    for at in range(0, n, 512):
        rows = by_degree[at : at + 512]
        d = int(count[rows].max()) if len(rows) else 0
        slot = np.minimum(first[rows, None] + np.arange(d), max(len(near) - 1, 0))
        there = np.arange(d) < count[rows, None]
        v = near_xy[slot] - xy[rows, None] if d else np.zeros((len(rows), 0, 2))
        square = (v**2).sum(2)
        there &= (square < 4 * radius * radius) & (square > 0)
        size = np.sqrt(np.where(there, square, 1))
        # Places on j's bisector are v_j / 2 + t * along_j; k's bisector bounds t.
        along = np.stack([-v[..., 1], v[..., 0]], 2) / size[..., None]
        slope = np.einsum("rjc,rkc->rjk", along, v)
        room = (square[:, None, :] - np.einsum("rjc,rkc->rjk", v, v)) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = room / slope
        usable = there[:, None, :] & there[:, :, None] & ~np.eye(d, dtype=bool)
        shut = (usable & (slope == 0) & (room < 0)).any(2)
        high_at, low_at = np.where(usable & (slope > 0), bound, np.inf), np.where(usable & (slope < 0), bound, -np.inf)
        half = np.sqrt(np.maximum(radius * radius - square / 4, 0))
        if d:
            top, bottom = high_at.argmin(2), low_at.argmax(2)
            high, low = np.minimum(high_at.min(2), half), np.maximum(low_at.max(2), -half)
            arc_high, arc_low = high_at.min(2) >= half, low_at.max(2) <= -half
        else:
            high = low = np.zeros((len(rows), 0))
        real = there & ~shut & (high - low > 1e-9)
        r, j = np.nonzero(real)
        length[slot[r, j]] = (high - low)[r, j]
        places = np.zeros((2, len(r), 2))
        for end, (other, on_arc, t) in enumerate(((bottom, arc_low, low), (top, arc_high, high)) if d else ()):
            third = other[r, j]
            three = np.stack([ids[rows[r]], near[slot[r, j]], near[slot[r, third]]], 1)
            xs, ys = (np.stack([xy[rows[r], c], near_xy[slot[r, j], c], near_xy[slot[r, third], c]], 1) for c in (0, 1))
            cx, cy = _centre_of(three, xs, ys)
            # On the disk: from the middle along the bisector, seen from the smaller id.
            swap = np.where(three[:, 0] < three[:, 1], 1.0, -1.0)
            wx, wy = swap * (xs[:, 1] - xs[:, 0]), swap * (ys[:, 1] - ys[:, 0])
            reach = np.sqrt(np.maximum(radius * radius - (wx * wx + wy * wy) / 4, 0)) / np.sqrt(wx * wx + wy * wy) * swap * (-1 if end == 0 else 1)
            mx, my = (xs[:, 0] + xs[:, 1]) / 2, (ys[:, 0] + ys[:, 1]) / 2
            own = on_arc[r, j] | ~np.isfinite(cx + cy)
            places[end] = np.stack([np.where(own, mx - reach * wy, cx), np.where(own, my + reach * wx, cy)], 1)
        ends = np.searchsorted(r, np.arange(len(rows) + 1))
        angle = np.arctan2(v[r, j, 1], v[r, j, 0])
        order = np.lexsort((angle, r))
        for k, row in enumerate(rows.tolist()):
            own = order[ends[k] : ends[k + 1]]
            if not len(own):
                out[row] = xy[row] + circle
                continue
            begin, stop = places[0, own], places[1, own]
            parts, after = [], np.roll(begin, -1, 0)
            open_ = arc_high[k, j[own]] & np.roll(arc_low[k, j[own]], -1)
            for s in range(len(own)):
                parts.append(begin[s : s + 1])
                if open_[s]:
                    parts.append(stop[s : s + 1])
                    a, b = (np.arctan2(q[1] - xy[row, 1], q[0] - xy[row, 0]) for q in (stop[s], after[s]))
                    b += 2 * np.pi * (b <= a)
                    inner = np.arange(np.floor(a / turn[1] + 1e-6) + 1, np.ceil(b / turn[1] - 1e-6)).astype(int)
                    parts.append(xy[row] + circle[inner % corners])
            out[row] = np.concatenate(parts)
    return out, length


def voronoi_cell(points: np.ndarray, i: int, neighbours: np.ndarray, radius: float, corners: int = 256) -> np.ndarray:
    """Corners of one cell; see :func:`capped_cells`."""
    ends = np.array([0, len(neighbours)])
    return capped_cells(np.array([i]), points[[i]], ends, np.asarray(neighbours, np.int64), points[neighbours], radius, corners)[0][0]


def multipolygon_wkb(polygons: list[np.ndarray]) -> bytes:
    """Well-known binary, little-endian, of polygons without holes; each ring is closed."""
    parts = [struct.pack("<BII", 1, 6, len(polygons))]
    for p in polygons:
        ring = np.concatenate([p, p[:1]]).astype("<f8")
        parts += [struct.pack("<BIII", 1, 3, 1, len(ring)), ring.tobytes()]
    return b"".join(parts)
