"""Polygons by their sides: shared and overlapping sides, merging to a fixed point, dissolved outlines.

A polygon is the set of its directed sides (x0, y0, x1, y1), the inside on their left. Polygons of one sample meet only where they have
the same label. Links between polygons are spanning: of all polygons on one side, or on equal segments, each is linked to the one of the
smallest id, never all with all; where at most two meet, as in a tessellation, these are all pairs.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segments as S
from ..functions.geometry import polygon_area
from ..sources.stage import discard, staged
from . import graph

#: Grid that tells corners apart: far finer than cells, coarser than rounding, and no corner of decimal places lies between two lines.
FINE = 2.0**-14
#: Grid of the merge, and its tolerances: degrees, distance, common length.
GRID, ANGLE, DISTANCE, OVERLAP = 0.25, 3.0, 0.5, 1.0
#: Side of the squares that segments are dealt to.
BUCKET = 16.0
MOST_ROUNDS = 6
ENDS = ["x0", "y0", "x1", "y1"]


def sides(polygons: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and x0, y0, x1, y1 of every side of polygons given by arrays x and y of their corners; fewer than three corners have none."""
    n = F.size("x")
    after = lambda c: F.concat(F.slice(c, 2, F.greatest(n - 1, F.lit(0))), F.slice(c, 1, 1))
    rows = F.arrays_zip(F.col("x").alias("x0"), F.col("y").alias("y0"), after("x").alias("x1"), after("y").alias("y1"))
    return polygons.where(n > 2).select(*keep, F.inline(rows))


def _keyed(rows: DataFrame, grid: float) -> DataFrame:
    """Sides with ``key`` and ``forward`` on the grid; those that have no length there are left out."""
    name, forward = S.key(*[S.on_grid(c, grid) for c in ENDS])
    return rows.select("*", name.alias("key"), forward.alias("forward")).where("key.ax <> key.bx or key.ay <> key.by")


def _spanning(rows: DataFrame, *same: str) -> DataFrame:
    """sample_id, a, b (a < b): each owner of equal ``same`` with the smallest of them."""
    least = rows.groupBy(*same).agg(F.min("owner").alias("a"), F.max("owner").alias("last")).where("a < last").drop("last")
    return rows.join(least, list(same)).where("a < owner").select("sample_id", "a", F.col("owner").alias("b")).distinct()


def shared_sides(rows: DataFrame, grid: float = GRID) -> DataFrame:
    """sample_id, a, b of polygons that have a side in common on the grid, in either direction. rows: sample_id, label, owner, ends."""
    return _spanning(_keyed(rows, grid).select("sample_id", "label", "owner", "key"), "sample_id", "label", "key")


def overlapping_sides(rows: DataFrame, grid: float = GRID, angle: float = ANGLE, distance: float = DISTANCE, overlap: float = OVERLAP, bucket: float = BUCKET) -> DataFrame:
    """sample_id, a, b of polygons with sides on the grid that are parallel, near and long enough beside each other.

    Segments are dealt to the squares that their boxes, grown by ``distance``, meet; a pair is tested in the square of the lower left
    corner of what their boxes have in common, so once only. Equal segments count once, as the owner of the smallest id.
    """
    on = _keyed(rows, grid)
    same = ["sample_id", "label", "key"]
    place = lambda c: F.col(f"key.{c}") * F.lit(grid)
    # What two sides have in common is no longer than either: shorter ones, such as those of arcs, pair with none.
    one = on.where(F.greatest(F.abs(place("bx") - place("ax")), F.abs(place("by") - place("ay"))) >= overlap)
    one = one.groupBy(*same).agg(F.min("owner").alias("owner"))
    seg = F.struct(place("ax").alias("x0"), place("ay").alias("y0"), place("bx").alias("x1"), place("by").alias("y1"))
    low = lambda a, b: F.least(F.col(f"s.{a}"), F.col(f"s.{b}")) - distance
    high = lambda a, b: F.greatest(F.col(f"s.{a}"), F.col(f"s.{b}")) + distance
    square = lambda v: F.floor(v / F.lit(bucket))
    one = one.select("sample_id", "label", "owner", seg.alias("s"))
    one = one.select("*", low("x0", "x1").alias("left"), low("y0", "y1").alias("bottom"), high("x0", "x1").alias("right"), high("y0", "y1").alias("top"))
    dealt = one.withColumn("u", F.explode(F.sequence(square(F.col("left")), square(F.col("right"))))).withColumn("v", F.explode(F.sequence(square(F.col("bottom")), square(F.col("top")))))
    p, q = dealt.alias("p"), dealt.alias("q")
    meet = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("sample_id", "label", "u", "v")]
    pairs = p.join(q, meet).where("p.owner < q.owner")
    pairs = pairs.where((square(F.greatest("p.left", "q.left")) == F.col("p.u")) & (square(F.greatest("p.bottom", "q.bottom")) == F.col("p.v")))
    s, t = F.col("p.s"), F.col("q.s")
    fits = S.boxes_meet(s, t) & S.parallel(s, t, angle) & S.within(s, t, distance) & (S.common_length(s, t) >= overlap)
    found = pairs.where(fits).select("p.sample_id", F.col("p.owner").alias("a"), F.col("q.owner").alias("b"))
    # A segment overlaps itself.
    long = F.greatest(F.abs(F.col("key.bx") - F.col("key.ax")), F.abs(F.col("key.by") - F.col("key.ay"))) * F.lit(grid)
    equal = _spanning(on.where(long >= overlap).select(*same, "owner"), *same)
    return found.union(equal).distinct()


def outline_sides(rows: DataFrame, grid: float = FINE) -> DataFrame:
    """The sides of what polygons of one owner cover together: those that two of them run along in opposite directions cancel.

    rows: sample_id, label, owner and ends, of polygons that do not overlap.
    """
    keyed = _keyed(rows, grid)
    forward = F.col("forward")
    ends = F.struct(*[F.when(forward, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in zip(ENDS, ["x1", "y1", "x0", "y0"], strict=True)])
    net = keyed.groupBy("sample_id", "label", "owner", "key").agg(F.sum(F.when(forward, 1).otherwise(-1)).alias("net"), F.min(ends).alias("e")).where("net <> 0")
    way = F.col("net") > 0
    return net.select("sample_id", "label", "owner", *[F.when(way, F.col(f"e.{c}")).otherwise(F.col(f"e.{d}")).alias(c) for c, d in zip(ENDS, ["x1", "y1", "x0", "y0"], strict=True)])


def merged(rows: DataFrame, grid: float = GRID, angle: float = ANGLE, distance: float = DISTANCE, overlap: float = OVERLAP, most_rounds: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame, int]:
    """Polygons of one label that touch become one, until nothing changes or ``most_rounds`` have passed.

    Gives the sides of the outlines (sample_id, label, owner, ends; staged), the owner that each polygon has come to (sample_id, owner,
    region; staged), and the number of rounds that changed something. A round takes the outlines' shared sides on the grid, then overlapping ones.
    """
    outline = staged(outline_sides(rows), "outline")
    region = staged(rows.select("sample_id", "owner").distinct().withColumn("region", F.col("owner")), "region")
    rounds = 0
    while rounds < most_rounds:
        links = staged(shared_sides(outline, grid).union(overlapping_sides(outline, grid, angle, distance, overlap)).distinct(), "links")
        if links.isEmpty():
            discard(links)
            break
        rounds += 1
        both = links.select("sample_id", "a", "b").union(links.select("sample_id", "b", "a"))
        members = both.select("sample_id", F.col("a").alias("cell_id")).distinct()
        moved = staged(graph.components(members, both).where("cell_id <> component").select("sample_id", F.col("cell_id").alias("owner"), "component"), "moved")
        joined = outline.join(moved, ["sample_id", "owner"], "left").select("sample_id", "label", F.coalesce("component", "owner").alias("owner"), *ENDS)
        outline, old = staged(outline_sides(joined), "outline"), outline
        after = region.join(moved.withColumnRenamed("owner", "region"), ["sample_id", "region"], "left")
        region, before = staged(after.select("sample_id", "owner", F.coalesce("component", "region").alias("region")), "region"), region
        discard(old, before, moved, links)
    return outline, region, rounds


def rings_of(ends: np.ndarray, grid: float = FINE) -> list[np.ndarray]:
    """Closed rings of directed sides (rows x0, y0, x1, y1), shells to the left and holes to the right; none meets itself.

    Where several sides leave a corner any is taken, and a walk that comes back to a corner is cut there. What does not close, for
    sides that others lack, is left out.
    """
    corner = np.rint(ends / grid).astype(np.int64)
    leaving: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(corner[:, :2].tolist()):
        leaving.setdefault((x, y), []).append(k)
    to = [tuple(c) for c in corner[:, 2:].tolist()]
    rings = []
    for start in list(leaving):
        while leaving.get(start):
            walk, seen, at = [], {start: 0}, start
            while leaving.get(at):
                k = leaving[at].pop()
                walk.append(k)
                at = to[k]
                if at in seen:
                    cut = seen[at]
                    loop = walk[cut:]
                    del walk[cut:]  # copying the rest would make many small loops on a long walk quadratic
                    for j in loop:
                        if to[j] != at:
                            del seen[to[j]]
                    rings.append(ends[loop, :2])
                else:
                    seen[at] = len(walk)
    return [r for r in rings if len(r) > 2]


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2


def _shells_about(points: np.ndarray, shells: list[np.ndarray]) -> np.ndarray:
    """Index of the first of ``shells`` that each point lies in, 0 if none.

    A point lies in a ring that a ray to its right crosses an odd number of times. Sides are listed by the rows of a grid that they run
    through, about two for a side, so a point asks those of its own row only.
    """
    near = [np.roll(r, -1, 0) for r in shells]
    (x, y), (u, v) = np.concatenate(shells).T, np.concatenate(near).T
    of = np.repeat(np.arange(len(shells)), [len(r) for r in shells])
    low, high = np.minimum(y, v), np.maximum(y, v)
    row = max(float((high - low).sum()), float(high.max() - low.min())) / len(y) or 1.0
    first, last = (np.floor((c - low.min()) / row).astype(np.int64) for c in (low, high))
    count = last - first + 1
    side = np.repeat(np.arange(len(y)), count)
    rows = first[side] + np.arange(len(side)) - np.repeat(np.cumsum(count) - count, count)
    order = np.argsort(rows, kind="stable")
    side, rows = side[order], rows[order]
    found = np.full(len(points), len(shells))
    asked = np.floor((points[:, 1] - low.min()) / row)
    begin, end = np.searchsorted(rows, asked), np.searchsorted(rows, asked, side="right")
    # Points in parts of about a million sides.
    parts = np.searchsorted(np.cumsum(end - begin), np.arange(1, 2 + int((end - begin).sum()) // 1_000_000) * 1_000_000)
    for i, j in zip([0, *parts.tolist()], [*parts.tolist(), len(points)], strict=True):
        n = end[i:j] - begin[i:j]
        point = np.repeat(np.arange(i, j), n)
        s = side[np.repeat(begin[i:j], n) + np.arange(len(point)) - np.repeat(np.cumsum(n) - n, n)]
        px, py = points[point].T
        cross = (y[s] > py) != (v[s] > py)
        s, point, px, py = s[cross], point[cross], px[cross], py[cross]
        right = x[s] + (py - y[s]) / (v[s] - y[s]) * (u[s] - x[s]) > px
        pair, times = np.unique(point[right] * len(shells) + of[s[right]], return_counts=True)
        pair = pair[times % 2 == 1]
        np.minimum.at(found, pair // len(shells), pair % len(shells))
    return np.where(found < len(shells), found, 0)


def assembled(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Polygons, each a shell and its holes; a hole belongs to the smallest shell about it."""
    area = [signed_area(r) for r in rings]
    shells = [rings[k] for k in sorted((k for k, a in enumerate(area) if a > 0), key=area.__getitem__)]
    holes = [r for r, a in zip(rings, area, strict=True) if a < 0]
    out = [[r] for r in shells]
    if out and holes:
        # A hole may touch its shell in single corners: the middle of a side does not.
        middle = np.stack([(h[0] + h[1]) / 2 for h in holes])
        own = _shells_about(middle, shells) if len(out) > 1 else np.zeros(len(holes), int)
        for hole, k in zip(holes, own.tolist(), strict=True):
            out[k].append(hole)
    return sorted(out, key=lambda p: -signed_area(p[0]))


def to_wkt(polygons: list[list[np.ndarray]]) -> str:
    shown = ["(" + ", ".join("(" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in [*r, r[0]]) + ")" for r in p) + ")" for p in polygons]
    return f"POLYGON {shown[0]}" if len(shown) == 1 else f"MULTIPOLYGON ({', '.join(shown)})" if shown else "POLYGON EMPTY"


def to_wkb(polygons: list[list[np.ndarray]]) -> bytes:
    def polygon(p: list[np.ndarray]) -> bytes:
        return struct.pack("<BII", 1, 3, len(p)) + b"".join(struct.pack("<I", len(r) + 1) + np.concatenate([r, r[:1]]).astype("<f8").tobytes() for r in p)

    return polygon(polygons[0]) if len(polygons) == 1 else struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(polygon, polygons))


OUTLINES = "sample_id long, label int, region_id long, n_shells int, n_holes int, n_sides long, area double, perimeter double, wkt string, wkb binary, coords string"


def outlines(rows: DataFrame) -> DataFrame:
    """One row for each owner: its sides joined into polygons with holes, as WKT, WKB and JSON of the largest shell's corners. rows: those of :func:`outline_sides`.

    A region is one row of the result, so its outline is made in one task; what lies inside of it has been cancelled before.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        polygons = assembled(rings_of(pdf[ENDS].to_numpy(float)))
        every = [r for p in polygons for r in p]
        shell = polygons[0][0] if polygons else np.zeros((0, 2))
        return pd.DataFrame(
            {
                "sample_id": [pdf["sample_id"].iloc[0]],
                "label": [pdf["label"].iloc[0]],
                "region_id": [pdf["owner"].iloc[0]],
                "n_shells": [len(polygons)],
                "n_holes": [len(every) - len(polygons)],
                "n_sides": [sum(map(len, every))],
                "area": [sum(polygon_area(p[0]) - sum(polygon_area(h) for h in p[1:]) for p in polygons)],
                "perimeter": [sum(float(np.hypot(*(np.roll(r, -1, 0) - r).T).sum()) for r in every)],
                "wkt": [to_wkt(polygons)],
                "wkb": [to_wkb(polygons)],
                "coords": ["[" + ", ".join(f"[{x!r}, {y!r}]" for x, y in [*shell.tolist(), *shell[:1].tolist()]) + "]"],
            }
        )

    return rows.groupBy("sample_id", "label", "owner").applyInPandas(run, OUTLINES)
