"""Delaunay triangulation of samples too large for one task, by tiles; the same triangles as those of the whole sample.

A sample is laid out in square tiles. Each tile is triangulated with the cells of a halo around it, and keeps the triangles whose
circumcentre lies in the tile and whose circle is smaller than the halo: the task saw all cells that could lie in that circle, so these
are triangles of the whole sample, and each has one tile. What is left are wide circles, along the hull and around holes. All corners
of such a triangle lie on a side that only one kept triangle has, or in no kept triangle. The triangulation of these cells alone holds
every triangle still missing; it also covers what is done already, and the sides with one kept triangle separate the two.

Triangles on one circle have one centre and one radius, so cells on a grid are cut the same way by all tiles. Cells gather in few tiles
where a far outlier stretches the sample, and a sample without kept triangles is triangulated as a whole: slower, with the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import delaunay
from ..sources.stage import staged

#: Samples with more cells are tiled.
WHOLE_CELLS = 20_000
#: A tile's cells and its halo's width in mean distances, where cells are spread evenly.
TILE_CELLS, HALO = 5_000, 8.0
#: One row for each side of each triangle; ``w`` is the corner across.
SIDES = "sample_id long, src long, dst long, w long, length double"


def _sides(sample: int, ids: np.ndarray, xy: np.ndarray, triangles: np.ndarray) -> pd.DataFrame:
    """triangles: rows of ascending indices into ids, which ascend."""
    i, j, k = (np.concatenate([triangles[:, n] for n in order]) for order in ((0, 0, 1), (1, 2, 2), (2, 1, 0)))
    d = xy[i] - xy[j]
    return pd.DataFrame({"sample_id": np.full(len(i), sample, np.int64), "src": ids[i], "dst": ids[j], "w": ids[k], "length": np.sqrt((d * d).sum(1))})


def _circles(xy: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii; those of triangles without area are infinite or not a number."""
    a, b, c = (xy[triangles[:, k]] for k in range(3))
    b, c = b - a, c - a
    with np.errstate(all="ignore"):
        twice = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        b2, c2 = (b * b).sum(1), (c * c).sum(1)
        u = np.stack([(c[:, 1] * b2 - b[:, 1] * c2) / twice, (b[:, 0] * c2 - c[:, 0] * b2) / twice], axis=1)
        return a + u, np.sqrt((u * u).sum(1))


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cell_id", kind="stable")
    xy, ids = pdf[["x_um", "y_um"]].to_numpy(float), pdf["cell_id"].to_numpy(np.int64)
    sample, tx, ty, x0, y0, side, halo = (pdf[k].iloc[0] for k in ("sample_id", "tx", "ty", "x0", "y0", "side", "halo"))
    triangles = np.sort(delaunay(xy), axis=1)
    centre, radius = _circles(xy, triangles)
    with np.errstate(invalid="ignore"):
        own = (radius < halo * (1 - 1e-6)) & (np.floor((centre[:, 0] - x0) / side) == tx) & (np.floor((centre[:, 1] - y0) / side) == ty)
    return _sides(sample, ids, xy, triangles[own])


def _rest(cells: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
    """Sides of the triangles of ``cells`` that lie beyond ``border`` (src, dst, w: sides with one kept triangle)."""
    cells = cells.sort_values("cell_id", kind="stable")
    xy, ids = cells[["x_um", "y_um"]].to_numpy(float), cells["cell_id"].to_numpy(np.int64)
    triangles = np.sort(delaunay(xy), axis=1)
    at = {v: k for k, v in enumerate(ids.tolist())}
    walls = dict(zip(zip(border["src"].map(at).tolist(), border["dst"].map(at).tolist()), zip(border["wx"].tolist(), border["wy"].tolist())))

    def left(i: int, j: int, x: float, y: float) -> bool:
        (ax, ay), (bx, by) = xy[i], xy[j]
        return (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0

    on_side: dict[tuple[int, int], list[int]] = {}
    done: list[int] = []  # triangles of the part that is kept already
    for t, (i, j, k) in enumerate(triangles.tolist()):
        for u, v, w in ((i, j, k), (i, k, j), (j, k, i)):
            if (u, v) not in walls:
                on_side.setdefault((u, v), []).append(t)
            elif left(u, v, *xy[w]) == left(u, v, *walls[u, v]):
                done.append(t)
    drop = np.zeros(len(triangles), bool)
    while done:
        t = done.pop()
        if not drop[t]:
            drop[t] = True
            i, j, k = triangles[t].tolist()
            done += [o for s in ((i, j), (i, k), (j, k)) for o in on_side.get(s, ()) if not drop[o]]
    sample = cells["sample_id"].iloc[0] if len(cells) else 0
    return _sides(sample, ids, xy, triangles[~drop])


def sides(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """All triangles' sides of the samples in ``sizes`` (sample_id, n, x0, x1, y0, y1); those that tiles keep are staged."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    spacing = F.sqrt(F.greatest(wide * high, 1e-6 * wide * wide, 1e-6 * high * high, F.lit(1e-300)) / F.col("n"))
    # The lattice starts at an odd place, so that borders do not run through cells on a grid.
    layout = sizes.withColumn("side", spacing * float(np.sqrt(TILE_CELLS))).select("sample_id", (F.col("x0") - 0.3717 * F.col("side")).alias("x0"), (F.col("y0") - 0.3717 * F.col("side")).alias("y0"), "side", (F.col("side") * float(HALO / np.sqrt(TILE_CELLS))).alias("halo"))

    def tiles(v: str, start: str):
        def tile(sign: int):
            return F.floor((F.col(v) + sign * F.col("halo") - F.col(start)) / F.col("side"))

        return F.explode(F.sequence(tile(-1), tile(1)))

    placed = cells.join(layout, "sample_id").withColumn("tx", tiles("x_um", "x0")).withColumn("ty", tiles("y_um", "y0"))
    kept = staged(placed.groupBy("sample_id", "tx", "ty").applyInPandas(_tile, SIDES), "tile-sides")
    open_ = kept.groupBy("sample_id", "src", "dst").agg(F.count("*").alias("n"), F.min("w").alias("w")).where("n = 1").drop("n")
    place = cells.select("sample_id", F.col("cell_id").alias("w"), F.col("x_um").alias("wx"), F.col("y_um").alias("wy"))
    open_ = staged(open_.join(place, ["sample_id", "w"]), "tile-borders")
    ends = open_.select("sample_id", F.col("src").alias("cell_id")).union(open_.select("sample_id", "dst")).distinct()
    inner = kept.select("sample_id", F.col("src").alias("cell_id")).union(kept.select("sample_id", "dst")).distinct()
    own = cells.join(sizes.select("sample_id"), "sample_id", "left_semi")
    rest = own.join(ends, ["sample_id", "cell_id"], "left_semi").union(own.join(inner, ["sample_id", "cell_id"], "left_anti"))
    return kept.union(rest.groupBy("sample_id").cogroup(open_.groupBy("sample_id")).applyInPandas(_rest, SIDES))


def split(cells: DataFrame, whole: int = WHOLE_CELLS) -> tuple[DataFrame, DataFrame | None]:
    """Cells of the samples that one task triangulates, and the sides of all others (None if there are none)."""
    sizes = cells.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("x_um").alias("x0"), F.max("x_um").alias("x1"), F.min("y_um").alias("y0"), F.max("y_um").alias("y1")).where(F.col("n") > whole)
    if sizes.isEmpty():
        return cells, None
    sizes = staged(sizes, "tile-sizes")
    return cells.join(sizes.select("sample_id"), "sample_id", "left_anti"), sides(cells, sizes)
