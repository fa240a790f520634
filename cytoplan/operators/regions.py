"""Niche regions: Voronoi cells capped to a radius, merged where cells of one niche share a boundary, and their dissolved outlines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import capped_cells, multipolygon_wkb, polygon_area
from ..sources.stage import staged
from . import graph, outlines

KEY = ["sample_id", "cell_id"]
#: Microns of common boundary that two cells must have more of to merge.
BORDER = 0.5
VORONOI = "sample_id long, cell_id long, area double, x array<double>, y array<double>, borders array<struct<b: long, length: double>>"


def voronoi_cells(cells: DataFrame, edges: DataFrame, radius: float = 15.0) -> DataFrame:
    """sample_id, cell_id, area, x, y (corners) and borders (neighbour and common boundary's length) of each cell's capped Voronoi polygon.

    edges are the unpruned Delaunay edges. Only neighbours nearer than twice the radius can share a boundary within both disks. A cell goes
    with the places of its neighbours, so any task takes any cells and none holds a sample.
    """
    near = edges.where(F.col("length") < 2 * radius) if "length" in edges.columns else edges
    both = near.select("sample_id", F.col("src").alias("cell_id"), F.col("dst").alias("b")).union(near.select("sample_id", "dst", "src"))
    places = cells.select("sample_id", F.col("cell_id").alias("b"), F.col("x_um").alias("u"), F.col("y_um").alias("v"))
    around = both.join(places, ["sample_id", "b"]).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("b", "u", "v"))).alias("near"))
    rows = cells.where("x_um is not null and y_um is not null").select(*KEY, "x_um", "y_um").join(around, KEY, "left")
    rows = rows.withColumn("near", F.coalesce("near", F.array().cast("array<struct<b: long, u: double, v: double>>")))

    def lists(arrays: list[np.ndarray] | list[pa.Array], values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xy = batch.column(1).to_numpy(), np.stack([batch.column(k).to_numpy() for k in (2, 3)], 1)
            count = np.asarray(batch.column(4).value_lengths())
            b, u, v = (batch.column(4).flatten().field(k).to_numpy() for k in range(3))
            first = np.append(0, np.cumsum(count)).astype(np.int64)
            shapes, length = capped_cells(ids, xy, first, b, np.stack([u, v], 1), radius)
            flat = np.concatenate([np.zeros((0, 2)), *shapes])
            borders = pa.StructArray.from_arrays([pa.array(b), pa.array(length)], ["b", "length"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([polygon_area(s) for s in shapes], pa.float64()), lists(shapes, pa.array(flat[:, 0])), lists(shapes, pa.array(flat[:, 1])), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), borders)],
                [*KEY, "area", "x", "y", "borders"],
            )

    return rows.mapInArrow(run, VORONOI)


def niche_regions(cells: DataFrame, labels: DataFrame, edges: DataFrame, radius: float = 15.0, border: float = BORDER) -> DataFrame:
    """sample_id, niche_id, region_id (smallest cell_id), n_cells, area, wkt and wkb (the members' polygons) of each merged region.

    Cells of one niche merge if their capped Voronoi cells have more than ``border`` microns of boundary in common. Such cells have
    disjoint interiors, so a region's area is the sum of its members'.
    """
    known = labels.where("niche_id is not null").select(*KEY, "niche_id")
    shapes = staged(voronoi_cells(cells, edges, radius), "voronoi")
    touching = shapes.select("sample_id", F.col("cell_id").alias("a"), F.inline("borders")).where((F.col("a") < F.col("b")) & (F.col("length") > border))
    of = lambda end, name: known.select("sample_id", F.col("cell_id").alias(end), F.col("niche_id").alias(name))
    same = touching.join(of("a", "p"), ["sample_id", "a"]).join(of("b", "q"), ["sample_id", "b"]).where("p = q").select("sample_id", "a", "b")
    both = same.unionAll(same.select("sample_id", F.col("b").alias("a"), F.col("a").alias("b")))
    parts = graph.components(known, both)
    rows = parts.join(known, KEY).join(shapes.drop("borders"), KEY)
    out = rows.groupBy("sample_id", "niche_id", F.col("component").alias("region_id")).agg(F.count("*").alias("n_cells"), F.sum("area").alias("area"), F.array_sort(F.collect_list(F.struct("cell_id", "x", "y"))).alias("m"))

    def written(batches):
        for pdf in batches:
            polygons = [[np.stack([p["x"], p["y"]], 1) for p in m if len(p["x"]) > 2] for m in pdf.pop("m")]
            ring = lambda p: "((" + ", ".join(f"{x:.3f} {y:.3f}" for x, y in [*p, p[0]]) + "))"
            pdf["wkt"] = ["MULTIPOLYGON (" + ", ".join(map(ring, ps)) + ")" if ps else "MULTIPOLYGON EMPTY" for ps in polygons]
            pdf["wkb"] = [multipolygon_wkb(ps) for ps in polygons]
            yield pdf

    return out.mapInPandas(written, "sample_id long, niche_id int, region_id long, n_cells long, area double, wkt string, wkb binary")


def one_hot(rows: DataFrame, niches: int) -> DataFrame:
    """Regions with a column niche_0, niche_1, ... for each niche, 1.0 for their own."""
    return rows.withColumns({f"niche_{k}": (F.col("niche_id") == k).cast("double") for k in range(niches)})


def niche_outlines(cells: DataFrame, labels: DataFrame, edges: DataFrame, radius: float = 15.0, grid: float = outlines.GRID, most_rounds: int = outlines.MOST_ROUNDS, min_area: float = 0.0) -> tuple[DataFrame, int]:
    """The dissolved outline of each merged region (see :data:`outlines.OUTLINES`; label is the niche, region_id the smallest cell_id), and the rounds of merging.

    Capped Voronoi cells of one niche become one region if they share a side on the grid or have sides that run along each other, until a fixed point.
    Cells, and then regions, of less than ``min_area`` are left out.
    """
    known = labels.where("niche_id is not null").select(*KEY, F.col("niche_id").cast("int").alias("label"))
    shapes = staged(voronoi_cells(cells, edges, radius).where(F.col("area") >= min_area), "voronoi").withColumnRenamed("cell_id", "owner")
    rows = shapes.join(known.withColumnRenamed("cell_id", "owner"), ["sample_id", "owner"])
    sides, _, rounds = outlines.merged(outlines.sides(rows, "sample_id", "label", "owner"), grid, most_rounds=most_rounds)
    return outlines.outlines(sides).where(F.col("area") >= min_area), rounds
