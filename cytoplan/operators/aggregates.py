"""Cell aggregates: dense connected groups of a type, their shapes and the graph between them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import convex_hull, polygon_area
from ..functions.labels import sanitise
from ..sources.stage import staged
from ..sources.tables import ContractError
from . import graph, hplot

KEY = ["sample_id", "cell_id"]


def check_name(name: str, types: list[str]) -> str:
    """A name for new columns: [a-z0-9_]+, neither a type nor in a reserved family."""
    if not re.fullmatch(r"[a-z0-9_]+", name):
        raise ContractError("an aggregate's name has only a-z, 0-9 and _")
    if name in types or name.startswith(("object_", "region_", "niche_")):
        raise ContractError(f"{name} is taken")
    return name


def membership(cells: DataFrame, flags: DataFrame, adj: DataFrame, k: int = 2, least: int = 8, share: float = 0.5, min_size: int = 10) -> DataFrame:
    """sample_id, cell_id, aggregate_id of every cell (null outside), numbered from 0 by centroid (y, then x) within the sample."""
    dense = hplot.region_gate(staged(flags, "flags"), adj, max(1, k), least, share).where("is_region")
    parts = staged(graph.components(dense, adj), "components")
    placed = parts.join(cells.select(*KEY, "x_um", "y_um"), KEY)
    sizes = placed.groupBy("sample_id", "component").agg(F.count("*").alias("n"), F.avg("x_um").alias("cx"), F.avg("y_um").alias("cy")).where(F.col("n") >= min_size)
    order = Window.partitionBy("sample_id").orderBy("cy", "cx", "component")
    numbered = sizes.withColumn("aggregate_id", F.row_number().over(order) - 1).select("sample_id", "component", "aggregate_id")
    found = parts.join(numbered, ["sample_id", "component"]).select(*KEY, "aggregate_id")
    return cells.select(*KEY).join(found, KEY, "left")


def hull_area(points: pd.DataFrame) -> float:
    return polygon_area(convex_hull(points[["x_um", "y_um"]].to_numpy(float)))


def features(cells: DataFrame, members: DataFrame) -> DataFrame:
    """n_cells, hull area, centroid and the share of every type of the sample, for each aggregate."""

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sample_id": pdf["sample_id"].iloc[:1], "aggregate_id": pdf["aggregate_id"].iloc[:1], "area_um2": [hull_area(pdf)]})

    inside = members.where("aggregate_id is not null").join(cells, KEY)
    areas = inside.select("sample_id", "aggregate_id", "x_um", "y_um").groupBy("sample_id", "aggregate_id").applyInPandas(area, "sample_id long, aggregate_id int, area_um2 double")
    shapes = inside.groupBy("sample_id", "aggregate_id").agg(F.count("*").alias("n_cells"), F.bround(F.avg("x_um"), 0).alias("center_x_um"), F.bround(F.avg("y_um"), 0).alias("center_y_um"))
    return shapes.join(areas, ["sample_id", "aggregate_id"])


def composition(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Share of each type that the sample has, also 0, in each aggregate: sample_id, aggregate_id, cell_type, frac."""
    typed = cells.select(*KEY, sanitise("cell_type").alias("cell_type"))
    inside = members.where("aggregate_id is not null").join(typed, KEY)
    n = inside.groupBy("sample_id", "aggregate_id").agg(F.count("*").alias("n"))
    own = inside.groupBy("sample_id", "aggregate_id", "cell_type").agg(F.count("*").alias("k"))
    grid = n.join(typed.select("sample_id", "cell_type").distinct(), "sample_id")
    return grid.join(own, ["sample_id", "aggregate_id", "cell_type"], "left").select("sample_id", "aggregate_id", "cell_type", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("frac"))


def super_nodes(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Centroid and size of each aggregate."""
    inside = members.where("aggregate_id is not null").join(cells, KEY)
    return inside.groupBy("sample_id", "aggregate_id").agg(F.count("*").alias("n_cells"), F.avg("x_um").alias("x_um"), F.avg("y_um").alias("y_um"))


