"""Layer curves: composition by signed hop layer around a region, with distances in microns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged
from . import graph

KEY = ["sample_id", "cell_id"]


def region_gate(flags: DataFrame, adj: DataFrame, k: int = 2, least: int = 8, share: float = 0.5) -> DataFrame:
    """n (cells within k hops, itself included), b (base cells among them) and is_region: n >= least and b / n >= share."""
    near = graph.khop(flags, adj, k)
    base = flags.select("sample_id", F.col("cell_id").alias("b"), F.col("is_base").cast("int").alias("is_base"))
    counts = near.join(base, ["sample_id", "b"]).groupBy("sample_id", F.col("a").alias("cell_id")).agg(F.count("*").alias("n"), F.sum("is_base").alias("n_base"))
    return counts.withColumn("is_region", (F.col("n") >= least) & (F.col("n_base") / F.col("n") >= share))


def border(region: DataFrame, adj: DataFrame) -> DataFrame:
    """Cells of the region that have a neighbour outside of it: region's columns and is_border."""
    outside = region.where(~F.col("is_region")).select("sample_id", F.col("cell_id").alias("b"))
    touching = adj.join(outside, ["sample_id", "b"], "left_semi").select("sample_id", F.col("a").alias("cell_id")).distinct().withColumn("touches", F.lit(True))
    return region.join(touching, KEY, "left").withColumn("is_border", F.col("is_region") & F.coalesce("touches", F.lit(False))).drop("touches")


def layers(region: DataFrame, adj: DataFrame) -> DataFrame:
    """region's columns, hops to the border and layer: negative inside, 0 on the border, null where unreachable."""
    hops = graph.hops_to(region, adj, "is_border")
    return region.join(hops, KEY).withColumn("layer", F.when(F.col("is_region"), -F.col("hops")).otherwise(F.col("hops")))


def gaps(layered: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean length of the edges between layer and layer + 1: sample_id, layer, gap."""
    of = lambda end, name: layered.where("layer is not null").select("sample_id", F.col("cell_id").alias(end), F.col("layer").alias(name))
    both = edges.join(of("src", "x"), ["sample_id", "src"]).join(of("dst", "y"), ["sample_id", "dst"]).where(F.abs(F.col("x") - F.col("y")) == 1)
    return both.groupBy("sample_id", F.least("x", "y").alias("layer")).agg(F.avg("length").alias("gap"))


def curve(layered: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, shares and signed distance of each layer; layers past a missing gap are left out.

    layered: is_base, is_target, target_value and layer of each cell.
    """
    counts = (
        layered.where("layer is not null")
        .groupBy("sample_id", "layer")
        .agg(F.count("*").alias("all_type_count"), F.sum(F.col("is_base").cast("long")).alias("base_type_count"), F.sum(F.col("is_target").cast("long")).alias("target_type_count"), F.sum("target_value").alias("target_sum"))
    )
    gap = gaps(layered, edges)
    outward = Window.partitionBy("sample_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    inward = Window.partitionBy("sample_id").orderBy(F.desc("layer")).rowsBetween(Window.unboundedPreceding, 0)
    above = gap.where("layer >= 0").select("sample_id", (F.col("layer") + 1).alias("layer"), F.sum("gap").over(outward).alias("d"), F.count("*").over(outward).alias("steps"))
    below = gap.where("layer < 0").select("sample_id", "layer", (-F.sum("gap").over(inward)).alias("d"), F.count("*").over(inward).alias("steps"))
    zero = counts.where("layer = 0").select("sample_id", "layer", F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("steps"))
    places = above.unionByName(below).unionByName(zero).where(F.col("steps") == F.abs("layer")).select("sample_id", "layer", F.col("d").alias("distance_um"))
    return counts.join(places, ["sample_id", "layer"]).select(
        "sample_id",
        "layer",
        (F.col("base_type_count") / F.col("all_type_count")).alias("base_type_prop"),
        (F.col("target_sum") / F.col("all_type_count")).alias("target_type_prop"),
        "base_type_count",
        "target_type_count",
        "all_type_count",
        "distance_um",
    )


def hplot(cells: DataFrame, flags: DataFrame, edges: DataFrame, k: int = 2, least: int = 8, share: float = 0.5) -> DataFrame:
    """The curve of every sample; ``edges`` are pruned already."""
    flags = staged(flags, "flags")
    adj = graph.adjacency(edges)
    region = region_gate(flags, adj, k, least, share)
    layered = staged(layers(border(staged(region, "region"), adj), adj).join(flags, KEY), "layers")
    return curve(layered, edges)


def gap_filled(curves: DataFrame) -> DataFrame:
    """One row for each layer between a sample's first and last; missing ones have nulls."""
    ends = curves.groupBy("sample_id").agg(F.min("layer").alias("lo"), F.max("layer").alias("hi"))
    every = ends.select("sample_id", F.explode(F.sequence("lo", "hi")).alias("layer"))
    return every.join(curves, ["sample_id", "layer"], "left")


def in_range(curves: DataFrame, low: int | None = None, high: int | None = None, covering_only: bool = False) -> DataFrame:
    """Layers from low to high; with ``covering_only``, of samples whose curves reach both ends."""
    out = curves
    if covering_only:
        ends = curves.groupBy("sample_id").agg(F.min("layer").alias("lo"), F.max("layer").alias("hi"))
        held = ends.where((F.lit(True) if low is None else F.col("lo") <= low) & (F.lit(True) if high is None else F.col("hi") >= high))
        out = out.join(held.select("sample_id"), "sample_id", "left_semi")
    if low is not None:
        out = out.where(F.col("layer") >= low)
    if high is not None:
        out = out.where(F.col("layer") <= high)
    return out


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with every sample that is in new replaced by its new rows."""
    return old.join(new.select("sample_id").distinct(), "sample_id", "left_anti").unionByName(new)


def enrichment(flags: DataFrame, adj: DataFrame, k: int = 2, epsilon: float = 1e-6) -> DataFrame:
    """T * T / (T + B + epsilon) over the cells within k hops."""
    near = graph.khop(flags, adj, k)
    own = flags.select("sample_id", F.col("cell_id").alias("b"), F.col("is_base").cast("double").alias("x"), F.col("is_target").cast("double").alias("y"))
    sums = near.join(own, ["sample_id", "b"]).groupBy("sample_id", F.col("a").alias("cell_id")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return sums.select("sample_id", "cell_id", (F.col("y") * F.col("y") / (F.col("y") + F.col("x") + F.lit(epsilon))).alias("enrichment"))
