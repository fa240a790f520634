"""Neighbourhood features of cells: composition and mean expression by hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import sanitise
from . import graph

KEY = ["sample_id", "cell_id"]


def hard_probabilities(cells: DataFrame) -> DataFrame:
    """sample_id, cell_id, cell_type, p = 1."""
    return cells.select(*KEY, sanitise("cell_type").alias("cell_type"), F.lit(1.0).alias("p"))


def khop_composition(cells: DataFrame, adj: DataFrame, probabilities: DataFrame, types: list[str], k: int = 2, alpha: float = 1.0) -> DataFrame:
    """sample_id, cell_id, hop, cell_type, value: mean probability in each exact ring.

    Hop 0 is the cell itself, not smoothed; rings from 1 on are (p + alpha / types) / (1 + alpha), an empty ring is 1 / types.
    """
    names = [f"p{i}" for i in range(len(types))]
    wide = probabilities.groupBy("sample_id", F.col("cell_id").alias("b")).agg(*[F.sum(F.when(F.col("cell_type") == t, F.col("p"))).alias(n) for n, t in zip(names, types, strict=True)])
    # One pass over the rings: a cell's members of all hops are counted and added up together, by hop and type.
    hops = range(k + 1)
    at = lambda hop: F.col("hop") == hop
    members = graph.rings(cells, adj, k).join(wide, ["sample_id", "b"], "left")
    sums = members.groupBy("sample_id", "a").agg(*[F.count(F.when(at(h), 1)).alias(f"n{h}") for h in hops], *[F.sum(F.when(at(h), F.col(n))).alias(f"{n}_{h}") for h in hops for n in names])
    share = 1.0 / len(types)

    def value(hop: int, name: str) -> Column:
        p = F.coalesce(F.col(f"{name}_{hop}"), F.lit(0.0)) / F.col(f"n{hop}")
        return p if hop == 0 else F.when(F.col(f"n{hop}") == 0, F.lit(share)).otherwise((p + alpha * share) / (1.0 + alpha))

    every = F.array(*[F.struct(F.lit(h).alias("hop"), F.lit(t).alias("cell_type"), value(h, n).alias("value")) for h in hops for n, t in zip(names, types, strict=True)])
    return sums.select("sample_id", F.col("a").alias("cell_id"), F.inline(every))


def khop_expression(cells: DataFrame, adj: DataFrame, expression: DataFrame, genes: list[str], k: int = 2) -> DataFrame:
    """sample_id, cell_id, hop, gene, value: mean expression in each exact ring, missing values and empty rings 0."""
    ring = graph.rings(cells, adj, k)
    there = expression.select("sample_id", F.col("cell_id").alias("b"), "gene", F.coalesce("value", F.lit(0.0)).alias("value")).where(F.col("gene").isin(genes))
    sizes = ring.groupBy("sample_id", "a", "hop").agg(F.count("*").alias("n"))
    sums = ring.join(there, ["sample_id", "b"]).groupBy("sample_id", "a", "hop", "gene").agg(F.sum("value").alias("s"))
    grid = cells.select("sample_id", F.col("cell_id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(k))).alias("hop")).withColumn("gene", F.explode(F.array(*map(F.lit, genes))))
    dense = grid.join(sizes, ["sample_id", "a", "hop"], "left").join(sums, ["sample_id", "a", "hop", "gene"], "left")
    return dense.select("sample_id", F.col("a").alias("cell_id"), "hop", "gene", F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("value"))


def khop_means(cells: DataFrame, adj: DataFrame, rows: DataFrame, k: int = 2) -> DataFrame:
    """sample_id, cell_id, features: the mean vector of each exact ring, 0 to k, one after the other; empty rings are 0. rows: features."""
    first = rows.select(F.size("features").alias("n")).first()
    wide = first["n"] if first else 0
    there = rows.select("sample_id", F.col("cell_id").alias("b"), *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(wide)])
    means = graph.rings(cells, adj, k).join(there, ["sample_id", "b"]).groupBy("sample_id", "a", "hop").agg(F.count("*").alias("n"), *[F.avg(f"f{i}").alias(f"f{i}") for i in range(wide)])
    packed = means.select("sample_id", "a", "hop", F.array(*[f"f{i}" for i in range(wide)]).alias("v")).groupBy("sample_id", "a").agg(F.map_from_entries(F.collect_list(F.struct("hop", "v"))).alias("by_hop"))
    none = F.array_repeat(F.lit(0.0), wide)
    blocks = [F.coalesce(F.element_at("by_hop", F.lit(hop)), none) for hop in range(k + 1)]
    return packed.select("sample_id", F.col("a").alias("cell_id"), F.concat(*blocks).alias("features"))


def vectors(long: DataFrame, name: str) -> DataFrame:
    """sample_id, cell_id, features: values in order of hop and ``name``."""
    packed = F.array_sort(F.collect_list(F.struct("hop", name, "value")))
    return long.groupBy(*KEY).agg(packed.alias("v")).select(*KEY, F.transform("v", lambda x: x["value"]).alias("features"))


def concatenated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both feature vectors of each cell, one after the other."""
    return a.join(b.select(*KEY, F.col("features").alias("_more")), KEY).select(*KEY, F.concat("features", "_more").alias("features"))
