"""Base predicates and target values of the layer curves, from five families of axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import sanitise

KEY = ["sample_id", "cell_id"]


def by_celltype(cells: DataFrame, types: list[str]) -> DataFrame:
    """value 1 for cells of the types, else 0; names are compared in their sanitised form."""
    known = F.array(*[sanitise(F.lit(t)) for t in types])
    return cells.select(*KEY, F.when(F.array_contains(known, sanitise("cell_type")), 1.0).otherwise(0.0).alias("value"))


def by_gene(expression: DataFrame, genes: list[str]) -> DataFrame:
    """Mean value of the genes that the cell has a value of."""
    known = F.array(*[sanitise(F.lit(g)) for g in genes])
    return expression.where(F.array_contains(known, sanitise("gene"))).groupBy(*KEY).agg(F.avg("value").alias("value"))


def by_niche(labels: DataFrame, niches: list[int]) -> DataFrame:
    """value 1 for cells of the niches; labels: niche_id, null for isolated cells."""
    return labels.select(*KEY, F.coalesce(F.col("niche_id").isin(niches).cast("double"), F.lit(0.0)).alias("value"))


def by_aggregate(membership: DataFrame) -> DataFrame:
    """value 1 for members of any aggregate."""
    return membership.select(*KEY, F.col("aggregate_id").isNotNull().cast("double").alias("value"))


def by_cci(scores: DataFrame, column: str) -> DataFrame:
    """Mean over the pairs of one score column; rows that are not zero suffice if they carry ``n_pairs``."""
    mean = F.sum(column) / F.max("n_pairs") if "n_pairs" in scores.columns else F.avg(column)
    return scores.groupBy(*KEY).agg(mean.alias("value"))


def flagged(cells: DataFrame, base: DataFrame, target: DataFrame, threshold: float = 0.0) -> DataFrame:
    """cells with is_base (base value over the threshold), target_value and is_target (value over 0)."""
    out = cells.select(*KEY).join(base.withColumnRenamed("value", "base_value"), KEY, "left").join(target.withColumnRenamed("value", "target_value"), KEY, "left")
    value = F.coalesce("target_value", F.lit(0.0))
    return out.select(*KEY, F.coalesce(F.col("base_value") > threshold, F.lit(False)).alias("is_base"), value.alias("target_value"), (value > 0).alias("is_target"))
