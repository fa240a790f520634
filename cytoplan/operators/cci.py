"""Ligand-receptor interaction scores between neighbours."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import kernel_weight, sanitise
from ..sources.stage import staged

KEY = ["sample_id", "cell_id"]


def panel_pairs(pairs: DataFrame, expression: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Pairs whose genes are both in the panel, and both in ``only`` if it is given; compared in their sanitised form."""
    genes = expression.select(sanitise("gene").alias("g")).distinct()
    if only is not None:
        genes = genes.where(F.array_contains(F.array(*[sanitise(F.lit(g)) for g in only]), F.col("g")))
    out = pairs
    for end in ("ligand", "receptor"):
        out = out.join(genes.withColumnRenamed("g", f"_{end}"), sanitise(end) == F.col(f"_{end}"), "left_semi")
    return out


def weights(adj: DataFrame, kernel: str = "exponential", scale: float = 25.0) -> DataFrame:
    """sample_id, a, b, w."""
    return adj.select("sample_id", "a", "b", kernel_weight(kernel, F.col("length"), scale).alias("w"))


def neighbour_expression(weighted: DataFrame, expression: DataFrame) -> DataFrame:
    """sample_id, cell_id, gene, total (weighted sum over neighbours) and mean (over the weights of all neighbours)."""
    all_weights = weighted.groupBy("sample_id", F.col("a").alias("cell_id")).agg(F.sum("w").alias("weight"))
    there = expression.select("sample_id", F.col("cell_id").alias("b"), "gene", "value")
    sums = weighted.join(there, ["sample_id", "b"]).groupBy("sample_id", F.col("a").alias("cell_id"), "gene").agg(F.sum(F.col("w") * F.col("value")).alias("total"))
    return sums.join(all_weights, KEY).select(*KEY, "gene", "total", F.when(F.col("weight") > 0, F.col("total") / F.col("weight")).otherwise(0.0).alias("mean"))


def scores(cells: DataFrame, adj: DataFrame, expression: DataFrame, pairs: DataFrame, kernel: str = "exponential", scale: float = 25.0, dense: bool = True) -> DataFrame:
    """ligand, receptor and out_sum, out_mean (own ligand, neighbours' receptor), in_sum, in_mean (own receptor, neighbours' ligand).

    ``dense`` gives a row for every cell and pair; otherwise only rows that are not zero, with ``n_pairs``, the number of pairs.
    """
    known = panel_pairs(pairs, expression).select("ligand", "receptor", sanitise("ligand").alias("l"), sanitise("receptor").alias("r"))
    genes = known.select(F.col("l").alias("gene")).union(known.select(F.col("r").alias("gene"))).distinct()
    # Only genes of some pair enter the neighbour sums.
    own = expression.select(*KEY, sanitise("gene").alias("gene"), F.coalesce("value", F.lit(0.0)).alias("value")).join(genes, "gene", "left_semi")
    own = staged(own, "panel")
    near = staged(neighbour_expression(weights(adj, kernel, scale), own), "neighbours")
    value = lambda end: own.select(*KEY, F.col("gene").alias(end), F.col("value").alias(f"own_{end}"))
    around = lambda end: near.select(*KEY, F.col("gene").alias(end), F.col("total").alias(f"sum_{end}"), F.col("mean").alias(f"mean_{end}"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    columns = [(z("own_l") * z("mean_r")).alias("out_mean"), (z("own_l") * z("sum_r")).alias("out_sum"), (z("own_r") * z("mean_l")).alias("in_mean"), (z("own_r") * z("sum_l")).alias("in_sum")]
    if dense:
        rows = _with_pairs(cells.select(*KEY), known)
    else:
        # A score needs the cell's own ligand or receptor.
        having = [own.where("value <> 0").select(*KEY, F.col("gene").alias(end)).join(known, end).select(*KEY, "ligand", "receptor", "l", "r") for end in ("l", "r")]
        rows = having[0].union(having[1]).distinct().join(cells.select(*KEY), KEY, "left_semi")
    for end in ("l", "r"):
        rows = rows.join(value(end), [*KEY, end], "left").join(around(end), [*KEY, end], "left")
    out = rows.select(*KEY, "ligand", "receptor", *columns)
    return out if dense else out.where("out_mean <> 0 or out_sum <> 0 or in_mean <> 0 or in_sum <> 0").withColumn("n_pairs", F.lit(known.count()))


#: Pairs that one literal holds.
PAIRS = 5_000


def _with_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every row with every pair: the dense result's own grain. Pairs, a curated table, are literals of each row, ``PAIRS`` at a time."""
    names = pairs.columns
    listed = sorted(map(tuple, pairs.collect()))
    parts = []
    for i in range(0, len(listed), PAIRS):
        literal = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(names, p, strict=True)]) for p in listed[i : i + PAIRS]])
        parts.append(rows.select(*rows.columns, F.inline(literal)))
    return functools.reduce(DataFrame.unionAll, parts) if parts else rows.select(*rows.columns, *[F.lit("").alias(c) for c in names]).where("false")


def summary_of(sparse: DataFrame, cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """:func:`summary` of all cells and pairs from the rows that are not zero."""
    parts = [F.struct(F.lit(d).alias("direction"), F.lit(a).alias("aggregation"), F.col(f"{d}_{a}").alias("value")) for d in ("out", "in") for a in ("mean", "sum")]
    rows = sparse.select("sample_id", "ligand", "receptor", F.inline(F.array(*parts)))
    keys = ["sample_id", "ligand", "receptor", "direction", "aggregation"]
    sums = rows.groupBy(*keys).agg(F.sum("value").alias("s"), F.sum((F.col("value") > 0).cast("long")).alias("p"))
    kinds = F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(a).alias("aggregation")) for d in ("out", "in") for a in ("mean", "sum")])
    grid = _with_pairs(cells.groupBy("sample_id").agg(F.count("*").alias("n_cells")), pairs.select("ligand", "receptor"))
    grid = grid.select("sample_id", "n_cells", "ligand", "receptor", F.inline(kinds)).join(sums, keys, "left")
    return grid.select(*keys, "n_cells", (F.coalesce("s", F.lit(0.0)) / F.col("n_cells")).alias("mean"), (F.coalesce("p", F.lit(0)) / F.col("n_cells")).alias("frac_pos"))


def summary(scored: DataFrame) -> DataFrame:
    """n_cells, mean and frac_pos of each sample, pair, direction and aggregation."""
    parts = [F.struct(F.lit(d).alias("direction"), F.lit(a).alias("aggregation"), F.col(f"{d}_{a}").alias("value")) for d in ("out", "in") for a in ("mean", "sum")]
    rows = scored.select("sample_id", "ligand", "receptor", F.inline(F.array(*parts)))
    return rows.groupBy("sample_id", "ligand", "receptor", "direction", "aggregation").agg(F.count("*").alias("n_cells"), F.avg("value").alias("mean"), F.avg((F.col("value") > 0).cast("double")).alias("frac_pos"))
