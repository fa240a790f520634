"""Niche profiles: composition, markers, top lists, cross-tables and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["sample_id", "cell_id"]


def sizes(labels: DataFrame) -> DataFrame:
    """niche_id, n_cells, frac of all assigned cells."""
    n = labels.where("niche_id is not null").groupBy("niche_id").agg(F.count("*").alias("n_cells"))
    total = n.agg(F.sum("n_cells").alias("total"))
    return n.join(F.broadcast(total)).select("niche_id", "n_cells", (F.col("n_cells") / F.col("total")).alias("frac"))


def composition(labels: DataFrame, probabilities: DataFrame) -> DataFrame:
    """Mean probability of each type in each niche. probabilities: sample_id, cell_id, cell_type, p."""
    own = labels.where("niche_id is not null")
    n = own.groupBy("niche_id").agg(F.count("*").alias("n"))
    sums = own.join(probabilities, KEY).groupBy("niche_id", "cell_type").agg(F.sum("p").alias("s"))
    grid = n.join(F.broadcast(probabilities.select("cell_type").distinct()))
    return grid.join(sums, ["niche_id", "cell_type"], "left").select("niche_id", "cell_type", (F.coalesce("s", F.lit(0.0)) / F.greatest("n", F.lit(1))).alias("share"))


def top(table: DataFrame, group: str, name: str, value: str, n: int) -> DataFrame:
    """The n largest of each group with rank from 1, ties by name."""
    w = Window.partitionBy(group).orderBy(F.desc(value), name)
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def markers(labels: DataFrame, expression: DataFrame, n: int | None = None, epsilon: float = 1e-6) -> DataFrame:
    """niche_id, gene, mean_expr, log2_enrichment over the mean of all assigned cells, rank; missing values count as 0."""
    own = labels.where("niche_id is not null")
    counts = own.groupBy("niche_id").agg(F.count("*").alias("n"))
    sums = own.join(expression, KEY).groupBy("niche_id", "gene").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("s"))
    grid = counts.join(F.broadcast(expression.select("gene").distinct()))
    dense = grid.join(sums, ["niche_id", "gene"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    w = Window.partitionBy("gene")
    table = dense.select("niche_id", "gene", (F.col("s") / F.col("n")).alias("mean_expr"), (F.sum("s").over(w) / F.sum("n").over(w)).alias("overall"))
    table = table.select("niche_id", "gene", "mean_expr", F.log2((F.col("mean_expr") + epsilon) / (F.col("overall") + epsilon)).alias("log2_enrichment"))
    return top(table, "niche_id", "gene", "log2_enrichment", n or (1 << 30))


def enriched(sums: DataFrame, counts: DataFrame, groups: list[str], name: str, epsilon: float = 1e-6) -> DataFrame:
    """Mean and log2 enrichment of what occurs in a group at all: ``groups``, ``name``, s, n, mean_value, log2_enrichment.

    sums: ``groups``, ``name``, s (sum of values); counts: ``groups``, n (members). Both may come from partial sums of earlier runs. The
    same numbers as :func:`markers` without its rows of zeros, so names may be as many as words.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    overall = sums.groupBy(name).agg(F.sum("s").alias("all"))
    same = [F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}")) for g in groups]
    rows = sums.alias("x").join(counts.alias("y"), same).select("x.*", "y.n").join(overall, name)
    mean = F.col("s") / F.col("n")
    return rows.select(*groups, name, "s", "n", mean.alias("mean_value"), F.log2((mean + epsilon) / (F.col("all") / F.lit(total) + epsilon)).alias("log2_enrichment"))


def crosstab(a: DataFrame, b: DataFrame) -> DataFrame:
    """niche_a, niche_b, n_cells over cells that both label."""
    x = a.where("niche_id is not null").select(*KEY, F.col("niche_id").alias("niche_a"))
    y = b.where("niche_id is not null").select(*KEY, F.col("niche_id").alias("niche_b"))
    return x.join(y, KEY).groupBy("niche_a", "niche_b").agg(F.count("*").alias("n_cells"))


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """Normalised mutual information (natural logs, over the mean of the entropies); 0 if both are constant, null without cells."""
    cell = crosstab(a, b)
    total = F.sum("n_cells").over(Window.partitionBy())
    ab = cell.select("niche_a", "niche_b", (F.col("n_cells") / total).alias("p"))
    pa = ab.groupBy("niche_a").agg(F.sum("p").alias("pa"))
    pb = ab.groupBy("niche_b").agg(F.sum("p").alias("pb"))
    mutual = ab.join(pa, "niche_a").join(pb, "niche_b").agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"))
    ha = pa.agg((-F.sum(F.col("pa") * F.ln("pa"))).alias("ha"))
    hb = pb.agg((-F.sum(F.col("pb") * F.ln("pb"))).alias("hb"))
    one = mutual.join(ha).join(hb)
    return one.select(F.when(F.col("ha") + F.col("hb") <= 0, 0.0).otherwise(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))


def type_counts(cells: DataFrame) -> DataFrame:
    """Cells of each type in each sample."""
    return cells.groupBy("sample_id", "cell_type").agg(F.count("*").alias("n_cells"))


def most_common_types(cells: DataFrame) -> DataFrame:
    """Cells of each type over all samples, the commonest first, ties by name."""
    return cells.groupBy("cell_type").agg(F.count("*").alias("n_cells"), F.countDistinct("sample_id").alias("n_samples")).orderBy(F.desc("n_cells"), F.col("cell_type"))


def verify(cells: DataFrame) -> DataFrame:
    """One row for each sample: cells, types, cells without a type or place, and whether the sample is usable."""
    return cells.groupBy("sample_id").agg(
        F.count("*").alias("n_cells"),
        F.countDistinct("cell_type").alias("n_types"),
        F.sum(F.col("cell_type").isNull().cast("long")).alias("n_untyped"),
        F.sum((F.col("x_um").isNull() | F.col("y_um").isNull()).cast("long")).alias("n_unplaced"),
    ).withColumn("ok", (F.col("n_untyped") == 0) & (F.col("n_unplaced") == 0))
