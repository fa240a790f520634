"""Every query of the domain: name to function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import aggregates, axes, cci, cluster, communities, features, graph, harmony, hplot, outlines, profile, regions
from ..operators import components as components_of
from ..sources import tables
from ..sources.stage import staged
from ..streaming.arrivals import stream_hplot
from . import fixtures as X

REACH = 25.0


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


class World:
    """The derived tables of one run, and what several queries take from them."""

    def __init__(self, spark: SparkSession, sf_dir: str, cells: DataFrame | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self._given, self._cells, self._edges = cells, None, None

    @property
    def cells(self) -> DataFrame:
        """Staged when first asked for: queries of other tables need none."""
        if self._cells is None:
            self._cells = staged(X.cells(self.spark, self.sf_dir) if self._given is None else self._given, "cells")
        return self._cells

    @property
    def edges(self) -> DataFrame:
        """Triangulated once; several joins of a query read them."""
        if self._edges is None:
            self._edges = staged(graph.delaunay_edges(self.cells), "edges")
        return self._edges

    @property
    def pruned(self) -> DataFrame:
        return graph.prune(self.edges, REACH)

    @property
    def adj(self) -> DataFrame:
        return graph.adjacency(self.pruned)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def expression(self) -> DataFrame:
        return X.expression(self.spark, self.cells)

    def labels(self, which: int = 0) -> DataFrame:
        return X.labels(self.spark, self.cells, which)

    def flags(self, target: DataFrame | None = None) -> DataFrame:
        return axes.flagged(self.cells, axes.by_celltype(self.cells, ["Tumor"]), axes.by_celltype(self.cells, ["lymphocyte"]) if target is None else target)

    def region(self) -> DataFrame:
        return hplot.region_gate(self.flags(), self.adj)

    def layered(self) -> DataFrame:
        return hplot.layers(hplot.border(self.region(), self.adj), self.adj)

    def curve(self, flags: DataFrame | None = None) -> DataFrame:
        return _curve(hplot.hplot(self.cells, self.flags() if flags is None else flags, self.pruned))

    def members(self) -> DataFrame:
        return aggregates.membership(self.cells, self.flags(), self.adj)

    def scores(self, kernel: str = "exponential") -> DataFrame:
        return cci.scores(self.cells, self.adj, self.expression, tables.lr_pairs(X.pairs(self.spark)), kernel)

    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))

    def sides(self, shifted: bool = False) -> DataFrame:
        return outlines.sides(X.footprints(self.spark, self.cells, shifted), "sample_id", "label", "owner")

    def cell_features(self) -> DataFrame:
        types = ["lymphocyte", "stroma", "tumor"]
        return features.vectors(features.khop_composition(self.cells, self.adj, features.hard_probabilities(self.cells), types), "cell_type")


def _curve(df: DataFrame) -> DataFrame:
    return _six(df, "base_type_prop", "target_type_prop", "distance_um")


def _soft(cells: DataFrame) -> DataFrame:
    p = {"lymphocyte": F.col("cell_id") % 3 / 4.0, "stroma": F.lit(0.25), "tumor": (3 - F.col("cell_id") % 3) / 4.0}
    return cells.select("sample_id", "cell_id", F.inline(F.array(*[F.struct(F.lit(t).alias("cell_type"), v.cast("double").alias("p")) for t, v in p.items()])))


def sanitize_labels(w: World) -> DataFrame:
    raw = w.table("part").select(F.col("p_type").alias("raw")).union(w.table("orders").select("o_orderpriority")).distinct()
    return raw.select("raw", L.sanitise("raw").alias("label"))


def gene_tags(w: World) -> DataFrame:
    return w.table("part").select(F.col("p_brand").alias("raw")).distinct().select("raw", L.gene_tag("raw").alias("tag"))


def onehot_contract(w: World) -> DataFrame:
    return L.one_hot(w.cells, L.vocabulary(w.cells))


def _soft_wide(w: World) -> DataFrame:
    i = F.col("cell_id")
    return w.cells.select("sample_id", "cell_id", (i % 3).cast("double").alias("pa"), (i % 2).cast("double").alias("pb"), ((i + 1) % 3).cast("double").alias("pc"))


def hard_label(w: World) -> DataFrame:
    return _soft_wide(w).select("sample_id", "cell_id", L.hard_label({"pa": "a", "pb": "b", "pc": "c"}).alias("label"))


def normalised_probabilities(w: World) -> DataFrame:
    return _six(_soft_wide(w).select("sample_id", "cell_id", *L.normalised(["pa", "pb", "pc"])), "pa", "pb", "pc")


def manifest_rows(w: World) -> DataFrame:
    n = F.col("n_nationkey")
    line = F.concat(F.lit("data/s"), n, F.lit(".h5ad"), F.when(n % 3 == 0, F.concat(F.lit("\t"), "n_name")).when(n % 3 == 1, F.concat(F.lit(", "), "n_name")).otherwise(F.lit("")))
    lines = w.table("nation").select(line.alias("value"))
    extra = w.spark.createDataFrame([("# comment",), ("",), ("   ",)], "value string")
    return tables.parse_manifest(lines.union(extra))


def gene_panel_pairs(w: World) -> DataFrame:
    return cci.panel_pairs(tables.lr_pairs(X.pairs(w.spark)), w.expression)


def adjacency(w: World) -> DataFrame:
    return graph.neighbour_lists(w.adj).select("sample_id", "cell_id", F.size("neighbours").cast("long").alias("n_neighbours"), F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


def hplot_gene(w: World) -> DataFrame:
    return w.curve(axes.flagged(w.cells, axes.by_gene(w.expression, ["lig"]), axes.by_gene(w.expression, ["REC", "hla-a"]), 1.0))


def hplot_niche(w: World) -> DataFrame:
    return w.curve(axes.flagged(w.cells, axes.by_niche(w.labels(0), [0, 1]), axes.by_niche(w.labels(1), [2])))


def summary_upsert(w: World) -> DataFrame:
    old = w.curve().select("sample_id", "layer", F.lit("old").alias("version"))
    return hplot.upsert(old, old.where("sample_id < 10").withColumn("version", F.lit("new")))


def components(w: World) -> DataFrame:
    return graph.components(w.region().where("is_region"), w.adj)


def agg_features(w: World) -> DataFrame:
    return _six(aggregates.features(w.cells, w.members()), "area_um2", "center_x_um", "center_y_um")


def quotient_edges(w: World) -> DataFrame:
    return graph.quotient(w.pruned, w.labels().withColumnRenamed("niche_id", "aggregate_id"))


def _scores(kernel: str) -> Callable[[World], DataFrame]:
    return lambda w: _six(w.scores(kernel), "out_mean", "out_sum", "in_mean", "in_sum")


def khop_features_hard(w: World) -> DataFrame:
    return _six(features.khop_composition(w.cells, w.adj, features.hard_probabilities(w.cells), L.vocabulary(w.cells)), "value")


def khop_features_soft(w: World) -> DataFrame:
    return _six(features.khop_composition(w.cells, w.adj, _soft(w.cells), L.vocabulary(w.cells)), "value")


def niche_composition(w: World) -> DataFrame:
    return _six(profile.composition(w.labels(), features.hard_probabilities(w.cells)), "share")


def niche_top_types(w: World) -> DataFrame:
    top = profile.top(profile.composition(w.labels(), features.hard_probabilities(w.cells)), "niche_id", "cell_type", "share", 2)
    return _six(top.select("niche_id", "rank", "cell_type", "share"), "share")


def niche_markers(w: World) -> DataFrame:
    return _six(profile.markers(w.labels(), w.expression).select("niche_id", "rank", "gene", "mean_expr", "log2_enrichment"), "mean_expr", "log2_enrichment")


def center_embeddings(w: World) -> DataFrame:
    out = cluster.centred(w.embeddings(), by="label").select("vec_id", F.posexplode("features").alias("pos", "x"))
    return out.withColumn("x", F.round("x", 4) + F.lit(0.0))


def knn_graph(w: World) -> DataFrame:
    return _six(cluster.knn(w.table("embeddings")).select("a", "b", "rank", "d2"), "d2")


def pca_features(w: World) -> DataFrame:
    return cluster.principal_components(w.embeddings(), 8).select("vec_id", F.transform("features", lambda x: F.round(x, 4)).alias("features"))


def kmeans_niches(w: World) -> DataFrame:
    return cluster.labelled(w.cells, w.adj, cluster.kmeans(w.cell_features(), 4))


def kmeans_by_sample(w: World) -> DataFrame:
    return cluster.labelled(w.cells, w.adj, cluster.kmeans(w.cell_features(), 4, scope="sample"))


def leiden_sweep(w: World) -> DataFrame:
    edges = cluster.knn_graph(cluster.knn(w.table("embeddings"))).select(F.lit(0).cast("long").alias("grp"), "lo", "hi", F.lit(1.0).alias("w"))
    return communities.sweep(edges).select("resolution", "node", "niche_id", "stability", "modularity", "min_frac")


def knn_lists(w: World) -> DataFrame:
    rows = w.embeddings().select("vec_id", "features")
    return _six(communities.nearest(rows, exact_below=0, size=64)[0].select("a", "b", "rank", "d2"), "d2")


def niches_by_sample(w: World) -> DataFrame:
    return communities.estimated(w.cell_features(), scope="sample")


def harmony_embeddings(w: World) -> DataFrame:
    rows = w.embeddings().select(F.col("label").cast("long").alias("sample_id"), F.col("vec_id").cast("long").alias("cell_id"), "features")
    return harmony.corrected(rows, clusters=8, rounds=2).withColumn("features", F.transform("features", lambda x: F.round(x, 4) + F.lit(0.0)))


def dgi_embeddings(w: World) -> DataFrame:
    return cluster.encode(w.cell_features(), w.adj)


def winner_setting(w: World) -> DataFrame:
    part = w.table("part").groupBy(F.col("p_size").cast("double").alias("resolution")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("stability"), F.max("p_retailprice").alias("modularity"))
    total = w.table("part").agg(F.count("*").alias("total"))
    scores = part.join(F.broadcast(total)).withColumn("min_frac", F.col("n") / F.col("total")).withColumn("silhouette", F.lit(0.0))
    return cluster.winner(scores, 0.02).select("resolution", "n")


def niche_regions(w: World) -> DataFrame:
    out = regions.niche_regions(w.cells, w.labels(), w.edges)
    return _six(out, "area").withColumn("wkb", F.length("wkb"))


def region_outlines(w: World) -> DataFrame:
    sides, _, _ = outlines.merged(w.sides())
    return _six(outlines.outlines(sides).select("sample_id", "label", "region_id", "n_shells", "n_holes", "n_sides", "area", "perimeter"), "area", "perimeter")


def niche_outlines(w: World) -> DataFrame:
    found, _ = regions.niche_outlines(w.cells, w.labels(), w.edges)
    return _six(found.select("sample_id", "label", "region_id", "n_shells", "n_holes", "area", "perimeter"), "area", "perimeter")


def niche_expression_pca(w: World) -> DataFrame:
    scores = components_of.expression_components(w.cells, w.expression, 2)
    rows = features.khop_means(w.cells, w.adj, scores, 2)
    return rows.select("sample_id", "cell_id", F.transform("features", lambda x: F.round(x, 4) + F.lit(0.0)).alias("features"))


def stale_samples(w: World) -> DataFrame:
    moved = w.cells.withColumn("x_um", F.when(F.col("sample_id") % 5 == 0, F.col("x_um") + 1).otherwise(F.col("x_um")))
    return tables.stale_samples(w.cells, tables.fingerprint(moved))


def pending_samples(w: World) -> DataFrame:
    return tables.pending(w.cells.select("sample_id").distinct(), w.cells.where("sample_id % 2 = 0"))


def hplot_stream(w: World) -> DataFrame:
    return _curve(stream_hplot(w.spark, w.cells, ["tumor"], ["lymphocyte"]))


QUERIES: dict[str, Callable[[World], DataFrame]] = {
    "sanitize_labels": sanitize_labels,
    "gene_tags": gene_tags,
    "onehot_contract": onehot_contract,
    "hard_label": hard_label,
    "normalised_probabilities": normalised_probabilities,
    "type_counts": lambda w: profile.type_counts(w.cells),
    "verify_samples": lambda w: profile.verify(w.cells),
    "duplicate_ids": lambda w: tables.duplicate_ids(w.table("customer").select(F.col("c_nationkey").cast("long").alias("sample_id"))),
    "manifest_rows": manifest_rows,
    "gene_panel_pairs": gene_panel_pairs,
    "delaunay_edges": lambda w: _six(w.edges, "length"),
    "delaunay_triangles": lambda w: graph.delaunay_triangles(w.cells),
    "pruned_edges": lambda w: _six(w.pruned, "length"),
    "adjacency": adjacency,
    "khop_pairs": lambda w: graph.khop(w.cells, w.adj, 2),
    "exact_rings": lambda w: graph.rings(w.cells, w.adj, 3),
    "region_gate": lambda w: w.region(),
    "border_cells": lambda w: hplot.border(w.region(), w.adj).select("sample_id", "cell_id", "is_region", "is_border"),
    "hop_layers": lambda w: w.layered().select("sample_id", "cell_id", "is_region", "hops", "layer"),
    "gap_lengths": lambda w: _six(hplot.gaps(w.layered(), w.pruned), "gap"),
    "hplot_celltype": lambda w: w.curve(),
    "hplot_gene": hplot_gene,
    "hplot_niche": hplot_niche,
    "hplot_aggregate": lambda w: w.curve(w.flags(axes.by_aggregate(w.members()))),
    "hplot_cci": lambda w: w.curve(w.flags(axes.by_cci(w.scores(), "out_mean"))),
    "hplot_stream": hplot_stream,
    "gapfill_summary": lambda w: hplot.gap_filled(w.curve()),
    "layer_range": lambda w: hplot.in_range(w.curve(), -1, 2, covering_only=True),
    "summary_upsert": summary_upsert,
    "enrichment_index": lambda w: _six(hplot.enrichment(w.flags(), w.adj), "enrichment"),
    "components": components,
    "agg_membership": lambda w: w.members(),
    "agg_features": agg_features,
    "agg_composition": lambda w: _six(aggregates.composition(w.cells, w.members()), "frac"),
    "agg_super_nodes": lambda w: _six(aggregates.super_nodes(w.cells, w.members()), "x_um", "y_um"),
    "quotient_edges": quotient_edges,
    "cci_exponential": _scores("exponential"),
    "cci_gaussian": _scores("gaussian"),
    "cci_binary": _scores("binary"),
    "cci_summary": lambda w: _six(cci.summary(w.scores()), "mean", "frac_pos"),
    "khop_features_hard": khop_features_hard,
    "khop_features_soft": khop_features_soft,
    "khop_features_expr": lambda w: _six(features.khop_expression(w.cells, w.adj, w.expression, ["LIG", "REC"]), "value"),
    "niche_sizes": lambda w: _six(profile.sizes(w.labels()), "frac"),
    "niche_composition": niche_composition,
    "niche_top_types": niche_top_types,
    "niche_markers": niche_markers,
    "niche_crosstab": lambda w: profile.crosstab(w.labels(0), w.labels(1)),
    "niche_nmi": lambda w: _six(profile.nmi(w.labels(0), w.labels(1)), "nmi"),
    "center_embeddings": center_embeddings,
    "knn_graph": knn_graph,
    "pca_features": pca_features,
    "kmeans_niches": kmeans_niches,
    "kmeans_by_sample": kmeans_by_sample,
    "leiden_sweep": leiden_sweep,
    "knn_lists": knn_lists,
    "niches_by_sample": niches_by_sample,
    "harmony_embeddings": harmony_embeddings,
    "dgi_embeddings": dgi_embeddings,
    "winner_setting": winner_setting,
    "niche_regions": niche_regions,
    "shared_sides": lambda w: outlines.shared_sides(w.sides()),
    "overlapping_sides": lambda w: outlines.overlapping_sides(w.sides(shifted=True)),
    "merged_regions": lambda w: outlines.merged(w.sides(shifted=True))[1],
    "region_outlines": region_outlines,
    "niche_outlines": niche_outlines,
    "niche_expression_pca": niche_expression_pca,
    "stale_samples": stale_samples,
    "pending_samples": pending_samples,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(World(spark, sf_dir))) for name, f in QUERIES.items()}
