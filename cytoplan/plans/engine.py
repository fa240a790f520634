"""End-to-end commands over tables in a results folder."""

from __future__ import annotations

import functools
import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import aggregates, axes, cci, cluster, communities, features, graph, harmony, hplot, profile, regions
from ..operators import components as components_of
from ..sources import tables
from ..sources.samples import resolved
from ..sources.stage import staged, stages


@dataclass
class HplotConfig:
    base: list[str] = field(default_factory=list)
    target: list[str] = field(default_factory=list)
    base_by: str = "celltype"
    target_by: str = "celltype"
    base_threshold: float = 0.0
    reach_um: float = 25.0
    k: int = 2
    n: int = 8
    r: float = 0.5
    low: int | None = None
    high: int | None = None
    covering_only: bool = False

    def key(self) -> str:
        """The partition of the curve's rows; the range is applied when they are read."""
        return config_key(**{k: v for k, v in asdict(self).items() if k not in ("low", "high", "covering_only")})


AXES = ("celltype", "gene", "aggregate", "cci", "niche", "gexniche", "hniche")
STABLE, EXPERIMENTAL = ("ingest", "run", "niche", "niche-profile", "verify", "export", "describe"), ("hplot", "hplot-finalize", "agg", "cci")


#: Columns whose change makes a sample's results stale.
CONTENT = {"cells": ("cell_id", "x_um", "y_um", "cell_type"), "expression": ("cell_id", "gene", "value")}
#: Results by the partition columns above sample_id.
RESULTS = {"hplot": "config", "cci": "config", "niches": "family", "niche_regions": "family", "niche_outlines": "family", "aggregates": "name", "embeddings": "config"}


def config_key(**settings: Any) -> str:
    """A partition name for results that were made with ``settings``."""
    return "c" + hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Engine:
    """Commands on the tables under ``root``: cells, expression, graph_edges, hplot, aggregates, cci, niches and profiles.

    Results lie in partitions by what they were made with (a configuration, a family of niches, a name of aggregates) and by sample.
    A run replaces all that it has of the samples asked for; ingesting a sample anew whose rows differ deletes its results.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(self.path(name))
        return rows.withColumn("sample_id", F.col("sample_id").cast("long"))  # a partition's name is read as an int

    def _files(self, path: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        p, fs = self._files(self.path(name))
        return fs.exists(p) and any(not f.getPath().getName().startswith("_") for f in fs.listStatus(p))

    def _done(self, name: str, /, **within: str) -> DataFrame | None:
        if not self.has(name):
            return None
        rows = self.read(name)
        for key, value in within.items():
            rows = rows.where(F.col(key) == value)
        return rows

    def _todo(self, name: str, overwrite: bool, **within: str) -> DataFrame:
        """Cells of samples that ``name`` has no rows of."""
        cells = self.read("cells")
        wanted = tables.pending(cells.select("sample_id").distinct(), self._done(name, **within), overwrite)
        return cells.join(wanted, "sample_id", "left_semi")

    def _write(self, df: DataFrame, table: str, samples: DataFrame, /, **within: str) -> None:
        tables.replace_samples(df, self.path(table), samples, **within)

    def _forget(self, samples: DataFrame) -> None:
        """Delete the results of ``samples``."""
        folders = []
        for name in RESULTS:
            p, fs = self._files(self.path(name))
            if fs.exists(p):
                folders += [f.getPath().toString() for f in fs.listStatus(p) if f.isDirectory()]
        if folders:
            for r in samples.select("sample_id").distinct().toLocalIterator():
                for folder in folders:
                    tables.delete_path(self.spark, f"{folder}/sample_id={r['sample_id']}")

    def ingest(self, cells: DataFrame, expression: DataFrame | None = None) -> None:
        with stages():
            self._ingest(cells, expression)

    def _ingest(self, cells: DataFrame, expression: DataFrame | None) -> None:
        for name, new, schema in (("cells", cells, tables.CELLS), ("expression", expression, tables.EXPRESSION)):
            if new is None:
                continue
            new = new.select(*schema.names)
            if self.has(name):
                known = self.read(name).select("sample_id").distinct()
                stored = tables.fingerprint(self.read(name), CONTENT[name]).withColumnRenamed("n_cells", "n")
                changed = tables.fingerprint(new, CONTENT[name]).withColumnRenamed("n_cells", "n").join(stored, ["sample_id", "n", "checksum"], "left_anti")
                self._forget(staged(changed.select("sample_id").join(known, "sample_id", "left_semi"), "changed"))
            self._write(new, name, new)

    def edges(self) -> DataFrame:
        """Unpruned Delaunay edges, kept with a fingerprint of each sample's cells; only new or changed samples are triangulated."""
        cells = self.read("cells")
        stored = self._done("graph_fingerprint")
        stale = tables.stale_samples(cells, stored) if stored is not None else cells.select("sample_id").distinct()
        with stages():
            stale = staged(stale, "stale")
            if not stale.isEmpty():
                fresh = cells.join(stale, "sample_id", "left_semi")
                self._write(graph.delaunay_edges(fresh), "graph_edges", stale)
                self._write(tables.fingerprint(fresh), "graph_fingerprint", stale)
        if not self.has("graph_edges"):
            return self.spark.createDataFrame([], graph.EDGES)
        return self.read("graph_edges").select("sample_id", "src", "dst", "length")

    def _some(self, axis: DataFrame, what: str, names: list[str]) -> DataFrame:
        """``axis``, unless no cell has any of ``names``: a curve of nothing would be silent."""
        if axis.where("value > 0").isEmpty():
            raise tables.MissingKeyError(f"none of these {what} occurs in the cells: {', '.join(map(str, names)) or '(none given)'}")
        return axis

    def _axis(self, by: str, names: list[str]) -> DataFrame:
        cells = self.read("cells")
        if by == "celltype":
            return self._some(axes.by_celltype(cells, names), "cell types", names)
        if by == "gene":
            return axes.by_gene(tables.select_genes(self.read("expression"), names), names)
        if by == "aggregate":
            known = [r[0] for r in self.read("aggregates").select("name").distinct().collect()]
            return axes.by_aggregate(self.read("aggregates").where(F.col("name").isin(resolved(self.spark, known, names))))
        if by == "cci":
            scores = self._cci()
            return axes.by_cci(scores, resolved(self.spark, [c for c in scores.columns if c.startswith(("out_", "in_"))], names[:1], "cci_")[0])
        if by in AXES:
            return self._some(axes.by_niche(self.read("niches").where(F.col("family") == by), [int(n.rsplit("_", 1)[-1]) for n in names]), "niches", names)
        raise tables.ContractError(f"an axis is one of {AXES}")

    def hplot(self, cfg: HplotConfig, overwrite: bool = False) -> DataFrame:
        cells = self._todo("hplot", overwrite, config=cfg.key())
        edges = graph.prune(self.edges(), cfg.reach_um).join(cells.select("sample_id").distinct(), "sample_id", "left_semi")
        flags = axes.flagged(cells, self._axis(cfg.base_by, cfg.base), self._axis(cfg.target_by, cfg.target), cfg.base_threshold)
        with stages():
            self._write(hplot.hplot(cells, flags, edges, cfg.k, cfg.n, cfg.r), "hplot", cells, config=cfg.key())
        return self.finalize(cfg)

    def finalize(self, cfg: HplotConfig | None = None) -> DataFrame:
        """The summary of all samples: layers without gaps, within the range. Without ``cfg``, of all configurations."""
        rows = self._done("hplot", **({"config": cfg.key()} if cfg else {}))
        if rows is None:
            raise tables.MissingKeyError("there is no result to summarise; run hplot first")
        cfg = cfg or HplotConfig()
        parts = [rows.where(F.col("config") == r[0]).drop("config") for r in rows.select("config").distinct().orderBy("config").collect()]
        if not parts:
            parts = [rows.drop("config")]
        out = [hplot.gap_filled(hplot.in_range(p, cfg.low, cfg.high, cfg.covering_only)).withColumn("distance", F.col("distance_um")) for p in parts]
        return functools.reduce(DataFrame.unionByName, out)

    def run(self, cells: DataFrame, cfg: HplotConfig, expression: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
        self.ingest(cells, expression)
        return self.hplot(cfg, overwrite)

    def aggregates(self, name: str, types: list[str], reach_um: float = 25.0, k: int = 2, n: int = 8, r: float = 0.5, min_size: int = 10) -> DataFrame:
        cells = self.read("cells")
        aggregates.check_name(name, L.vocabulary(cells))
        adj = graph.adjacency(graph.prune(self.edges(), reach_um))
        base = axes.by_celltype(cells, types)
        with stages():
            self._write(aggregates.membership(cells, axes.flagged(cells, base, base), adj, k, n, r, min_size), "aggregates", cells, name=name)
        return aggregates.features(cells, self.read("aggregates").where(F.col("name") == name))

    def _cci(self, key: str | None = None) -> DataFrame:
        """Scores of one configuration, by default the one that was run last."""
        if key is None:
            if not self.has("cci") or not self.has("cci_runs"):
                raise tables.MissingKeyError("there are no interaction scores; run cci first")
            key = self.spark.read.parquet(self.path("cci_runs")).agg(F.max_by("config", "run")).first()[0]
        return self._done("cci", config=key).drop("config")

    def _ran_cci(self, key: str) -> None:
        """Note that ``key`` is the configuration that was run last."""
        known = self.spark.read.parquet(self.path("cci_runs")).agg(F.max("run")).first()[0] if self.has("cci_runs") else None
        self.spark.createDataFrame([(key, 1 + (known or 0))], "config string, run long").coalesce(1).write.mode("append").parquet(self.path("cci_runs"))

    def cci(self, pairs: DataFrame, kernel: str = "exponential", scale: float = 25.0, d_max: float = 25.0, overwrite: bool = False, genes: list[str] | None = None) -> DataFrame:
        """Scores that are not zero are kept; the summary counts all cells."""
        listed = sorted(map(tuple, pairs.select("ligand", "receptor").collect()))
        key = config_key(pairs=listed, kernel=kernel, scale=scale, d_max=d_max, genes=genes)
        cells = self._todo("cci", overwrite, config=key)
        edges = graph.prune(self.edges(), d_max).join(cells.select("sample_id").distinct(), "sample_id", "left_semi")
        known = cci.panel_pairs(pairs, self.read("expression"), genes)
        with stages():
            self._write(cci.scores(cells, graph.adjacency(edges), self.read("expression"), known, kernel, scale, dense=False), "cci", cells, config=key)
        self._ran_cci(key)
        return cci.summary_of(self._cci(key), self.read("cells"), known)

    def niche(
        self,
        family: str = "niche",
        clusters: int | None = None,
        k_hops: int = 2,
        reach_um: float = 25.0,
        mode: str = "celltype",
        genes: list[str] | None = None,
        components: int = 50,
        batch_correct: str = "none",
        epochs: int = 300,
        with_regions: bool = False,
        probabilities: DataFrame | None = None,
        scope: str = "cohort",
        patience: int = 20,
        min_delta: float = 1e-4,
        min_epochs: int = 50,
        region_radius: float = 15.0,
        exact_below: int = communities.EXACT_BELOW,
    ) -> DataFrame:
        """Neighbourhood features, encoder, correction, clustering and labels; null for isolated cells.

        Without ``clusters`` their number is estimated, over the cohort or with ``scope`` sample in each sample by itself. Embeddings
        are kept by their inputs and settings. ``with_regions`` writes the members' polygons and the dissolved outlines.

        ``probabilities`` (sample_id, cell_id, cell_type, p) make the composition soft. Expression enters by ``components`` principal
        components of each cell, averaged over hops; 0 takes the genes themselves.
        """
        cells, edges = self.read("cells"), self.edges()
        with stages():
            adj = staged(graph.adjacency(graph.prune(edges, reach_um)), "adjacency")
            settings = dict(k_hops=k_hops, reach_um=reach_um, mode=mode, genes=genes, components=components, epochs=epochs, patience=patience, min_delta=min_delta, min_epochs=min_epochs)
            rows = self._embeddings(cells, adj, probabilities, settings)
            if batch_correct == "center":
                rows = staged(cluster.centred(rows), "centred")
            elif batch_correct == "harmony":
                rows = staged(harmony.corrected(rows), "harmony")
            elif batch_correct != "none":
                raise tables.ContractError("batch_correct is none, center or harmony")
            if clusters:
                found = cluster.kmeans(rows, clusters, scope=scope)
            else:
                found = communities.estimated(rows, scope, exact_below=exact_below)
            labels = staged(cluster.labelled(cells, adj, found), "labels")
            self._write(labels, "niches", cells, family=family)
            if with_regions:
                self._write(regions.niche_regions(cells, labels, edges, region_radius), "niche_regions", cells, family=family)
                self._write(regions.niche_outlines(cells, labels, edges, region_radius)[0], "niche_outlines", cells, family=family)
        return self.read("niches").where(F.col("family") == family)

    def _embeddings(self, cells: DataFrame, adj: DataFrame, probabilities: DataFrame | None, settings: dict[str, Any]) -> DataFrame:
        """Embeddings of cells with a neighbour, kept by the content of their inputs and their settings: what a later run with other clusters reads."""
        mode, k_hops, genes, components = (settings[k] for k in ("mode", "k_hops", "genes", "components"))
        if mode not in ("celltype", "expression", "both"):
            raise tables.ContractError("mode is celltype, expression or both")
        inputs = [cells.select(*CONTENT["cells"], "sample_id")] + ([] if mode == "celltype" else [self.read("expression")]) + ([] if probabilities is None else [probabilities])
        prints = [tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(x.columns)).cast("decimal(38,0)"))).first()) for x in inputs]
        key = config_key(prints=prints, **settings)
        if (known := self._done("embeddings", config=key)) is not None and not known.isEmpty():
            return known.select("sample_id", "cell_id", "features")
        parts = []
        if mode in ("celltype", "both"):
            p = features.hard_probabilities(cells) if probabilities is None else probabilities
            parts.append(features.vectors(features.khop_composition(cells, adj, p, L.vocabulary(cells), k_hops), "cell_type"))
        if mode in ("expression", "both"):
            expression = self.read("expression") if genes is None else tables.select_genes(self.read("expression"), genes)
            if components:
                parts.append(features.khop_means(cells, adj, components_of.expression_components(cells, expression, components), k_hops))
            else:
                parts.append(features.vectors(features.khop_expression(cells, adj, expression, genes or sorted(r[0] for r in expression.select("gene").distinct().collect()), k_hops), "gene"))
        rows = parts[0] if len(parts) == 1 else features.concatenated(*parts)
        rows = cluster.encode(graph.connected(rows, adj), adj, **{k: settings[k] for k in ("epochs", "patience", "min_delta", "min_epochs")})
        self._write(rows, "embeddings", cells, config=key)
        return self._done("embeddings", config=key).select("sample_id", "cell_id", "features")

    def niche_profile(self, family: str = "niche", other: str | None = None, top_genes: int = 10, top_types: int | None = None) -> dict[str, DataFrame]:
        labels = self.read("niches").where(F.col("family") == family)
        out = {"sizes": profile.sizes(labels), "composition": profile.composition(labels, features.hard_probabilities(self.read("cells")))}
        if top_types:
            out["top_types"] = profile.top(out["composition"], "niche_id", "cell_type", "share", top_types)
        if self.has("expression"):
            out["markers"] = profile.markers(labels, self.read("expression"), top_genes)
        if other:
            b = self.read("niches").where(F.col("family") == other)
            out |= {"crosstab": profile.crosstab(labels, b), "agreement": profile.nmi(labels, b)}
        return out

    def verify(self) -> DataFrame:
        return profile.verify(self.read("cells"))

    def type_counts(self) -> DataFrame:
        """Cells of each type in each sample."""
        return profile.type_counts(self.read("cells"))

    def roster(self) -> DataFrame:
        """gene, and in how many samples and cells it has a value over 0."""
        there = F.col("value") > 0
        return self.read("expression").groupBy("gene").agg(F.countDistinct("sample_id").alias("n_samples"), F.sum(F.coalesce(there, F.lit(False)).cast("long")).alias("n_cells"))

    def missing_genes(self, genes: list[str]) -> DataFrame:
        """sample_id and gene of each asked gene that a sample's expression lacks."""
        asked = self.spark.createDataFrame([(g,) for g in genes], "gene string").withColumn("key", L.sanitise("gene"))
        have = self.read("expression").select("sample_id", L.sanitise("gene").alias("key")).distinct()
        return self.read("cells").select("sample_id").distinct().join(F.broadcast(asked)).join(have, ["sample_id", "key"], "left_anti").select("sample_id", "gene")

    def export(self) -> str:
        if not self.has("hplot"):
            raise tables.MissingKeyError("there is no result to export; run hplot first")
        return self.path("hplot")


def describe() -> str:
    """JSON of all commands."""
    commands: dict[str, Any] = {name: {"status": "stable"} for name in STABLE} | {name: {"status": "experimental"} for name in EXPERIMENTAL}
    commands["hplot"]["options"] = asdict(HplotConfig())
    return json.dumps({"commands": commands, "axes": list(AXES)}, indent=2)
