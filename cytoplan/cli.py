"""Command line: ``python -m cytoplan.cli COMMAND --root DIR ...``."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys

from pyspark.sql import SparkSession

from .plans.adapters import schema
from .plans.engine import AXES, EXPERIMENTAL, STABLE, Engine, HplotConfig
from .sources import tables


def listed(text: str) -> list[str]:
    """Words between commas or blanks."""
    return [w for w in re.split(r"[,\s]+", text) if w]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cytoplan")
    p.add_argument("command", choices=sorted({*STABLE, *EXPERIMENTAL}))
    p.add_argument("--root", default=".")
    p.add_argument("--cells")
    p.add_argument("--expression")
    p.add_argument("--base-type", type=listed, default=[])
    p.add_argument("--target-type", type=listed, default=[])
    p.add_argument("--base-type-by", choices=AXES, default="celltype")
    p.add_argument("--target-type-by", choices=AXES, default="celltype")
    p.add_argument("--base-gene-threshold", type=float, default=0.0)
    p.add_argument("--max-neighbor-distance", type=float, default=25.0)
    p.add_argument("--k", type=int, default=2)
    p.add_argument("--n", type=int, default=8)
    p.add_argument("--r", type=float, default=0.5)
    p.add_argument("--name")
    p.add_argument("--types", type=listed, default=[])
    p.add_argument("--min-size", type=int, default=10)
    p.add_argument("--lr-pairs")
    p.add_argument("--kernel", default="exponential")
    p.add_argument("--lambda", dest="scale", type=float, default=25.0)
    p.add_argument("--clusters", type=int)
    p.add_argument("--family", choices=("niche", "gexniche", "hniche"), default="niche")
    p.add_argument("--agreement", choices=("niche", "gexniche", "hniche"), help="family to compare with in niche-profile")
    p.add_argument("--top-n", type=int, default=10)
    p.add_argument("--k-hops", type=int, default=2)
    p.add_argument("--genes", type=listed, default=None)
    p.add_argument("--n-components", type=int, default=50)
    p.add_argument("--scope", choices=("cohort", "sample"), default="cohort")
    p.add_argument("--epochs", type=int, default=300)
    p.add_argument("--early-stop-patience", type=int, default=20)
    p.add_argument("--early-stop-min-delta", type=float, default=1e-4)
    p.add_argument("--early-stop-min-epochs", type=int, default=50)
    p.add_argument("--region-radius", type=float, default=15.0)
    p.add_argument("--low", type=int)
    p.add_argument("--high", type=int)
    p.add_argument("--covering-only", action="store_true")
    p.add_argument("--out", help="folder that hplot-finalize writes the summary to")
    p.add_argument("--storage-options", help="environment variable that holds options of an object store as JSON")
    p.add_argument("--soft", help="table of sample_id, cell_id, cell_type, p that niche takes for compositions")
    p.add_argument("--top-types", type=int, help="types of each niche that niche-profile lists")
    p.add_argument("--verbose", "-v", action="count", default=0, help="verify lists cells of each type; given twice, genes as well")
    p.add_argument("--mode", default="celltype")
    p.add_argument("--batch-correct", default="none")
    p.add_argument("--regions", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command in EXPERIMENTAL and os.environ.get("CYTOPLAN_EXPERIMENTAL") != "1":
        print(f"{a.command} is experimental; set CYTOPLAN_EXPERIMENTAL=1", file=sys.stderr)
        return 2
    if a.command == "describe":
        print(json.dumps(schema(parser()), indent=2))
        return 0
    spark = SparkSession.builder.appName("cytoplan").getOrCreate()
    if a.storage_options:
        tables.apply_storage_options(spark, a.storage_options)
    engine = Engine(spark, a.root)
    cfg = HplotConfig(a.base_type, a.target_type, a.base_type_by, a.target_type_by, a.base_gene_threshold, a.max_neighbor_distance, a.k, a.n, a.r, a.low, a.high, a.covering_only)
    cells = tables.read_cells(spark, a.cells) if a.cells else None
    expression = spark.read.schema(tables.EXPRESSION).parquet(a.expression) if a.expression else None
    try:
        if a.command in ("ingest", "run") and cells is None:
            raise tables.ContractError("--cells is needed")
        if a.command == "ingest":
            engine.ingest(cells, expression)
        elif a.command == "run":
            engine.run(cells, cfg, expression, a.overwrite).show()
        elif a.command == "hplot":
            engine.hplot(cfg, a.overwrite).show()
        elif a.command == "hplot-finalize":
            summary = engine.finalize(cfg if a.base_type else None)
            if a.out:
                summary.write.mode("overwrite").parquet(a.out)
            summary.show()
        elif a.command == "agg":
            engine.aggregates(a.name or "", a.types, a.max_neighbor_distance, a.k, a.n, a.r, a.min_size).show()
        elif a.command == "cci":
            engine.cci(tables.read_lr_pairs(spark, a.lr_pairs), a.kernel, a.scale, a.max_neighbor_distance, a.overwrite, a.genes).show()
        elif a.command == "niche":
            found = engine.niche(a.family, a.clusters, a.k_hops, a.max_neighbor_distance, a.mode, a.genes, a.n_components, a.batch_correct, a.epochs, a.regions, spark.read.parquet(a.soft) if a.soft else None, a.scope, a.early_stop_patience, a.early_stop_min_delta, a.early_stop_min_epochs, a.region_radius)
            found.show()
        elif a.command == "niche-profile":
            for name, df in engine.niche_profile(a.family, a.agreement, a.top_n, a.top_types).items():
                print(name)
                df.show()
        elif a.command == "verify":
            engine.verify().show()
            if a.verbose:
                engine.type_counts().orderBy("sample_id", "cell_type").show()
            if a.verbose > 1 and engine.has("expression"):
                engine.roster().orderBy("gene").show()
            if a.genes:
                engine.missing_genes(a.genes).show()
        elif a.command == "export":
            print(engine.export())
    except tables.ContractError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
