"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

from __future__ import annotations

import json
import os
import time
from importlib.util import find_spec
from statistics import median

from pyspark.sql import SparkSession

from cytoplan.operators import graph
from cytoplan.plans import catalog, fixtures

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
#: Over the derived cells (600 a sample at sf0.1).
NAMES = ("delaunay_edges", "khop_pairs", "region_gate", "hop_layers", "hplot_celltype", "agg_membership", "cci_exponential", "khop_features_hard", "niche_markers", "niche_nmi", "region_outlines", "overlapping_sides", "knn_lists")
#: Over one cell for each lineitem, with the graph of ``large_delaunay_edges`` at hand.
LARGE = ("khop_pairs", "hplot_celltype", "cci_exponential", "niche_composition", "type_counts")
#: Over documents and benchmark, where the subpackage is there.
CORPUS = ("op2_simhash_gray_index", "op4_simhash_decontamination")
RUNS = 3


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, make, warm: int = 1, runs: int = RUNS) -> None:
        """Median of ``runs`` runs after ``warm`` others."""
        seconds = []
        for _ in range(warm + runs):
            spark.catalog.clearCache()
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        took[name] = round(median(seconds[warm:]), 3)

    for name in NAMES:
        timed(name, lambda n=name: catalog.QUERIES[n](catalog.World(spark, SF_DIR)))
    timed("large_delaunay_edges", lambda: catalog.World(spark, SF_DIR, fixtures.bench_cells(spark, SF_DIR)).edges, 0)
    world = catalog.World(spark, SF_DIR, fixtures.bench_cells(spark, SF_DIR))
    world.edges.count()
    for name in LARGE:
        timed(f"large_{name}", lambda n=name: catalog.QUERIES[n](world), 0)
    # One sample of all cells: triangulated in tiles.
    one = catalog.World(spark, SF_DIR, fixtures.bench_cells(spark, SF_DIR, 1, 800))
    timed("one_sample_delaunay_edges", lambda: graph.delaunay_edges(one.cells), 0, 1)
    if find_spec("cytoplan.llm"):
        from cytoplan.llm import queries

        for name in CORPUS:
            timed(name, lambda n=name: queries.queries()[n](spark, SF_DIR), 0)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
