"""Layer curves of a cohort that grows: only samples whose cells are new or changed are computed.

    python -m jobs.cohort_curves --tables DIR --out DIR [--config jobs/cohort_curves.json] [--master URL]

Reads a table of cells (or derives one from another table by the expressions under ``derive``) and writes

* ``curves``, by settings and sample: each sample's curve with the fingerprint of the cells that it was made of. A sample without a
  curve has one row without a layer. These fingerprints are the job's mark of what it has done;
* ``summary``, by settings and sample: the curves of the samples that the cells now have, without gaps; replaced as a whole.

A sample's rows are replaced in one dynamic partition overwrite, so a run that breaks off leaves each sample's old or new rows, and the
next run takes the rest. Curves of other cells than today's are told by their fingerprint and are not summarised. Running again on the
same cells computes nothing and writes the same summary. An empty table of cells gives an empty summary; cells without coordinates have
no neighbours.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cytoplan.operators import axes, graph, hplot
from cytoplan.plans import fixtures
from cytoplan.plans.engine import CONTENT, config_key
from cytoplan.sources import tables
from cytoplan.sources.stage import staged, stages

log = logging.getLogger("jobs.cohort_curves")
CONFIG = Path(__file__).with_suffix(".json")
MARK = ["sample_id", "n_cells", "checksum"]
CURVE = "n_cells long, checksum string, layer int, base_type_prop double, target_type_prop double, base_type_count long, target_type_count long, all_type_count long, distance_um double, config string, sample_id long"
SUMMARY = CURVE.removeprefix("n_cells long, checksum string, ").replace("config string, ", "")


def settings_of(path: str | Path = CONFIG) -> dict[str, Any]:
    return json.loads(Path(path).read_text())


def key_of(settings: dict[str, Any]) -> str:
    """The partition of curves made with these settings; the range only concerns the summary."""
    return config_key(**{k: v for k, v in settings.items() if k not in ("low", "high")})


def cells_of(spark: SparkSession, where: str, settings: dict[str, Any]) -> DataFrame:
    if settings.get("derive"):
        return fixtures.cells(spark, where, {**settings["derive"], "table": settings["table"]})
    return tables.read_cells(spark, f"{where}/{settings['table']}.parquet")


def read_back(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table that an earlier run wrote, or None."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def run(spark: SparkSession, where: str, out: str, settings: dict[str, Any]) -> dict[str, int]:
    """One run over the tables under ``where``; counts of samples read and computed, and of rows written."""
    key = key_of(settings)
    with stages():
        cells = staged(cells_of(spark, where, settings).select(*tables.CELLS.names), "cells")
        prints = staged(tables.fingerprint(cells, CONTENT["cells"]), "prints")
        stored = read_back(spark, f"{out}/curves", CURVE)
        done = None if stored is None else stored.where(F.col("config") == key).select(*MARK).distinct()
        todo = staged(prints if done is None else prints.join(done, MARK, "left_anti"), "todo")
        read, computed = prints.count(), todo.count()
        log.info("read %d cells in %d samples of %s; %d samples are new or changed", cells.count(), read, where, computed)
        if computed:
            fresh = cells.join(todo, "sample_id", "left_semi")
            edges = staged(graph.prune(graph.delaunay_edges(fresh), settings["reach_um"]), "edges")
            flags = axes.flagged(fresh, axes.by_celltype(fresh, settings["base"]), axes.by_celltype(fresh, settings["target"]))
            curves = hplot.hplot(fresh, flags, edges, settings["hops"], settings["least_neighbours"], settings["base_share"])
            rows = todo.join(curves, "sample_id", "left").withColumn("config", F.lit(key))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config", "sample_id").parquet(f"{out}/curves")
            log.info("wrote the curves of %d samples to %s/curves", computed, out)
        now = read_back(spark, f"{out}/curves", CURVE)
        now = (spark.createDataFrame([], CURVE) if now is None else now).where((F.col("config") == key) & F.col("layer").isNotNull()).join(prints, MARK, "left_semi")
        chosen = hplot.in_range(now.drop("n_cells", "checksum", "config"), settings.get("low"), settings.get("high"))
        seen = Observation("summary")
        shown = {c: F.round(c, 6) + F.lit(0.0) for c in ("base_type_prop", "target_type_prop", "distance_um")}
        summary = hplot.gap_filled(chosen).withColumns(shown).observe(seen, F.count(F.lit(1)).alias("rows"))
        summary.repartition("sample_id").write.mode("overwrite").partitionBy("sample_id").parquet(f"{out}/summary/config={key}")
        log.info("wrote %d rows to %s/summary", seen.get["rows"], out)
    return {"samples": read, "computed": computed, "rows": seen.get["rows"]}


def output(spark: SparkSession, out: str, settings: dict[str, Any]) -> DataFrame:
    """The summary as the last run left it."""
    rows = read_back(spark, f"{out}/summary/config={key_of(settings)}", SUMMARY)
    return spark.createDataFrame([], SUMMARY) if rows is None else rows


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.cohort_curves", description=__doc__.splitlines()[0])
    p.add_argument("--tables", required=True, help="folder of the tables")
    p.add_argument("--out", required=True, help="folder of the results")
    p.add_argument("--config", default=str(CONFIG))
    p.add_argument("--master")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName("cohort_curves")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    try:
        print(json.dumps(run(spark, a.tables, a.out, settings_of(a.config))))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
