"""Where samples lie: folders, manifests, instrument outputs, and wide tables whose headers differ."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import sanitise
from .tables import ContractError, MissingKeyError, read_manifest

#: Ends of file or folder names that are samples.
ENDINGS = (".h5ad", ".zarr", ".parquet", ".csv", ".json", ".orc")
#: Prefix of a path that names a manifest.
LIST = "sample-list://"
#: What the folder of an instrument's output holds, one of the first two and the third.
XENIUM_MATRICES, XENIUM_CELLS = ("cell_by_feature_matrix.h5", "cell_feature_matrix.h5"), "cells.csv.gz"
#: Words that a column of cell types is likely to hold.
LIKELY = ("cell", "type", "annot", "class", "label", "cluster")


def _listed(spark: SparkSession, path: str) -> dict[str, Any]:
    """Status of each entry of a folder by name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        raise MissingKeyError(f"{path} does not exist")
    if not fs.getFileStatus(folder).isDirectory():
        raise ContractError(f"{path} is a file; give a folder, or a manifest as {LIST}{path}")
    return {s.getPath().getName(): s for s in fs.listStatus(folder)}


def enumerate_samples(spark: SparkSession, path: str) -> DataFrame:
    """path and sample_id, by path: a folder's samples (names without their ending), or the rows of a manifest ``sample-list://path``.

    Only names are listed on the driver. A plain file is refused, as it might be anything.
    """
    if path.startswith(LIST):
        return read_manifest(spark, path.removeprefix(LIST)).orderBy("path")
    rows = [(s.getPath().toString(), name.rsplit(".", 1)[0]) for name, s in _listed(spark, path).items() if name.lower().endswith(ENDINGS)]
    return spark.createDataFrame(sorted(rows), "path string, sample_id string")


def is_xenium(spark: SparkSession, path: str) -> bool:
    """Whether a folder is an instrument's output: a matrix of cells by features and a table of cells."""
    names = _listed(spark, path)
    return XENIUM_CELLS in names and any(m in names for m in XENIUM_MATRICES)


def likely_type_columns(columns: list[str]) -> list[str]:
    """Columns that may hold cell types, for messages about a missing one."""
    return sorted(c for c in columns if any(word in c.lower() for word in LIKELY))


def read_wide(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of CSV tables with the union of their columns, in the order of first sight; null where a table lacks one.

    Tables with the same header are one scan.
    """
    if not paths:
        raise ContractError("no tables to read")
    alike: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        alike.setdefault(tuple(spark.read.option("header", True).csv(path).columns), []).append(path)
    out: DataFrame | None = None
    for header, own in alike.items():
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
        part = spark.read.option("header", True).schema(schema).csv(own)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def resolved(spark: SparkSession, names: list[str], asked: list[str], prefix: str = "") -> list[str]:
    """The known name of each asked one, whatever its case and signs and with or without ``prefix``; all that are missing are reported together."""
    rows = spark.createDataFrame([(i, a.strip()) for i, a in enumerate(asked)], "i long, asked string")
    known = spark.createDataFrame([(n,) for n in names], "name string")
    key = lambda c: F.regexp_replace(sanitise(c), f"^{prefix}", "") if prefix else sanitise(c)
    found = rows.withColumn("key", key("asked")).join(F.broadcast(known.groupBy(key("name").alias("key")).agg(F.min("name").alias("name"))), "key", "left").orderBy("i").collect()
    missing = [r["asked"] for r in found if r["name"] is None]
    if missing:
        near = likely_type_columns(names)
        raise MissingKeyError("not found: " + ", ".join(missing) + (f"; candidates: {', '.join(near[:20])}" if near else ""))
    return [r["name"] for r in found]
