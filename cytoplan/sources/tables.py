"""Readers, writers and guards of samples, manifests, pair tables and results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import sanitise
from .stage import discard, staged

CELLS = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("cell_id", T.LongType()), T.StructField("x_um", T.DoubleType()), T.StructField("y_um", T.DoubleType()), T.StructField("cell_type", T.StringType())])
EXPRESSION = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("cell_id", T.LongType()), T.StructField("gene", T.StringType()), T.StructField("value", T.DoubleType())])
FORMATS = ("parquet", "csv", "json", "orc")


class ContractError(ValueError):
    """A table lacks what an operator needs, or a name clashes."""


class MissingKeyError(ContractError, KeyError):
    """A gene, type or column that was asked for does not exist."""


def read_cells(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Cells of one or many samples; columns are pruned and filters pushed down by the format's reader."""
    if format not in FORMATS:
        raise ContractError(f"format must be one of {FORMATS}")
    reader = spark.read.schema(schema or CELLS)
    return (reader.option("header", True) if format == "csv" else reader).format(format).load(path)


def write_result(df: DataFrame, path: str, format: str = "parquet", by_sample: bool = True, overwrite: bool = False) -> None:
    """Write a result; with ``by_sample``, only the partitions of samples that it has are replaced."""
    writer = df.write.format(format).mode("overwrite" if overwrite else "append")
    if format == "csv":
        writer = writer.option("header", True)
    if by_sample:
        writer = writer.partitionBy("sample_id").option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def replace_samples(df: DataFrame, path: str, samples: DataFrame, /, **within: str) -> None:
    """Write ``df`` in place of all that ``path`` has of ``samples``, also of those without rows in ``df``.

    ``within`` names partition columns above ``sample_id`` and their values; other partitions stay. The rows are staged first and take
    their samples' partitions in one dynamic overwrite, so a failure on the way leaves the old rows of a sample or the new ones. Only samples
    that have no row any more are deleted one by one, at the end.
    """
    for name, value in within.items():
        df = df.withColumn(name, F.lit(value))
    rows = staged(df, "results")
    folder = "/".join([path, *[f"{k}={v}" for k, v in within.items()]])
    gone = staged(samples.select("sample_id").distinct().join(rows.select("sample_id").distinct(), "sample_id", "left_anti"), "gone")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*within, "sample_id").parquet(path)
    for r in gone.toLocalIterator():
        delete_path(df.sparkSession, f"{folder}/sample_id={r['sample_id']}")
    discard(rows, gone)


def pending(samples: DataFrame, done: DataFrame | None, overwrite: bool = False) -> DataFrame:
    """Samples that have no result yet, or all with ``overwrite``."""
    return samples if overwrite or done is None else samples.join(done.select("sample_id").distinct(), "sample_id", "left_anti")


def parse_manifest(lines: DataFrame) -> DataFrame:
    """path and sample_id from lines ``path[TAB or ,]id``; ``#`` lines and blank ones are left out, the id is the file's stem if there is none."""
    text = F.trim(F.regexp_replace("value", "^﻿", ""))
    rows = lines.select(text.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    mark = F.when(F.instr("line", "\t") > 0, F.lit("\t")).when(F.instr("line", ",") > 0, F.lit(","))
    path = F.trim(F.when(mark.isNull(), F.col("line")).otherwise(F.split_part("line", F.coalesce(mark, F.lit("\t")), F.lit(1))))
    given = F.trim(F.split_part("line", F.coalesce(mark, F.lit("\t")), F.lit(2)))
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)/?$", 1), r"\.[^.]*$", "")
    return rows.select(path.alias("path"), F.when(given != "", given).otherwise(stem).alias("sample_id"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def duplicate_ids(samples: DataFrame) -> DataFrame:
    """Sample ids that occur more than once."""
    return samples.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1")


def require_unique(samples: DataFrame) -> None:
    found = [str(r[0]) for r in duplicate_ids(samples).orderBy("sample_id").limit(20).collect()]
    if found:
        raise ContractError("sample ids occur more than once: " + ", ".join(found))


def gdc_manifest(rows: DataFrame) -> DataFrame:
    """id, filename and md5 (null if absent) of a download manifest; ``file_id`` and ``file_name`` are known as well."""
    names = {c.lower(): c for c in rows.columns}
    pick = [next((names[k] for k in keys if k in names), None) for keys in (("id", "file_id"), ("filename", "file_name"), ("md5", "md5sum"))]
    if None in pick[:2]:
        raise ContractError("a manifest needs id and filename columns")
    md5 = F.col(pick[2]) if pick[2] else F.lit(None).cast("string")
    return rows.select(F.trim(F.col(pick[0])).alias("id"), F.trim(F.col(pick[1])).alias("filename"), md5.alias("md5")).where("id <> ''")


def select_layer(expression: DataFrame, layer: str = "X") -> DataFrame:
    """Rows of one expression layer, X, raw or a named one; a leading ``adata.`` is dropped."""
    name = layer.removeprefix("adata.")
    return expression.where(F.col("layer") == name).drop("layer")


def apply_storage_options(spark: SparkSession, name: str) -> list[str]:
    """Set the options that the environment variable ``name`` holds in the session's Hadoop configuration; the keys set."""
    conf = spark._jsc.hadoopConfiguration()
    options = storage_options(name)
    for key, value in options.items():
        conf.set(str(key), str(value))
    return sorted(options)


def storage_options(name: str) -> dict:
    """Options of an object store from a JSON environment variable."""
    import json

    text = os.environ.get(name, "")
    try:
        out = json.loads(text) if text else {}
    except json.JSONDecodeError as e:
        raise ContractError(f"{name} is not valid JSON: {e}") from e
    if not isinstance(out, dict):
        raise ContractError(f"{name} must be a JSON object")
    return out


def lr_pairs(rows: DataFrame) -> DataFrame:
    """ligand and receptor; aliases ``*_gene_symbol`` are known, blanks and ``nan`` dropped, the first of pairs equal in upper case kept.

    ``rows`` may have ``row_no``, the order of the file.
    """
    names = {c.lower(): c for c in rows.columns}
    pick = [next((names[k] for k in (x, f"{x}_gene_symbol") if k in names), None) for x in ("ligand", "receptor")]
    if None in pick:
        raise ContractError("a pair table needs ligand and receptor columns")
    order = F.col(names["row_no"]) if "row_no" in names else F.monotonically_increasing_id()
    out = rows.select(F.trim(F.col(pick[0])).alias("ligand"), F.trim(F.col(pick[1])).alias("receptor"), order.alias("row_no"))
    for c in ("ligand", "receptor"):
        out = out.where(F.col(c).isNotNull() & (F.col(c) != "") & (F.lower(c) != "nan"))
    first = Window.partitionBy(F.upper("ligand"), F.upper("receptor")).orderBy("row_no")
    return out.withColumn("r", F.row_number().over(first)).where("r = 1").select("ligand", "receptor")


def read_lr_pairs(spark: SparkSession, path: str) -> DataFrame:
    return lr_pairs(spark.read.option("header", True).option("sep", "\t" if path.endswith((".tsv", ".txt")) else ",").csv(path))


def select_genes(expression: DataFrame, genes: list[str]) -> DataFrame:
    """Rows of the genes, matched by sanitised symbol; all that are missing are reported together."""
    wanted = expression.sparkSession.createDataFrame([(g,) for g in genes], "asked string").withColumn("key", sanitise("asked"))
    have = expression.select(sanitise("gene").alias("key")).distinct()
    missing = sorted(r[0] for r in wanted.join(have, "key", "left_anti").select("asked").collect())
    if missing:
        raise MissingKeyError("genes not found: " + ", ".join(missing))
    return expression.withColumn("key", sanitise("gene")).join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi").drop("key")


def fingerprint(cells: DataFrame, columns: tuple[str, ...] = ("cell_id", "x_um", "y_um")) -> DataFrame:
    """Number of rows and an order-free checksum of ``columns`` of each sample: tells whether a stored graph or result is stale."""
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    return cells.groupBy("sample_id").agg(F.count("*").alias("n_cells"), F.sum(row).cast("string").alias("checksum"))


def stale_samples(cells: DataFrame, stored: DataFrame) -> DataFrame:
    """Samples whose stored fingerprint is missing or differs."""
    return fingerprint(cells).join(stored, ["sample_id", "n_cells", "checksum"], "left_anti").select("sample_id")
