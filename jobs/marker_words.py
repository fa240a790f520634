"""Marker words of groups of documents that arrive over time: the profile of niches, with documents for cells and words for genes.

    python -m jobs.marker_words --tables DIR --out DIR [--config jobs/marker_words.json] [--master URL]

A file stream takes the files of ``documents`` that no earlier run has taken (its checkpoint under ``--out`` is the mark) and ends. The
input is a pattern, so that it may be a file, a folder or several of them; a file stream wants a folder otherwise. It writes

* ``counts``, by micro-batch: documents and words of each group. A batch that is run again replaces its own partition;
* ``profile``, by the first group column: the words of each group that are enriched most over all documents, from the counts of all
  batches; replaced as a whole.

So a run counts only new files, and a run without new files leaves the profile as it was. Words are runs of letters and digits in lower
case. Null and empty texts are documents without words; null groups are groups of their own; repeated rows are documents of their own.
A word counts in a group from ``least`` occurrences; ties in enrichment go to the more frequent, then to the smaller word. A file must not
change once it has been taken, as with any file stream.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoplan.operators import profile

log = logging.getLogger("jobs.marker_words")
CONFIG = Path(__file__).with_suffix(".json")


def settings_of(path: str | Path = CONFIG) -> dict[str, Any]:
    return json.loads(Path(path).read_text())


def counted(docs: DataFrame, groups: list[str]) -> DataFrame:
    """``groups``, word, n: occurrences of each word, and the group's documents where word is null. One pass, summed before the shuffle."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marked = F.concat(F.array(F.lit(None).cast("string")), words)
    return docs.select(*groups, F.explode(marked).alias("word")).groupBy(*groups, "word").agg(F.count(F.lit(1)).alias("n"))


def profiled(counts: DataFrame, groups: list[str], least: int, top: int) -> DataFrame:
    """``groups``, rank, word, n_documents, n_words, mean_count, log2_enrichment from summed counts."""
    whole = counts.groupBy(*groups, "word").agg(F.sum("n").alias("n"))
    members = whole.where("word is null").select(*groups, "n")
    sums = whole.where("word is not null").select(*groups, "word", F.col("n").alias("s"))
    rows = profile.enriched(sums, members, groups, "word").where(F.col("s") >= least)
    order = Window.partitionBy(*groups).orderBy(F.desc(F.round("log2_enrichment", 9)), F.desc("s"), "word")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(*groups, "rank", "word", F.col("n").alias("n_documents"), F.col("s").alias("n_words"), F.round("mean_value", 6).alias("mean_count"), F.round("log2_enrichment", 6).alias("log2_enrichment"))


def _schema(groups: list[str], rest: str) -> T.StructType:
    return T.StructType([*[T.StructField(g, T.StringType()) for g in groups], *T.StructType.fromDDL(rest).fields])


def take(spark: SparkSession, where: str, out: str, settings: dict[str, Any]) -> int:
    """Count the files that are new; the number of documents in them."""
    groups = settings["groups"]
    schema = _schema(groups, "text string")

    def each(batch: DataFrame, number: int) -> None:
        rows = counted(batch, groups).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/counts")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(f"{where}/{settings['input']}")
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def run(spark: SparkSession, where: str, out: str, settings: dict[str, Any]) -> dict[str, int]:
    """One run over ``documents`` under ``where``: documents that were new, and rows of the profile."""
    groups = settings["groups"]
    taken = take(spark, where, out, settings)
    log.info("read %d new documents of %s", taken, where)
    seen = Observation("profile")
    rows = profiled(spark.read.schema(_schema(groups, "word string, n long, batch long")).parquet(f"{out}/counts"), groups, settings["least"], settings["top"])
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy(groups[0]).parquet(f"{out}/profile")
    log.info("wrote %d rows to %s/profile", seen.get["rows"], out)
    return {"documents": taken, "rows": seen.get["rows"]}


def output(spark: SparkSession, out: str, settings: dict[str, Any]) -> DataFrame:
    """The profile as the last run left it."""
    first, *others = settings["groups"]
    schema = _schema(others, f"rank int, word string, n_documents long, n_words long, mean_count double, log2_enrichment double, {first} string")
    return spark.read.schema(schema).parquet(f"{out}/profile")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.marker_words", description=__doc__.splitlines()[0])
    p.add_argument("--tables", required=True, help="folder of the tables")
    p.add_argument("--out", required=True, help="folder of the results and the checkpoint")
    p.add_argument("--config", default=str(CONFIG))
    p.add_argument("--master")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName("marker_words")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    try:
        print(json.dumps(run(spark, a.tables, a.out, settings_of(a.config))))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
