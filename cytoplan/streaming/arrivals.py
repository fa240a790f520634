"""Samples that arrive over time: a file stream whose micro-batches go through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import axes, graph, hplot
from ..sources.stage import discard, folder, staged
from ..sources.tables import CELLS, replace_samples


def follow(spark: SparkSession, source: str, out: str, base_types: list[str], target_types: list[str], reach: float = 25.0, checkpoint: str | None = None, once: bool = True):
    """Start a query that reads cells from new files under ``source`` and writes the curves of their samples under ``out``.

    A file holds whole samples; a sample that arrives again replaces its curve, also if it has none any more. With ``once`` it takes what is there and ends.
    """

    def each(batch: DataFrame, _: int) -> None:
        flags = axes.flagged(batch, axes.by_celltype(batch, base_types), axes.by_celltype(batch, target_types))
        edges = staged(graph.delaunay_edges(batch), "edges")
        replace_samples(hplot.hplot(batch, flags, graph.prune(edges, reach)), out, batch)
        discard(edges)

    stream = spark.readStream.schema(CELLS).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or folder(spark, "stream-state"))
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="30 seconds")).start()


def stream_hplot(spark: SparkSession, cells: DataFrame, base_types: list[str], target_types: list[str]) -> DataFrame:
    """The curves of ``cells`` by way of the stream."""
    source, out = folder(spark, "stream-in"), folder(spark, "stream-out")
    cells.select(*CELLS.names).repartition("sample_id").write.parquet(source)
    query = follow(spark, source, out, base_types, target_types)
    query.awaitTermination()
    schema = "layer int, base_type_prop double, target_type_prop double, base_type_count long, target_type_count long, all_type_count long, distance_um double, sample_id long"
    return spark.read.schema(schema).parquet(out)
