"""Neighbour graphs: Delaunay edges, adjacency, hops, components and quotients. All joins carry sample_id."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import delaunay, triangle_edges
from ..sources.stage import discard, folder, staged
from . import tiling

#: Cells of a sample whose graph one task walks; those of larger samples are walked by joins.
WHOLE_GRAPH = 500_000
EDGES = "sample_id long, src long, dst long, length double"
TRIANGLES = "sample_id long, a long, b long, c long"


def _sample_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cell_id", kind="stable")
    xy, ids = pdf[["x_um", "y_um"]].to_numpy(float), pdf["cell_id"].to_numpy(np.int64)
    sides = triangle_edges(delaunay(xy))
    a, b = ids[sides[:, 0]], ids[sides[:, 1]]
    d = xy[sides[:, 0]] - xy[sides[:, 1]]
    return pd.DataFrame({"sample_id": pdf["sample_id"].iloc[0] if len(pdf) else 0, "src": np.minimum(a, b), "dst": np.maximum(a, b), "length": np.sqrt((d * d).sum(1))})


def delaunay_edges(cells: DataFrame, whole: int = tiling.WHOLE_CELLS) -> DataFrame:
    """Each undirected Delaunay edge once, src < dst, with its length in microns. Cells without coordinates are left out.

    Samples of more than ``whole`` cells are triangulated in tiles, see :mod:`tiling`.
    """
    rows = cells.select("sample_id", "cell_id", "x_um", "y_um").where("x_um is not null and y_um is not null")
    rows, sides = tiling.split(rows, whole)
    edges = rows.groupBy("sample_id").applyInPandas(_sample_edges, EDGES)
    if sides is None:
        return edges
    return edges.union(sides.groupBy("sample_id", "src", "dst").agg(F.min("length").alias("length")))


def delaunay_triangles(cells: DataFrame, whole: int = tiling.WHOLE_CELLS) -> DataFrame:
    """Each Delaunay triangle once, a < b < c; see :func:`delaunay_edges`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id", kind="stable")
        t = np.sort(pdf["cell_id"].to_numpy(np.int64)[delaunay(pdf[["x_um", "y_um"]].to_numpy(float))], axis=1)
        return pd.DataFrame({"sample_id": pdf["sample_id"].iloc[0], "a": t[:, 0], "b": t[:, 1], "c": t[:, 2]})

    rows, sides = tiling.split(cells.select("sample_id", "cell_id", "x_um", "y_um").where("x_um is not null and y_um is not null"), whole)
    triangles = rows.groupBy("sample_id").applyInPandas(run, TRIANGLES)
    if sides is None:
        return triangles
    return triangles.union(sides.where("w > dst").select("sample_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("c")))


def prune(edges: DataFrame, most: float) -> DataFrame:
    """Edges shorter than ``most``."""
    return edges.where(F.col("length") < most)


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without self-loops: sample_id, a, b, length."""
    there = edges.where("src <> dst").select("sample_id", F.col("src").alias("a"), F.col("dst").alias("b"), "length")
    return there.unionAll(there.select("sample_id", F.col("b").alias("a"), F.col("a").alias("b"), "length"))


def neighbour_lists(adj: DataFrame) -> DataFrame:
    return adj.groupBy("sample_id", F.col("a").alias("cell_id")).agg(F.array_sort(F.collect_set("b")).alias("neighbours"))


def rings(cells: DataFrame, adj: DataFrame, k: int) -> DataFrame:
    """sample_id, a, b, hop: the exact number of hops from a to b, 0 to k, a itself at 0.

    Edges go both ways, so a neighbour of a cell at hop h lies at h - 1, h or h + 1: a new level is what the last one reaches less the
    last two. Levels that later ones start from are staged.
    """
    same = ["sample_id", "a", "b"]
    step = adj.select("sample_id", F.col("a").alias("m"), F.col("b").alias("n"))
    levels = [cells.select("sample_id", F.col("cell_id").alias("a"), F.col("cell_id").alias("b"))]
    for hop in range(1, k + 1):
        if hop == 1:
            new = cells.select("sample_id", F.col("cell_id").alias("a")).join(adj.select(*same), ["sample_id", "a"]).select(*same).distinct()
        else:
            new = levels[-1].withColumnRenamed("b", "m").join(step, ["sample_id", "m"]).select("sample_id", "a", F.col("n").alias("b")).distinct()
            new = new.where("a <> b").join(levels[-1], same, "left_anti")
            if hop > 2:
                new = new.join(levels[-2], same, "left_anti")
        levels.append(staged(new, "ring") if 1 < hop < k else new)
    return functools.reduce(DataFrame.unionAll, [level.withColumn("hop", F.lit(hop)) for hop, level in enumerate(levels)])


def khop(cells: DataFrame, adj: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of at most k hops, a itself included; k = 0 is a alone."""
    return rings(cells, adj, max(0, k)).drop("hop")


def _search(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Hops from the nearest source, -1 if none is reached. ``nodes`` is sorted."""
    hops = np.full(len(nodes), -1)
    place_a, place_b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    order = np.argsort(place_a, kind="stable")
    to = place_b[order]
    cut = np.searchsorted(place_a[order], np.arange(len(nodes) + 1))
    front = np.flatnonzero(sources)
    hops[front] = 0
    depth = 0
    while len(front):
        depth += 1
        counts = cut[front + 1] - cut[front]
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(cut[front], counts)
        front = np.unique(to[at])
        front = front[hops[front] < 0]
        hops[front] = depth
    return hops


def _by_size(rows: DataFrame, whole: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of samples of at most ``whole`` cells, and those of larger ones, None if there are none."""
    large = staged(rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select("sample_id"), "large-samples")
    if large.isEmpty():
        return rows, None
    return rows.join(large, "sample_id", "left_anti"), rows.join(large, "sample_id", "left_semi")


def hops_to(cells: DataFrame, adj: DataFrame, source: str, whole: int = WHOLE_GRAPH) -> DataFrame:
    """sample_id, cell_id, hops (null where unreachable) from the nearest cell whose ``source`` column is true.

    Samples of at most ``whole`` cells take a task each; the graph of larger ones is walked level by level, see :func:`hops_by_levels`.
    """

    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("cell_id", kind="stable")
        ids = nodes["cell_id"].to_numpy(np.int64)
        h = _search(ids, edges["a"].to_numpy(np.int64), edges["b"].to_numpy(np.int64), nodes["source"].to_numpy(bool))
        return pd.DataFrame({"sample_id": nodes["sample_id"], "cell_id": ids, "hops": pd.arrays.IntegerArray(np.maximum(h, 0).astype(np.int32), h < 0)})

    rows = cells.select("sample_id", "cell_id", F.coalesce(F.col(source), F.lit(False)).alias("source"))
    small, large = _by_size(rows, whole)
    links = adj.select("sample_id", "a", "b")
    if large is not None:
        far = hops_by_levels(large, links)
        links = links.join(small.select("sample_id").distinct(), "sample_id", "left_semi")
    near = small.groupBy("sample_id").cogroup(links.groupBy("sample_id")).applyInPandas(run, "sample_id long, cell_id long, hops int")
    return near if large is None else near.unionByName(far)


def hops_by_levels(cells: DataFrame, adj: DataFrame) -> DataFrame:
    """As :func:`hops_to`, of a column ``source``, by joins that every task takes part in.

    A level is what the last one reaches, less itself and the one before: edges go both ways, so nothing else can come up again.
    Each level is written once, as a partition of a staged table; there are as many rounds as the farthest cell has hops.
    """
    spark, path = cells.sparkSession, folder(cells.sparkSession, "hops")
    step = staged(adj.join(cells.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id", F.col("a").alias("cell_id"), "b"), "steps")
    key, schema = ["sample_id", "cell_id"], "sample_id long, cell_id long"
    level = lambda hop: spark.read.schema(schema).parquet(f"{path}/hops={hop}")
    cells.where("source").select(*key).distinct().write.parquet(f"{path}/hops=0")
    hop = 0
    while not level(hop).isEmpty():
        new = level(hop).join(step, key).select("sample_id", F.col("b").alias("cell_id")).distinct().join(level(hop), key, "left_anti")
        if hop:
            new = new.join(level(hop - 1), key, "left_anti")
        hop += 1
        new.write.parquet(f"{path}/hops={hop}")
    discard(step)
    found = spark.read.schema(schema + ", hops int").parquet(path)
    return cells.select(*key).join(found, key, "left")


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, by taking the smaller root over edges and jumping to roots of roots."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not (root[root] == root).all():
            root = root[root]


def components(members: DataFrame, adj: DataFrame, whole: int = WHOLE_GRAPH) -> DataFrame:
    """sample_id, cell_id, component (its smallest cell_id) of the subgraph that ``members`` (sample_id, cell_id) induce.

    Samples of at most ``whole`` members take a task each, larger ones go by :func:`components_by_stars`.
    """

    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(nodes["cell_id"].to_numpy(np.int64))
        a, b = edges["a"].to_numpy(np.int64), edges["b"].to_numpy(np.int64)
        if len(ids):
            at, to = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (a, b))
            inside = (ids[at] == a) & (ids[to] == b)
            root = _joined(len(ids), at[inside], to[inside])
        return pd.DataFrame({"sample_id": nodes["sample_id"].iloc[0] if len(nodes) else 0, "cell_id": ids, "component": ids[root] if len(ids) else ids})

    small, large = _by_size(members.select("sample_id", "cell_id").distinct(), whole)
    links = adj.select("sample_id", "a", "b")
    if large is not None:
        far = components_by_stars(large, links)
        links = links.join(small.select("sample_id").distinct(), "sample_id", "left_semi")
    near = small.groupBy("sample_id").cogroup(links.groupBy("sample_id")).applyInPandas(run, "sample_id long, cell_id long, component long")
    return near if large is None else near.unionByName(far)


def components_by_stars(members: DataFrame, adj: DataFrame, most_rounds: int = 60) -> DataFrame:
    """As :func:`components`, by joins: each node's larger neighbours, then its smaller ones, are linked to the smallest it knows, until nothing changes.

    The number of rounds grows with the logarithm of the longest path. Each is written once.
    """
    members = staged(members, "members")
    of = lambda end: members.select("sample_id", F.col("cell_id").alias(end))
    links = adj.where("a > b").select("sample_id", "a", "b").join(of("a"), ["sample_id", "a"], "left_semi").join(of("b"), ["sample_id", "b"], "left_semi")
    now = staged(links.select("sample_id", "a", "b").distinct(), "stars")
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("sample_id", "a", "b").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        both = now.union(now.select("sample_id", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("sample_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, ["sample_id", "a"]).select("sample_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        first = large.groupBy("sample_id", "a").agg(F.min("b").alias("m"))
        small = large.join(first, ["sample_id", "a"]).where("b <> m").select("sample_id", F.col("b").alias("a"), F.col("m").alias("b")).union(first.select("sample_id", "a", F.col("m").alias("b")))
        after = staged(small.where("a <> b").distinct(), "stars")
        discard(now)
        now, before = after, mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("sample_id", F.col("a").alias("cell_id"), F.col("b").alias("component"))
    return members.join(roots, ["sample_id", "cell_id"], "left").withColumn("component", F.coalesce("component", "cell_id"))


def connected(cells: DataFrame, adj: DataFrame) -> DataFrame:
    """Cells that have a neighbour."""
    return cells.join(adj.select("sample_id", F.col("a").alias("cell_id")), ["sample_id", "cell_id"], "left_semi")


def quotient(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Meta-edges lo < hi between different aggregates that an edge joins, and how many do. membership: sample_id, cell_id, aggregate_id."""
    m = membership.where("aggregate_id is not null")
    of = lambda end, name: m.select("sample_id", F.col("cell_id").alias(end), F.col("aggregate_id").alias(name))
    joined = edges.join(of("src", "x"), ["sample_id", "src"]).join(of("dst", "y"), ["sample_id", "dst"]).where("x <> y")
    return joined.groupBy("sample_id", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.count("*").alias("n_edges"))
