"""How many niches there are: nearest neighbours by inverted lists, and community sweeps in many tasks, over the cohort or by sample.

Neighbours. Groups (the cohort, or a sample each) of up to ``exact_below`` rows are searched exactly. Rows of larger ones are dealt to
lists about centres, which k-means fits to a sample of at most SAMPLE rows; a row asks the PROBES lists next to it, its own first, and of
the others only what is nearer than the k nearest there. Lists are cut into blocks on both sides, so a task holds two blocks whatever the
size of a list. Distances are those of differences and ties go by id, so what is found does not depend on how rows were dealt.

Sweeps. A group's graph is packed into one row and written once; every (group, resolution, repeat) reads it from the shared folder, and
its labels are one row as well. Nothing goes through the driver. A cohort of more than MOST_EDGES edges is first reduced: communities
are found within each list, and the next search is over the weighted graph of these; cells then move to a better community over the
whole graph.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import discard, staged
from .cluster import MOST_EDGES, _closest, communities

KEY = ["sample_id", "cell_id"]
#: Rows that are compared all with all; rows of a list, at most so many lists; lists that a row asks; rows that centres are fitted to.
EXACT_BELOW, LIST, MOST_LISTS, PROBES, SAMPLE = 20_000, 1024, 16_384, 8, 50_000
#: Rows of a block; tasks that fit centres (a fixed number, as they draw the first ones).
BLOCK, TASKS = 2048, 12
RESOLUTIONS, REPEATS = (0.5, 1.0, 2.0), 5
#: Resolution of the communities within lists: finer than those that are looked for, so that few cells are joined for good too early.
FINER = 2.0
#: Tasks that pack groups' edges, at most; cells of a block whose silhouettes are computed together.
MOST_TASKS, CELLS = 4096, 16_384
#: Rounds in which cells of a reduced graph move to a better community; half of the cells in each.
ROUNDS = 4


def _centres(data: DataFrame, total: int, size: int, seed: int) -> np.ndarray:
    """Centres of lists of about ``size`` rows, fitted to the rows with the smallest hashes."""
    lists = max(2, min(MOST_LISTS, -(-total // size)))
    some = staged(data.orderBy(F.xxhash64("id")).limit(SAMPLE), "sample")
    most = some.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    # Values of 30 bits add up exactly, so the centres are the same in whatever order tasks end.
    unit = 2.0 ** min(1000.0, float(30 - np.ceil(np.log2(most))))
    some = some.select("id", array_to_vector(F.transform("v", lambda x: F.rint(x * unit) / unit)).alias("x"))
    # The limit leaves one partition. Rows drawn at random begin: k-means|| clusters its candidates in the driver, by the square of the lists.
    some = some.repartition(TASKS, "id").sortWithinPartitions("id")
    return np.stack(KMeans(k=lists, seed=seed, maxIter=10, initMode="random", featuresCol="x").fit(some).clusterCenters())


def with_lists(data: DataFrame, large: DataFrame, centres: np.ndarray | None, probes: int) -> DataFrame:
    """data (id, grp, v) with ``lists``: the nearest centres of rows of groups in ``large``, [-1] for others."""
    marked = data.join(large.select("grp", F.lit(True).alias("many")), "grp", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    if centres is None:
        return marked.select("id", "grp", "v", F.array(F.lit(-1)).alias("lists"))
    shared = data.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        own = (c * c).sum(1)
        n = min(probes, len(c))
        for batch in batches:
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            many = batch.column(3).to_numpy(zero_copy_only=False)
            lists = []
            for i in range(0, len(v), 1024):
                d = own - 2 * v[i : i + 1024] @ c.T
                near = np.argpartition(d, n - 1, axis=1)[:, :n]
                near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
                lists += [row if m else [-1] for row, m in zip(near.tolist(), many[i : i + 1024], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lists, pa.list_(pa.int32()))], ["id", "grp", "v", "lists"])

    return marked.select("id", "grp", "v", "many").mapInArrow(run, "id long, grp long, v array<double>, lists array<int>")


def nearest(rows: DataFrame, k: int = 15, within: str | None = None, id_col: str = "vec_id", column: str = "features", exact_below: int = EXACT_BELOW, probes: int = PROBES, size: int = LIST, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """a, b, rank, d2, grp: about the k nearest other rows of each row, of the same ``within``; and id, grp, lists of each row (staged)."""
    data = staged(rows.select(F.col(id_col).cast("long").alias("id"), (F.lit(0) if within is None else F.col(within)).cast("long").alias("grp"), F.col(column).cast("array<double>").alias("v")), "vectors")
    counts = data.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    large = staged(counts.where(F.col("n") > exact_below), "large")
    total = large.agg(F.sum("n")).first()[0]
    centres = _centres(data.join(large, "grp", "left_semi"), total, size, seed) if total else None
    placed = staged(with_lists(data, large, centres, probes), "placed")
    # A row's own list goes first: what other lists send of rows farther than the k nearest there would only be shuffled to be dropped.
    own = placed.select("id", "grp", "v", F.element_at("lists", 1).alias("list"))
    best = staged(_best(_found(own, own, k), k), "near-own")
    if centres is not None:
        farthest = F.when(F.size("near") == k, F.element_at("near", -1)["d2"]).otherwise(F.lit(float("inf")))
        others = placed.where(F.size("lists") > 1).join(best.select("grp", F.col("a").alias("id"), farthest.alias("most")), ["grp", "id"], "left")
        others = others.select("id", "grp", "v", F.coalesce("most", F.lit(float("inf"))).alias("most"), F.explode(F.slice("lists", 2, probes)).alias("list"))
        first, best = best, staged(_best(best.unionByName(_found(others, own, k)), k), "near")
        discard(first)
    discard(data, large)
    return best.select("grp", "a", F.posexplode("near").alias("rank", "x")).select("grp", "a", "x.b", "x.d2", (F.col("rank") + 1).alias("rank")), placed


def _best(found: DataFrame, k: int) -> DataFrame:
    """grp, a, near: the k nearest of all that was found of a row."""
    return found.groupBy("grp", "a").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _first_copies(v: np.ndarray, n: int) -> np.ndarray:
    """Places, ascending, of the first ``n`` copies of each row: with ties by place, others are among the ``n`` nearest of nothing."""
    if len(v) <= n or not v.shape[1]:
        return np.arange(len(v))
    name = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(name, kind="stable")
    nth = np.arange(len(v)) - np.searchsorted(name[order], name[order])
    return np.sort(order[nth < n])


def _found(asks: DataFrame, has: DataFrame, k: int) -> DataFrame:
    """grp, a, near (d2, b): what each block of a list has of the k nearest of each row that asks there, up to the distance ``most`` if asks have one. id, grp, v, list of both."""
    at = ["grp", "list"]
    blocks = lambda df, name: df.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = staged(blocks(has, "has").join(blocks(asks, "asks"), at), "lists")
    own = lambda side: F.pmod(F.xxhash64("id"), F.col(side)).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    bounded = "most" in asks.columns
    left = asks.join(sizes, at).select(*at, own("asks").alias("q"), every("has").alias("d"), "id", "v", *["most"] * bounded)
    right = has.join(sizes, at).select(*at, every("asks").alias("q"), own("has").alias("d"), "id", "v")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        # One row for each row that asks, with all it has found here: fewer rows to shuffle and to sort.
        kind = pa.list_(pa.struct([("d2", pa.float64()), ("b", pa.int64())]))
        if not len(x) or not len(y):
            return pa.table([pa.nulls(0, t) for t in (pa.int64(), pa.int64(), kind)], ["grp", "a", "near"])
        y = y.sort_by("id")
        names, there = (t.column("id").to_numpy() for t in (x, y))
        p, q = (t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t in (x, y))
        first = _first_copies(q, k + 1)
        q, there = q[first], there[first]
        limit = x.column("most").to_numpy() if bounded else None
        ends, b, d2 = [], [], []
        for i in range(0, len(p), 256):
            r, c, d = _closest(p[i : i + 256], q, names[i : i + 256], there, k, limit[i : i + 256] if bounded else None)
            ends.append(np.bincount(r, minlength=len(p[i : i + 256])))
            b.append(there[c])
            d2.append(d)
        ends, b, d2 = (np.concatenate(c) for c in (ends, b, d2))
        near = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ends)), pa.int32()), pa.StructArray.from_arrays([pa.array(d2), pa.array(b)], ["d2", "b"]))
        out = pa.table([pa.array(np.full(len(x), x.column("grp")[0].as_py())), pa.array(names), near.cast(kind)], ["grp", "a", "near"])
        return out.filter(pa.array(ends > 0)) if bounded else out

    tile = [*at, "q", "d"]
    left, right = left.toDF(*tile, *left.columns[4:]), right.toDF(*tile, "id", "v")  # columns of their own
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(run, "grp long, a long, near array<struct<d2 double, b long>>")


# ---------------------------------------------------------------- communities


def packed(edges: DataFrame, once: bool = False) -> DataFrame:
    """grp, nodes (ascending), and a, b, w of its edges by place of their ends: a row for each group (staged). w is null where all edges weigh 1.

    edges: grp, lo, hi, w. With ``once`` equal edges are one.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        lo, hi, w = (t.column(c).to_numpy() for c in ("lo", "hi", "w"))
        nodes, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
        a, b = at[: len(w)], at[len(w) :]
        order = np.unique(a * len(nodes) + b, return_index=True)[1] if once else np.lexsort((b, a))
        lists = [nodes, a[order].astype(np.int32), b[order].astype(np.int32), None if (w == 1).all() else w[order]]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64())
        return pa.table([pa.array([key[0].as_py()]), *[pa.array([x], pa.list_(k)) for x, k in zip(lists, kinds, strict=True)]], ["grp", "nodes", "a", "b", "w"])

    rows = edges.select("grp", "lo", "hi", F.col("w").cast("double").alias("w"))
    # Dealt by number: adaptive execution would put several groups into one task, and so into one file.
    rows = rows.repartition(min(MOST_TASKS, 4 * edges.select("grp").distinct().count() or 1), "grp")
    return staged(rows.groupBy("grp").applyInArrow(run, "grp long, nodes array<long>, a array<int>, b array<int>, w array<double>"), "graphs")


def runs(edges: DataFrame, resolutions: Iterable[float] = RESOLUTIONS, repeats: int = REPEATS) -> DataFrame:
    """grp, resolution, repeat, labels (of the group's nodes in ascending order), modularity of each search (staged). edges: grp, lo, hi, w, or what :func:`packed` made of them.

    Every search reads its group's graph from the shared folder: a shuffle would write it once for each of them.
    """
    graphs = edges if "nodes" in edges.columns else packed(edges)
    graphs = graphs.select("grp", "a", "b", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grp, resolution, repeat = (batch.column(c)[i].as_py() for c in ("grp", "resolution", "repeat"))
                a, b, w = (batch.column(c)[i].values for c in "abw")
                a, b = (x.to_numpy().astype(np.int64) for x in (a, b))
                w = np.ones(len(a)) if w is None else w.to_numpy()
                label = communities(int(max(a.max(), b.max())) + 1 if len(a) else 0, a, b, resolution, repeat, w)
                columns = [pa.array([grp]), pa.array([resolution]), pa.array([repeat], pa.int32()), pa.array([label.astype(np.int32)], pa.list_(pa.int32())), pa.array([weighted_modularity(a, b, w, label)])]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "resolution", "repeat", "labels", "modularity"])

    each = [graphs.withColumns({"resolution": F.lit(float(r)), "repeat": F.lit(s)}) for r in resolutions for s in range(repeats)]
    return staged(functools.reduce(DataFrame.unionAll, each).mapInArrow(run, "grp long, resolution double, repeat int, labels array<int>, modularity double"), "communities")


def weighted_modularity(a: np.ndarray, b: np.ndarray, w: np.ndarray, label: np.ndarray) -> float:
    total = w.sum()
    if not total:
        return 0.0
    n = label.max() + 1
    degree = np.bincount(label[a], w, n) + np.bincount(label[b], w, n)
    return float(w[label[a] == label[b]].sum() / total - ((degree / (2 * total)) ** 2).sum())


def agreement(found: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """grp, resolution, stability: mean normalised mutual information of all pairs of ``repeats``. found: those of :func:`runs`."""
    at = ["grp", "resolution"]
    pair = [*at, "i", "j"]
    # A node's labels side by side: its pairs of repeats need no join.
    names = [f"l{s}" for s in range(repeats)]
    wide = found.groupBy(*at).agg(*[F.first(F.when(F.col("repeat") == s, F.col("labels")), ignorenulls=True).alias(n) for s, n in enumerate(names)]).select(*at, F.inline(F.arrays_zip(*names)))
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"l{i}").alias("u"), F.col(f"l{j}").alias("v")) for j in range(repeats) for i in range(j)]
    both = wide.select(*at, F.inline(F.array(*pairs))) if pairs else wide.select(*at, *[F.lit(0).alias(c) for c in "ijuv"]).where("false")
    cell = staged(both.groupBy(*pair, "u", "v").agg(F.count(F.lit(1)).alias("n")), "contingency")
    of = lambda c: cell.groupBy(*pair, c).agg(F.sum("n").alias(f"n{c}"))
    whole = cell.groupBy(*pair).agg(F.sum("n").alias("all"))
    mutual = cell.join(of("u"), [*pair, "u"]).join(of("v"), [*pair, "v"]).join(whole, pair)
    mutual = mutual.groupBy(*pair).agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nu") * F.col("nv")))).alias("mi"))
    entropy = lambda c: of(c).join(whole, pair).groupBy(*pair).agg((-F.sum(F.col(f"n{c}") / F.col("all") * F.ln(F.col(f"n{c}") / F.col("all")))).alias(f"h{c}"))
    joined = mutual.join(entropy("u"), pair).join(entropy("v"), pair)
    h = (F.col("hu") + F.col("hv")) / 2
    return joined.groupBy(*at).agg(F.avg(F.when(h > 0, F.col("mi") / h).otherwise(0.0)).alias("stability"))


def sweep(edges: DataFrame, resolutions: Iterable[float] = RESOLUTIONS, repeats: int = REPEATS) -> DataFrame:
    """grp, resolution, node, niche_id, stability, modularity, min_frac of the best repeat of each resolution. edges: as for :func:`runs`."""
    graphs = edges if "nodes" in edges.columns else packed(edges)
    found = runs(graphs, resolutions, repeats)
    at = ["grp", "resolution"]
    best = found.groupBy(*at).agg(F.max(F.struct("modularity", -F.col("repeat"))).alias("x")).select(*at, (-F.col("x.col2")).alias("repeat"))
    own = found.join(F.broadcast(best), [*at, "repeat"])
    sizes = own.select(*at, F.explode("labels").alias("label")).groupBy(*at, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*at).agg((F.min("n") / F.sum("n")).alias("min_frac"))
    scores = best.join(sizes, at).join(agreement(found, repeats), at, "left")
    # Labels meet their nodes as arrays: no node is shuffled by itself.
    scored = own.join(F.broadcast(scores), [*at, "repeat"]).join(graphs.select("grp", "nodes"), "grp")
    scored = scored.select(*at, F.coalesce("stability", F.lit(1.0)).alias("stability"), "modularity", "min_frac", F.inline(F.arrays_zip(F.col("nodes").alias("node"), F.col("labels").alias("niche_id"))))
    return scored.select(*at, "node", "niche_id", "stability", "modularity", "min_frac")


def reduced(edges: DataFrame, parts: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges (lo, hi, w) between the fine communities found within each part, loops included, and node, home (its community). parts: node, part.

    Communities are named by their smallest node.
    """
    of = lambda end: parts.select(F.col("node").alias(end), F.col("part").alias(f"{end}_part"))
    placed = staged(edges.join(of("lo"), "lo").join(of("hi"), "hi"), "placed-edges")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lo", "hi"], kind="stable")
        nodes, at = np.unique(np.concatenate([pdf["lo"], pdf["hi"]]), return_inverse=True)
        label = communities(len(nodes), at[: len(pdf)], at[len(pdf) :], FINER, seed, pdf["w"].to_numpy(float))
        first = pd.Series(nodes).groupby(label).min()
        return pd.DataFrame({"node": nodes, "home": first.loc[label].to_numpy()})

    inside = placed.where("lo_part = hi_part").groupBy("lo_part").applyInPandas(run, "node long, home long")
    homes = staged(parts.select("node").join(inside, "node", "left").select("node", F.coalesce("home", "node").alias("home")), "homes")
    name = lambda end, to: homes.select(F.col("node").alias(end), F.col("home").alias(to))
    moved = placed.join(name("lo", "x"), "lo").join(name("hi", "y"), "hi").groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.sum("w").alias("w"))
    out = staged(moved, "quotient-edges")
    discard(placed)
    return out, homes


def polished(edges: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """labels (resolution, node, niche_id; staged) after moves of nodes to the community among their neighbours' that gains most modularity.

    A round moves the nodes of one half, by hash, all at once, so that neighbours seldom trade places. edges: lo, hi, w.
    """
    both = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"), "w").union(edges.select("hi", "lo", "w")).where("node <> other")
    degree = staged(both.groupBy("node").agg(F.sum("w").alias("k")), "degree")
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    now = staged(labels.select("resolution", "node", "niche_id"), "polish")
    for r in range(rounds):
        known = now.join(degree, "node")
        mass = known.groupBy("resolution", "niche_id").agg(F.sum("k").alias("mass"))
        near = both.join(now.withColumnRenamed("node", "other"), "other").groupBy("resolution", "node", "niche_id").agg(F.sum("w").alias("w"))
        asked = near.unionByName(now.withColumn("w", F.lit(0.0))).groupBy("resolution", "node", "niche_id").agg(F.sum("w").alias("w"))
        asked = asked.join(known.withColumnRenamed("niche_id", "own"), ["resolution", "node"]).join(mass, ["resolution", "niche_id"])
        is_own = F.col("niche_id") == F.col("own")
        gain = F.col("w") - F.col("resolution") * F.col("k") * (F.col("mass") - F.when(is_own, F.col("k")).otherwise(0.0)) / F.lit(total)
        moving = F.pmod(F.xxhash64("node") + r, F.lit(2)) == 0
        best = asked.groupBy("resolution", "node").agg(F.max(F.struct(F.when(moving | is_own, gain).otherwise(F.lit(float("-inf"))).alias("gain"), is_own.alias("own"), (-F.col("niche_id")).alias("label"))).alias("x"))
        moved = best.select("resolution", "node", (-F.col("x.label")).alias("to"))
        now, before = staged(now.join(moved, ["resolution", "node"], "left").select("resolution", "node", F.coalesce("to", "niche_id").alias("niche_id")), "polish"), now
        discard(before)
    discard(degree)
    return now


def estimated(rows: DataFrame, scope: str = "cohort", k: int = 15, exact_below: int = EXACT_BELOW, most_edges: int = MOST_EDGES, resolutions: Iterable[float] = RESOLUTIONS, repeats: int = REPEATS) -> DataFrame:
    """sample_id, cell_id, niche_id of the best setting: one for the cohort, or one for each sample with ``scope`` sample. rows: features.

    The best has a smallest community of 0.5 % or more if any has, then the highest stability, modularity and silhouette.
    """
    keyed = staged(rows.select(*KEY, "features", F.xxhash64(*KEY).alias("vec_id"), (F.lit(0) if scope == "cohort" else F.col("sample_id")).cast("long").alias("grp")), "keyed")
    near, placed = nearest(keyed, k, "grp", exact_below=exact_below)
    edges, whole, homes = near.select("grp", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.lit(1.0).alias("w")), None, None
    if scope == "cohort":
        whole = edges = staged(edges.distinct(), "edges")
        if whole.count() > most_edges:
            small, homes = reduced(edges.select("lo", "hi", "w"), placed.select(F.col("id").alias("node"), F.element_at("lists", 1).alias("part")))
            if small.count() > most_edges:
                raise ValueError("the graph is too large after one reduction; cluster by sample or use k-means")
            edges = small.withColumn("grp", F.lit(0).cast("long"))
    # Two rows that are near each other give the same edge twice.
    edges = packed(edges, once=whole is None)
    swept = staged(sweep(edges, resolutions, repeats), "sweep")
    if homes is not None:
        kept = [c for c in swept.columns if c not in ("node", "niche_id")]
        spread = swept.withColumnRenamed("node", "home").join(homes, "home")
        moved = polished(whole.select("lo", "hi", "w"), spread)
        swept = moved.join(swept.select(*kept).distinct(), "resolution").select("node", "niche_id", *kept)
    at = ["grp", "resolution"]
    settings = swept.select(*at, "stability", "modularity", "min_frac").distinct()
    order = [(F.col("min_frac") >= 0.005).desc(), F.desc("stability"), F.desc("modularity")]
    ahead = settings.withColumn("r", F.rank().over(Window.partitionBy("grp").orderBy(*order))).where("r = 1")
    ahead = staged(ahead.select(*at, F.count(F.lit(1)).over(Window.partitionBy("grp")).alias("n")), "settings")
    named = swept.join(F.broadcast(ahead), at).withColumnRenamed("node", "vec_id").join(keyed.select("vec_id", *KEY, "features"), "vec_id")
    # Silhouettes only tell apart settings that are even in all else.
    if ahead.where("n > 1").isEmpty():
        return named.select(*KEY, "niche_id")
    named = staged(named, "named")
    scores = ahead.join(silhouettes(named.where("n > 1"), at), at, "left")
    best = scores.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc_nulls_last("silhouette"), "resolution"))).where("r = 1").select(*at)
    return named.join(best, at).select(*KEY, "niche_id")


def silhouettes(named: DataFrame, at: list[str]) -> DataFrame:
    """``at`` and silhouette (squared Euclidean distances) of all cells of each setting, by sums over its niches; null with one niche.

    named: ``at``, vec_id, features, niche_id. The mean squared distance of a cell to a niche follows from the niche's mean and mean square.
    """
    flat = named.select(*at, "niche_id", F.posexplode("features").alias("pos", "x"))
    niche = [*at, "niche_id"]
    sums = flat.groupBy(*niche, "pos").agg(F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    sums = sums.groupBy(*niche).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("mean"), F.sum("s2").alias("s2"))
    sums = sums.join(named.groupBy(*niche).agg(F.count(F.lit(1)).alias("n")), niche)
    # Cells of a setting are dealt into blocks, and its niches go to each: a task holds one block and the niches.
    blocks = named.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / CELLS).cast("int").alias("blocks"))
    cells = named.join(F.broadcast(blocks), at).select(*at, F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "niche_id", "features")
    niches = sums.join(F.broadcast(blocks), at).select(*at, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "niche_id", "mean", (F.col("s2") / F.col("n")).alias("square"), "n")

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        total = 0.0
        if len(x) and len(y) > 1:
            y = y.sort_values("niche_id")
            names, mean, square, n = y["niche_id"].to_numpy(), np.stack(y["mean"].to_numpy()), y["square"].to_numpy(), y["n"].to_numpy()
            v, own = np.stack(x["features"].to_numpy()), np.searchsorted(names, x["niche_id"].to_numpy())
            for i in range(0, len(v), 512):
                part, mine = v[i : i + 512], own[i : i + 512]
                d = (part * part).sum(1)[:, None] - 2 * part @ mean.T + square
                rows = np.arange(len(part))
                a = d[rows, mine] * n[mine] / np.maximum(n[mine] - 1, 1)
                d[rows, mine] = np.inf
                b = d.min(1)
                top = np.maximum(a, b)
                fits = (n[mine] > 1) & (top > 0)
                total += float(((b - a)[fits] / top[fits]).sum())
        return pd.DataFrame({**dict(zip(at, ([k] for k in key))), "s": [total], "m": [len(x) if len(y) > 1 else 0]})

    kinds = ", ".join(f"{c} {named.schema[c].dataType.simpleString()}" for c in at)
    dealt = cells.groupBy(*at, "block").cogroup(niches.toDF(*niches.columns).groupBy(*at, "block")).applyInPandas(run, f"{kinds}, s double, m long")
    return dealt.where("m > 0").groupBy(*at).agg((F.sum("s") / F.sum("m")).alias("silhouette"))
