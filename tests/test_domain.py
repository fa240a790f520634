"""Golden values, quirks and guards of the domain's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplan import cli
from cytoplan.functions import labels as L
from cytoplan.operators import aggregates, axes, cci, cluster, features, graph, hplot, profile
from cytoplan.plans.engine import Engine, HplotConfig
from cytoplan.sources import tables

EDGES = "sample_id long, src long, dst long, length double"


def path_graph(spark):
    return spark.createDataFrame([(1, 0, 1, 10.0), (1, 1, 2, 20.0), (1, 2, 3, 30.0)], EDGES)


def test_layers_of_a_path(spark):
    adj = graph.adjacency(path_graph(spark))
    region = spark.createDataFrame([(1, i, i < 2, i == 1) for i in range(4)] + [(1, 9, False, False)], "sample_id long, cell_id long, is_region boolean, is_border boolean")
    got = {r.cell_id: (r.hops, r.layer) for r in hplot.layers(region, adj).collect()}
    assert got == {0: (1, -1), 1: (0, 0), 2: (1, 1), 3: (2, 2), 9: (None, None)}


def test_curve_distances(spark):
    rows = [(1, 0, True, False, 0.0, -1), (1, 1, True, False, 0.0, 0), (1, 2, False, True, 1.0, 1), (1, 3, False, False, 0.0, 2)]
    layered = spark.createDataFrame(rows, "sample_id long, cell_id long, is_base boolean, is_target boolean, target_value double, layer int")
    got = {r.layer: r for r in hplot.curve(layered, path_graph(spark)).collect()}
    assert {k: r.distance_um for k, r in got.items()} == {-1: -10.0, 0: 0.0, 1: 20.0, 2: 50.0}
    assert got[1].target_type_prop == 1.0
    # A missing gap ends the curve.
    short = path_graph(spark).where("src <> 1")
    assert {r.layer for r in hplot.curve(layered, short).collect()} == {-1, 0}


def block(sample, side, spacing, x, y, kind, first=0):
    return [(sample, first + i * side + j, x + i * spacing + 0.01 * j, y + j * spacing + 0.013 * i, kind) for i in range(side) for j in range(side)]


def members_of(spark, rows):
    cells = spark.createDataFrame(rows, tables.CELLS)
    edges = graph.prune(graph.delaunay_edges(cells), 25.0)
    base = axes.by_celltype(cells, ["t_cell"])
    return aggregates.membership(cells, axes.flagged(cells, base, base), graph.adjacency(edges)), cells, edges


def test_two_blobs_are_two_aggregates(spark):
    got, cells, edges = members_of(spark, block(1, 6, 5, 0, 0, "T cell") + block(1, 6, 5, 500, 500, "t-cell", 100))
    sizes = {r.aggregate_id: r["count"] for r in got.where("aggregate_id is not null").groupBy("aggregate_id").count().collect()}
    assert sizes.keys() == {0, 1} and min(sizes.values()) >= 30  # a corner may see too few cells
    shapes = aggregates.features(cells, got).orderBy("aggregate_id").collect()
    assert [r.n_cells for r in shapes] == [sizes[0], sizes[1]] and all(500 < r.area_um2 < 650 for r in shapes)
    assert graph.quotient(edges, got).count() == 0


def test_small_and_scattered_groups_are_none(spark):
    got, *_ = members_of(spark, block(1, 3, 5, 0, 0, "t_cell"))
    assert got.where("aggregate_id is not null").count() == 0
    p = np.random.default_rng(0).random((120, 2)) * 1000
    got, *_ = members_of(spark, [(1, i, float(x), float(y), ("t_cell", "tumor")[i % 2]) for i, (x, y) in enumerate(p)])
    assert got.where("aggregate_id is not null").count() == 0


def test_quotient_of_known_ids(spark):
    members = spark.createDataFrame([(1, i, a) for i, a in enumerate([0, 0, 1, 1, None])], "sample_id long, cell_id long, aggregate_id int")
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (1, 2, 3, 1.0), (1, 1, 2, 1.0), (1, 3, 4, 1.0)], EDGES)
    assert [tuple(r) for r in graph.quotient(edges, members).collect()] == [(1, 0, 1, 1)]


def labels(spark, ids):
    return spark.createDataFrame([(1, i, n) for i, n in enumerate(ids)], "sample_id long, cell_id long, niche_id int")


def test_agreement(spark):
    same = profile.nmi(labels(spark, [0, 0, 1, 1, 2, 2]), labels(spark, [1, 1, 0, 0, 2, 2])).first()[0]
    assert abs(same - 1) < 1e-12
    rng = np.random.default_rng(0)
    assert profile.nmi(labels(spark, rng.integers(0, 3, 3000).tolist()), labels(spark, rng.integers(0, 3, 3000).tolist())).first()[0] < 0.05
    assert profile.nmi(labels(spark, [1, 1]), labels(spark, [0, 0])).first()[0] == 0
    sizes = {r.niche_id: r.n_cells for r in profile.sizes(labels(spark, [0, 0, 1, 1, 2, 0, None])).collect()}
    assert sizes == {0: 3, 1: 2, 2: 1}


def test_centering_makes_sample_means_equal_and_keeps_the_mean(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(5, 1, (40, 3)), rng.normal(-2, 1, (60, 3))])
    df = spark.createDataFrame([(int(i >= 40), i, v.tolist()) for i, v in enumerate(x)], "sample_id long, cell_id long, features array<double>")
    got = np.array([r.features for r in cluster.centred(df).orderBy("cell_id").collect()])
    assert np.allclose(got[:40].mean(0), got[40:].mean(0)) and np.allclose(got.mean(0), x.mean(0))


def test_khop_zero_is_the_cell_itself(spark):
    cells = spark.createDataFrame([(1, i, 0.0, 0.0, "x") for i in range(4)], tables.CELLS)
    adj = graph.adjacency(path_graph(spark))
    assert graph.khop(cells, adj, 0).count() == 4 and graph.khop(cells, adj, 1).count() == 10
    assert {(r.a, r.b): r.hop for r in graph.rings(cells, adj, 3).collect()}[0, 3] == 3
    rows = features.khop_composition(cells, adj, features.hard_probabilities(cells), ["x", "y"], 3).where("cell_id = 1 and hop = 3 and cell_type = 'y'").collect()
    assert rows[0].value == 0.5  # an empty ring


def test_interactions(spark):
    cells = spark.createDataFrame([(1, i, 0.0, 0.0, "x") for i in range(3)], tables.CELLS)
    adj = graph.adjacency(spark.createDataFrame([(1, 0, 1, 25.0)], EDGES))
    expr = spark.createDataFrame([(1, 0, "LIG", 2.0), (1, 1, "HLA-A", 3.0)], tables.EXPRESSION)
    pairs = tables.lr_pairs(spark.createDataFrame([(0, "LIG", "hla a"), (1, "lig", "HLA A"), (2, "LIG", "nan"), (3, " ", "X")], "row_no int, ligand_gene_symbol string, receptor_gene_symbol string"))
    got = {r.cell_id: r for r in cci.scores(cells, adj, expr, pairs).collect()}
    assert abs(got[0].out_sum - 6 * np.exp(-1)) < 1e-12 and got[0].out_mean == 6.0 and got[1].in_mean == 6.0
    assert got[2].out_sum == 0 and len(got) == 3
    with pytest.raises(ValueError):
        cci.weights(adj, "other")


def test_labels_and_guards(spark):
    df = spark.createDataFrame([(" T cell+ ",), ("T-cell",), ("__a__b",)], "x string")
    assert [r[0] for r in df.select(L.sanitise("x")).collect()] == ["t_cell", "t_cell", "a_b"]
    with pytest.raises(tables.ContractError):
        aggregates.check_name("niche_1", [])
    with pytest.raises(tables.ContractError):
        aggregates.check_name("tumor", ["tumor"])
    with pytest.raises(tables.ContractError):
        tables.require_unique(spark.createDataFrame([(1,), (1,)], "sample_id long"))
    with pytest.raises(tables.MissingKeyError, match="B, C"):
        tables.select_genes(spark.createDataFrame([(1, 1, "a", 1.0)], tables.EXPRESSION), ["A", "C", "B"])
    lines = spark.createDataFrame([("﻿/d/a.h5ad",), ("# x",), ("/d/b.zarr,two",), ("/d/c,c.h5ad\tthree",)], "value string")
    assert sorted(map(tuple, tables.parse_manifest(lines).collect())) == [("/d/a.h5ad", "a"), ("/d/b.zarr", "two"), ("/d/c,c.h5ad", "three")]


def test_communities_and_encoder():
    a, b = map(np.array, zip(*[(i, j) for g in range(3) for i in range(g * 6, g * 6 + 6) for j in range(g * 6, i)], strict=True))
    a, b = np.append(a, [0, 6]), np.append(b, [6, 12])
    found = cluster.communities(18, a, b, 1.0, 0)
    assert len(set(found)) == 3 and all(len(set(found[g * 6 : g * 6 + 6])) == 1 for g in range(3))
    assert cluster.nmi_of(found, found) == pytest.approx(1)
    x = np.random.default_rng(0).normal(size=(18, 5))
    w = cluster.train_encoder(x, np.append(a, b), np.append(b, a), epochs=20, min_epochs=5)
    assert [m.shape for m in w] == [(5, 64), (64, 32), (32, 32)] and all(np.isfinite(m).all() for m in w)


def test_engine_end_to_end(spark, tmp_path, capsys):
    rng = np.random.default_rng(3)
    rows = []
    for s in (1, 2):
        p = rng.random((150, 2)) * 120
        rows += [(s, i, float(x), float(y), "tumor" if (x - 60) ** 2 + (y - 60) ** 2 < 1200 else ("stroma", "lymphocyte")[i % 2]) for i, (x, y) in enumerate(p)]
    cells = spark.createDataFrame(rows, tables.CELLS)
    expr = cells.select("sample_id", "cell_id", F.explode(F.array(*[F.struct(F.lit(g).alias("gene"), (F.col("cell_id") % k).cast("double").alias("value")) for g, k in (("LIG", 3), ("REC", 4))]))).select("sample_id", "cell_id", "col.gene", "col.value")
    e = Engine(spark, f"file://{tmp_path}/r")
    with pytest.raises(tables.MissingKeyError):
        e.export()
    cfg = HplotConfig(base=["tumor"], target=["lymphocyte"])
    first = e.run(cells, cfg, expr).orderBy("sample_id", "layer").collect()
    assert {r.sample_id for r in first} == {1, 2} and any(r.layer > 0 for r in first)
    assert e.hplot(cfg).orderBy("sample_id", "layer").collect() == first  # resumes: nothing to do
    assert e.aggregates("nest", ["tumor"], min_size=5).count() >= 1
    assert e.aggregates("nest2", ["stroma"], min_size=5).count() >= 0 and e.read("aggregates").select("name").distinct().count() == 2
    pairs = tables.lr_pairs(spark.createDataFrame([("LIG", "REC")], "ligand string, receptor string"))
    assert e.cci(pairs).count() == 8
    assert e.hplot(HplotConfig(base=["tumor"], target=["out_mean"], target_by="cci"), overwrite=True).count() > 0
    assert e.niche(clusters=3, epochs=15, with_regions=True).count() == 300
    out = e.niche_profile(other="niche")
    assert out["agreement"].first()[0] == pytest.approx(1) and out["markers"].count() > 0
    assert e.verify().where("ok").count() == 2
    assert cli.main(["describe"]) == 0 and '"hplot"' in capsys.readouterr().out
    assert cli.main(["agg", "--root", str(tmp_path)]) == 2 and cli.listed("a, b  c") == ["a", "b", "c"]


def test_more_labels_and_tables(spark):
    boxes = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0)], "minx double, miny double, width double, height double")
    assert tuple(boxes.select(*L.cell_centre(boxes.columns)).first()) == (2.0, 4.0)
    with pytest.raises(ValueError):
        L.cell_centre(["x"])
    assert L.short_ids(["run_a_x_out", "run_b_out"]) == ["a_x", "b"] and L.short_ids(["one"]) == ["one"]
    df = spark.createDataFrame([("niche_10",), ("niche_9",)], "n string")
    assert [r[0] for r in df.orderBy(L.niche_number("n")).collect()] == ["niche_9", "niche_10"]
    rows = spark.createDataFrame([(" a ", "f"), ("", "g")], "file_id string, file_name string")
    assert [tuple(r) for r in tables.gdc_manifest(rows).collect()] == [("a", "f", None)]
    layers = spark.createDataFrame([(1, 1, "g", 1.0, "raw"), (1, 1, "g", 2.0, "X")], "sample_id long, cell_id long, gene string, value double, layer string")
    assert tables.select_layer(layers, "adata.raw").first().value == 1.0


def test_silhouette(spark):
    rows = spark.createDataFrame([(1, i, [float(i // 10 * 100 + i % 10)]) for i in range(20)], "sample_id long, cell_id long, features array<double>")
    assert cluster.silhouette(rows, labels(spark, [i // 10 for i in range(20)])) > 0.9


def test_jobs(spark):
    import threading

    from cytoplan.plans.jobs import JobManager

    jobs = JobManager(spark, slots=1)
    gate = threading.Event()
    first = jobs.submit("wait", lambda job: gate.wait(30))
    waiting = jobs.submit("count", lambda job: spark.range(10).count())
    jobs.cancel(waiting.id)
    gate.set()
    assert jobs.wait(first.id).status == "done" and jobs.wait(waiting.id).status == "cancelled" and waiting.began is None
    bad = jobs.submit("bad", lambda job: 1 / 0)
    assert jobs.wait(bad.id).status == "failed" and jobs.lines(bad.id)[1] == ["ZeroDivisionError: division by zero"]
    for i in range(4100):
        bad.say(str(i))
    assert jobs.lines(bad.id, 0, 1)[1] == ["100"]
