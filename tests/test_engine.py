"""Results that follow their samples, families and configurations; components, rings and training over all samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplan.operators import cci, cluster, features, graph
from cytoplan.operators.components import expression_components
from cytoplan.plans.engine import Engine, HplotConfig
from cytoplan.sources import stage, tables


def tissue(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in sizes.items():
        p = rng.random((n, 2)) * 90
        rows += [(s, i, float(x), float(y), "tumor" if (x - 45) ** 2 + (y - 45) ** 2 < 700 else ("stroma", "lymphocyte")[i % 2]) for i, (x, y) in enumerate(p)]
    return spark.createDataFrame(rows, tables.CELLS)


def expression_of(cells):
    parts = F.array(*[F.struct(F.lit(g).alias("gene"), (F.col("cell_id") * (i + 3) % (i + 5)).cast("double").alias("value")) for i, g in enumerate(("LIG", "REC", "G3", "G4"))])
    return cells.select("sample_id", "cell_id", F.inline(parts))


def test_a_smaller_sample_leaves_nothing_behind(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/r")
    cfg = HplotConfig(base=["tumor"], target=["lymphocyte"])
    cells = tissue(spark, {1: 60, 2: 60})
    e.run(cells, cfg)
    kept = e.edges().where("sample_id = 2").count()
    before = {r.sample_id for r in e.finalize(cfg).collect()}
    e.run(cells.where("sample_id = 1 and cell_id < 2"), cfg)
    assert before == {1, 2} and {r.sample_id for r in e.finalize(cfg).collect()} == {2}
    assert e.edges().where("sample_id = 1").count() == 0 and e.edges().where("sample_id = 2").count() == kept
    assert e.read("cells").where("sample_id = 1").count() == 2


def test_configurations_stand_side_by_side(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/r")
    one, two = HplotConfig(base=["tumor"], target=["lymphocyte"]), HplotConfig(base=["tumor"], target=["stroma"])
    a = e.run(tissue(spark, {1: 80}), one).orderBy("layer").collect()
    b = e.hplot(two).orderBy("layer").collect()
    assert a != b and e.finalize(one).orderBy("layer").collect() == a and e.finalize(two).orderBy("layer").collect() == b
    assert e.finalize().count() == len(a) + len(b)
    narrow = HplotConfig(base=["tumor"], target=["lymphocyte"], low=-1, high=1)
    assert narrow.key() == one.key() and {r.layer for r in e.hplot(narrow).collect()} == {-1, 0, 1}


def test_families_agree_or_differ(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/r")
    cells = tissue(spark, {1: 120, 2: 100})
    e.ingest(cells, expression_of(cells))
    assert e.niche("niche", clusters=3, epochs=8).count() == 220
    assert e.niche("gexniche", clusters=3, epochs=8, mode="both", components=2).count() == 220
    assert {r.family for r in e.read("niches").select("family").distinct().collect()} == {"niche", "gexniche"}
    out = e.niche_profile("niche", other="gexniche")
    assert 0 <= out["agreement"].first()[0] < 1 and out["crosstab"].count() > 0
    soft = features.hard_probabilities(cells).withColumn("p", F.lit(0.5))
    assert e.niche("hniche", clusters=2, epochs=4, probabilities=soft, scope="sample").count() == 220
    assert e.read("niches").count() == 660
    assert [(r.sample_id, r.gene) for r in e.missing_genes(["lig", "none"]).orderBy("sample_id").collect()] == [(1, "none"), (2, "none")]


def test_sweep_breaks_ties_by_silhouette(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/r")
    e.ingest(tissue(spark, {1: 70}))
    got = e.niche(epochs=3)
    assert got.where("niche_id is not null").select("niche_id").distinct().count() >= 1


def test_sparse_scores_and_summary_equal_dense_ones(spark):
    cells = tissue(spark, {1: 40, 2: 30})
    expr = expression_of(cells)
    adj = stage.staged(graph.adjacency(graph.delaunay_edges(cells)), "adj")
    pairs = tables.lr_pairs(spark.createDataFrame([("LIG", "REC"), ("G3", "G4"), ("LIG", "LIG")], "ligand string, receptor string"))
    dense, sparse = cci.scores(cells, adj, expr, pairs), cci.scores(cells, adj, expr, pairs, dense=False)
    zero = "out_mean = 0 and out_sum = 0 and in_mean = 0 and in_sum = 0"
    key = lambda df: sorted((r.sample_id, r.cell_id, r.ligand, r.receptor, round(r.out_sum, 9), round(r.in_mean, 9)) for r in df.collect())
    assert key(dense.where(f"not ({zero})")) == key(sparse) and dense.count() == 210
    key = lambda df: sorted((*r[:6], round(r["mean"], 9), round(r["frac_pos"], 9)) for r in df.select("sample_id", "ligand", "receptor", "direction", "aggregation", "n_cells", "mean", "frac_pos").collect())
    assert key(cci.summary(dense)) == key(cci.summary_of(sparse, cells, pairs))


@pytest.mark.parametrize("genes", [8, 90])
def test_components_equal_a_dense_decomposition(spark, genes):
    rng = np.random.default_rng(genes)
    x = np.maximum(rng.normal(size=(200, 5)) @ rng.normal(size=(5, genes)) * np.array([9, 7, 5, 3, 2, *[1] * 0])[:1] + rng.normal(size=(200, genes)) * 0.1, 0)
    cells = spark.createDataFrame([(1 + i // 120, i, 0.0, 0.0, "x") for i in range(200)], tables.CELLS)
    expr = spark.createDataFrame([(1 + i // 120, i, f"g{j:03}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v], tables.EXPRESSION)
    got = np.array([r.features for r in expression_components(cells, expr, 4, passes=12).orderBy("cell_id").collect()])
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    want = centred @ vt[:4].T
    assert got.shape == (200, 4) and np.allclose(np.abs(got), np.abs(want), atol=1e-3 * s[0])


def test_rings_and_hop_means_equal_brute_force(spark):
    cells = tissue(spark, {1: 50, 2: 25})
    edges = stage.staged(graph.prune(graph.delaunay_edges(cells), 20.0), "edges")
    adj = graph.adjacency(edges)
    near = {}
    for r in adj.collect():
        near.setdefault((r.sample_id, r.a), set()).add(r.b)
    want = {}
    for r in cells.collect():
        seen, front = {r.cell_id: 0}, {r.cell_id}
        for hop in range(1, 5):
            front = {b for a in front for b in near.get((r.sample_id, a), ())} - seen.keys()
            seen |= dict.fromkeys(front, hop)
        want |= {(r.sample_id, r.cell_id, b): h for b, h in seen.items()}
    assert {(r.sample_id, r.a, r.b): r.hop for r in graph.rings(cells, adj, 4).collect()} == want
    rows = cells.select("sample_id", "cell_id", F.array(F.col("x_um"), F.lit(1.0)).alias("features"))
    x = {(r.sample_id, r.cell_id): r.x_um for r in cells.collect()}
    for r in features.khop_means(cells, adj, rows, 2).collect():
        for hop in range(3):
            own = [x[r.sample_id, b] for (s, a, b), h in want.items() if (s, a) == (r.sample_id, r.cell_id) and h == hop]
            assert np.allclose(r.features[2 * hop : 2 * hop + 2], [np.mean(own), 1.0] if own else [0, 0])


def test_every_sample_trains_the_encoder(spark):
    cells = tissue(spark, {s: 30 for s in range(8)})
    adj = graph.adjacency(stage.staged(graph.delaunay_edges(cells), "edges"))
    rows = features.vectors(features.khop_composition(cells, adj, features.hard_probabilities(cells), ["lymphocyte", "stroma", "tumor"], 1), "cell_type")
    whole = cluster.fit_encoder(rows, adj, epochs=6, min_epochs=2)
    assert whole.steps == 8 * 6
    split = cluster.fit_encoder(rows, adj, epochs=6, patience=3, min_epochs=2, group_cells=80)
    assert np.isfinite(split.flat()).all() and split.steps >= 6
    # A sample that changes changes the weights, whichever group it is in.
    for s in range(8):
        other = rows.withColumn("features", F.when(F.col("sample_id") == s, F.transform("features", lambda v: v * 2)).otherwise(F.col("features")))
        if s in (0, 5):
            assert not np.allclose(cluster.fit_encoder(other, adj, epochs=2, patience=2, min_epochs=1, group_cells=80).flat(), cluster.fit_encoder(rows, adj, epochs=2, patience=2, min_epochs=1, group_cells=80).flat())


def test_encoder_gradient_is_that_of_its_loss():
    rng = np.random.default_rng(0)
    x, a, b = rng.normal(size=(9, 4)), np.array([0, 1, 2, 3, 4, 5]), np.array([1, 2, 3, 4, 5, 6])
    a, b = np.append(a, b), np.append(b, a)
    conv = cluster._normalised(9, a, b)
    w = cluster.Encoder(4, 6, 3, dropout=0.0, decay=0.0).w

    def loss(w):
        e = cluster.Encoder(4, 6, 3, dropout=0.0, decay=0.0)
        e.w = [p.copy() for p in w]
        value = e.step(x, conv(x), conv, np.random.default_rng(1))
        return value, [m / 0.1 for m in e.m]

    _, grad = loss(w)
    for k, at in ((0, (1, 2)), (1, (3, 1)), (2, (0, 2))):
        up, down = [p.copy() for p in w], [p.copy() for p in w]
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up)[0] - loss(down)[0]) / 2e-5 - grad[k][at]) < 1e-5


def test_no_machine_local_folder_off_local_masters(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        stage.folder(Fake(), "x")
