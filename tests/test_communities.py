"""Neighbour lists against all distances, sweeps in many tasks, reduced graphs, niches by sample, kept embeddings."""

import numpy as np
import pytest

from cytoplan.operators import cluster, communities
from cytoplan.plans.engine import Engine
from cytoplan.sources import tables
from cytoplan.sources.stage import staged

SF = "/root/testdata/sf0.01"


def frame(spark, v, grp=None):
    rows = [(i, int(0 if grp is None else grp[i]), [float(x) for x in row]) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, "vec_id long, sample_id long, features array<double>").repartition(3)


def near(v, k, grp=None):
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    if grp is not None:
        d[grp[:, None] != grp[None]] = np.inf
    return {i: set(np.argsort(row, kind="stable")[: min(k, int(np.isfinite(row).sum()))].tolist()) for i, row in enumerate(d)}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.a, set()).add(r.b)
    return out


def test_groups_are_searched_exactly_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v, grp = rng.random((400, 5)), rng.integers(0, 3, 400)
    for block in (communities.BLOCK, 30):
        monkeypatch.setattr(communities, "BLOCK", block)
        assert found(communities.nearest(frame(spark, v, grp), 7, "sample_id")[0]) == near(v, 7, grp)


def test_lists_find_nearly_all_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>) AS features").orderBy("vec_id")
    v = np.array([r.features for r in rows.collect()])
    want = near(v, 15)
    got = found(communities.nearest(rows, exact_below=0, size=64)[0])
    recall = sum(len(got.get(i, set()) & want[i]) for i in want) / sum(map(len, want.values()))
    print("recall", recall)
    assert recall >= 0.95 and all(len(x) == 15 for x in got.values())
    one = {(r.a, r.b): r.d2 for r in communities.nearest(rows, exact_below=0, size=64)[0].collect()}
    assert all(abs(d - ((v[a] - v[b]) ** 2).sum()) < 1e-9 for (a, b), d in list(one.items())[:500])


def test_equal_distances_go_by_id_whatever_the_partitions(spark):
    rng = np.random.default_rng(9)
    v, grp = rng.integers(0, 4, (900, 3)) / 3.0 + 0.1, rng.integers(0, 2, 900)  # 64 vectors: copies, and other ties
    rows = frame(spark, v, grp)
    exact = ((v[:, None] - v[None]) ** 2).sum(2)
    exact[grp[:, None] != grp[None]] = np.inf
    np.fill_diagonal(exact, np.inf)
    want = {(i, int(j)) for i, d in enumerate(exact) for j in np.lexsort((np.arange(900), d))[:7]}
    before, lists = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("4", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert {(r.a, r.b) for r in communities.nearest(rows, 7, "sample_id")[0].collect()} == want
            lists.append({(r.a, r.b, r["rank"], r.d2) for r in communities.nearest(rows, 7, "sample_id", exact_below=0, probes=3, size=64)[0].collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert lists[0] == lists[1] and len(lists[0]) == 7 * 900


def test_other_lists_send_only_what_is_nearer_than_the_own_list(spark, monkeypatch):
    rng = np.random.default_rng(10)
    v = np.repeat(rng.random((12, 3)) * 9, 50, 0) + rng.normal(0, 0.01, (600, 3))
    sent, plain = [], communities._found

    def spy(*a):
        out = staged(plain(*a), "found")
        sent.append(out.selectExpr("sum(size(near))").first()[0])
        return out

    monkeypatch.setattr(communities, "_found", spy)
    got = found(communities.nearest(frame(spark, v), 7, exact_below=0, size=50)[0])
    want = near(v, 7)
    assert sum(len(got[i] & want[i]) for i in want) > 0.97 * 7 * 600
    assert sent[0] <= 7 * 600 and sent[1] <= 7 * 600  # before, 8 * 7 * 600 altogether


def planted(rng, groups, size, inside=6, across=0.4):
    n = groups * size
    label = np.arange(n) // size
    edges = set()
    for i in range(n):
        for j in rng.choice(np.flatnonzero(label == label[i]), inside).tolist() + rng.choice(n, rng.poisson(across)).tolist():
            if i != j:
                edges.add((min(i, j), max(i, j)))
    return label, sorted(edges)


def test_sweep_equals_the_search_in_one_task(spark):
    label, edges = planted(np.random.default_rng(3), 5, 40)
    df = spark.createDataFrame([(0, a, b, 1.0) for a, b in edges], "grp long, lo long, hi long, w double")
    rows = communities.sweep(df, (0.5, 1.0), 3).collect()
    a, b = np.array(edges).T
    for r in (0.5, 1.0):
        own = sorted((x for x in rows if x.resolution == r), key=lambda x: x.node)
        labels = [cluster.communities(200, a, b, r, s) for s in range(3)]
        scores = [cluster.modularity(a, b, x) for x in labels]
        assert [x.niche_id for x in own] == labels[int(np.argmax(scores))].tolist() and abs(own[0].modularity - max(scores)) < 1e-12
        assert abs(own[0].stability - np.mean([cluster.nmi_of(labels[i], labels[j]) for i in range(3) for j in range(i)])) < 1e-12
        assert own[0].min_frac == np.bincount(labels[int(np.argmax(scores))]).min() / 200
    best = {x.node: x.niche_id for x in rows if x.resolution == 1.0}
    assert cluster.nmi_of(np.array([best[i] for i in range(200)]), label) > 0.95


def test_a_reduced_graph_keeps_the_modularity(spark):
    rng = np.random.default_rng(4)
    label, edges = planted(rng, 6, 60, across=0.8)
    a, b = np.array(edges).T
    df = spark.createDataFrame([(x, y, 1.0) for x, y in edges], "lo long, hi long, w double")
    # Parts that mostly follow the groups, as lists about centres do, but split them and stray.
    part = np.where(rng.random(360) < 0.1, rng.integers(0, 12, 360), label * 2 + rng.integers(0, 2, 360))
    small, homes = communities.reduced(df, spark.createDataFrame([(i, int(p)) for i, p in enumerate(part)], "node long, part int"))
    assert abs(small.agg({"w": "sum"}).first()[0] - len(edges)) < 1e-9 and small.count() < 0.6 * len(edges)
    swept = communities.sweep(small.selectExpr("0L AS grp", "lo", "hi", "w"), (1.0,), 3).withColumnRenamed("node", "home").join(homes, "home")
    whole = max(cluster.modularity(a, b, cluster.communities(360, a, b, 1.0, s)) for s in range(3))
    rough, fine = ({r.node: r.niche_id for r in x.collect()} for x in (swept, communities.polished(df, swept)))
    score = [cluster.modularity(a, b, np.array([x[i] for i in range(360)])) for x in (rough, fine)]
    assert score[1] > 0.98 * whole and score[1] >= score[0]


def blobs(samples, size=90):
    rng = np.random.default_rng(5)
    return [(s, i, [float(x) for x in np.eye(3)[i % kinds] * 6 + rng.normal(0, 0.3, 3)]) for s, kinds in samples.items() for i in range(size)]


def test_every_sample_has_its_own_number_of_niches(spark, monkeypatch):
    rows = spark.createDataFrame(blobs({1: 2, 2: 3, 3: 1}), "sample_id long, cell_id long, features array<double>").repartition(4)
    got = communities.estimated(rows, "sample", resolutions=(0.05, 0.1), repeats=2).collect()
    assert len(got) == 270
    for s, kinds in ((1, 2), (2, 3)):
        own = {r.cell_id: r.niche_id for r in got if r.sample_id == s}
        assert cluster.nmi_of(np.array([own[i] for i in range(90)]), np.arange(90) % kinds) > 0.99
    # The whole cohort by a reduced graph finds the three kinds as well.
    whole = communities.estimated(rows, "cohort", resolutions=(0.05, 0.1), repeats=2, most_edges=1500, exact_below=50).collect()
    assert cluster.nmi_of(np.array([r.niche_id for r in whole]), np.array([r.cell_id % {1: 2, 2: 3, 3: 1}[r.sample_id] for r in whole])) > 0.9


def test_silhouettes_by_sums_equal_all_distances(spark):
    rng = np.random.default_rng(6)
    z, label = rng.random((60, 4)), rng.integers(0, 3, 60)
    rows = spark.createDataFrame([(0, 1.0, i, [float(x) for x in v], int(n)) for i, (v, n) in enumerate(zip(z, label))], "grp long, resolution double, vec_id long, features array<double>, niche_id int")
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    score = []
    for i in range(60):
        a = d[i, label == label[i]].sum() / ((label == label[i]).sum() - 1)
        b = min(d[i, label == k].mean() for k in range(3) if k != label[i])
        score.append((b - a) / max(a, b))
    assert abs(communities.silhouettes(rows, ["grp", "resolution"]).first()["silhouette"] - np.mean(score)) < 1e-9


def test_silhouettes_are_computed_for_even_settings_alone_and_in_blocks(spark, monkeypatch):
    asked, plain = [], communities.silhouettes

    def spy(named, at):
        asked.append(named.select(*at).distinct().count())
        return plain(named, at)

    monkeypatch.setattr(communities, "silhouettes", spy)
    schema = "sample_id long, cell_id long, features array<double>"
    z = np.random.default_rng(8).random((120, 3))
    uneven = spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(z)], schema)
    assert communities.estimated(uneven, "sample", resolutions=(0.5, 4.0), repeats=2).count() == 120 and asked == []
    even = spark.createDataFrame(blobs({1: 3}), schema)
    assert communities.estimated(even, "sample", resolutions=(0.05, 0.06), repeats=2).count() == 90 and asked == [2]
    rows = [(g, 1.0, i, [float(x) for x in v], i % (g + 2)) for g in (0, 1) for i, v in enumerate(z)] + [(2, 1.0, 0, [0.0] * 3, 0)]
    named = spark.createDataFrame(rows, "grp long, resolution double, vec_id long, features array<double>, niche_id int")
    scores = []
    for cells in (communities.CELLS, 7):
        monkeypatch.setattr(communities, "CELLS", cells)
        scores.append({r.grp: r.silhouette for r in plain(named, ["grp", "resolution"]).collect()})
    assert scores[0].keys() == {0, 1} and all(abs(scores[0][g] - scores[1][g]) < 1e-12 for g in (0, 1))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("niches")))
    rng = np.random.default_rng(7)
    cells = [(s, i, float(i % 12) * 9 + rng.random(), i // 12 * 9 + rng.random(), ["Tumor", "stroma", "lymphocyte"][int(i % 12 > 5) + int(rng.random() < 0.2)]) for s in (1, 2) for i in range(120)]
    e.ingest(spark.createDataFrame(cells, tables.CELLS))
    return e


def test_embeddings_are_kept_by_inputs_and_settings(spark, engine, monkeypatch):
    trained, plain = [], cluster.encode
    monkeypatch.setattr(cluster, "encode", lambda *a, **k: trained.append(1) or plain(*a, **k))
    engine.niche(clusters=2, epochs=4)
    engine.niche(clusters=3, epochs=4)
    engine.niche(clusters=3, epochs=4, batch_correct="center", family="other")
    assert len(trained) == 1 and engine.read("niches").where("family = 'niche'").agg({"niche_id": "max"}).first()[0] == 2
    engine.niche(clusters=3, epochs=5)
    assert len(trained) == 2
    moved = staged(engine.read("cells"), "cells").selectExpr("sample_id", "cell_id", "x_um + if(sample_id = 2 and cell_id = 5, 0.5, 0) AS x_um", "y_um", "cell_type")
    engine.ingest(moved)
    engine.niche(clusters=3, epochs=4)
    assert len(trained) == 3


def test_niches_by_sample_without_a_number_and_corrected(engine):
    rows = engine.niche(epochs=3, scope="sample").collect()
    assert len(rows) == 240 and {r.sample_id for r in rows if r.niche_id is not None} == {1, 2}
    assert engine.niche(clusters=2, epochs=3, batch_correct="harmony").count() == 240


def test_names_that_no_cell_has_are_an_error(engine):
    from cytoplan.plans.engine import HplotConfig

    with pytest.raises(tables.MissingKeyError, match="cell types"):
        engine.hplot(HplotConfig(base=["nothing"], target=["tumor"]))
    engine.niche(clusters=2, epochs=3)
    with pytest.raises(tables.MissingKeyError, match="niches"):
        engine.hplot(HplotConfig(base=["tumor"], target=["niche_77"], target_by="niche"))


def test_the_last_scores_are_those_run_last_and_nothing_staged_stays(spark, engine):
    from cytoplan.sources import stage

    cells = stage.staged(engine.read("cells"), "cells")
    expression = cells.selectExpr("sample_id", "cell_id", "inline(array(struct('LIG' AS gene, cast(cell_id % 3 AS double) AS value), struct('REC' AS gene, cast(cell_id % 2 AS double) AS value)))")
    engine.ingest(cells, expression)
    pairs = spark.createDataFrame([("LIG", "REC")], "ligand string, receptor string")
    for scale in (10.0, 25.0, 10.0):
        engine.cci(pairs, scale=scale)
        rows = engine._cci().groupBy().sum("out_sum").first()[0]
        want = engine._done("cci", config=engine.spark.read.parquet(engine.path("cci_runs")).orderBy("run", ascending=False).first()["config"]).groupBy().sum("out_sum").first()[0]
        assert rows == want
    live = len(stage._live)
    engine.niche(clusters=2, epochs=3, with_regions=True)
    assert len(stage._live) == live and engine.read("niche_outlines").count() > 0


def test_commands_with_soft_types_top_types_and_more_to_verify(spark, engine, tmp_path, monkeypatch, capsys):
    import json

    from cytoplan import cli

    monkeypatch.setattr(cli.SparkSession, "builder", type("B", (), {"appName": lambda s, _: s, "getOrCreate": lambda s: spark})())
    assert cli.main(["describe"]) == 0
    assert {"soft", "top_types", "verbose"} <= {o["name"] for o in json.loads(capsys.readouterr().out)["options"]}
    soft = engine.read("cells").selectExpr("sample_id", "cell_id", "inline(array(struct('tumor' AS cell_type, 0.25D AS p), struct('stroma' AS cell_type, 0.75D AS p)))")
    soft.write.parquet(str(tmp_path / "soft"))
    assert cli.main(["niche", "--root", engine.root, "--clusters", "2", "--epochs", "3", "--soft", str(tmp_path / "soft")]) == 0
    top = engine.niche_profile(top_types=1)["top_types"].collect()
    assert len(top) == engine.niche_profile()["sizes"].count() and {r["rank"] for r in top} == {1}
    assert cli.main(["verify", "--root", engine.root, "-vv"]) == 0
    assert "n_types" in (out := capsys.readouterr().out) and "cell_type" in out
