"""Searches and components of large samples by joins equal those of one task a sample."""

import numpy as np
import pytest

from cytoplan.operators import graph


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(3)
    edges = set()
    for s, n in ((1, 300), (2, 60), (3, 40)):
        for _ in range(int(n * 0.9)):
            a = int(rng.integers(n))
            b = int(min(n - 1, a + rng.integers(1, 6)))
            if a != b:
                edges.add((s, a, b, 1.0))
    cells = [(s, i, bool(i % 41 == 0)) for s, n in ((1, 300), (2, 60), (3, 40)) for i in range(n)] + [(4, 0, None), (5, 7, True)]
    cells = spark.createDataFrame(cells, "sample_id long, cell_id long, src boolean").repartition(3)
    return cells, graph.adjacency(spark.createDataFrame(sorted(edges), graph.EDGES))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_hops(field):
    cells, adj = field
    whole = rows(graph.hops_to(cells, adj, "src"))
    assert len(whole) == 402 and sum(r[2] is None for r in whole) > 5 and max(r[2] or 0 for r in whole) > 3
    for limit in (0, 50, 100):  # all samples by levels, two, one
        assert rows(graph.hops_to(cells, adj, "src", limit)) == whole
    nothing = cells.selectExpr("sample_id", "cell_id", "false AS src")
    assert all(r[2] is None for r in rows(graph.hops_to(nothing, adj, "src", 0)))
    assert rows(graph.hops_to(cells.limit(0), adj, "src", 0)) == []


def test_components(field):
    cells, adj = field
    members = cells.where("cell_id % 7 <> 3")
    whole = rows(graph.components(members, adj))
    assert len({r[:1] + r[2:] for r in whole}) < len(whole) == members.count()
    for limit in (0, 45, 100):
        assert rows(graph.components(members, adj, limit)) == whole
    assert rows(graph.components(members, adj.limit(0), 0)) == sorted(((r[0], r[1], r[1]) for r in whole), key=repr)
    assert rows(graph.components(members.limit(0), adj, 0)) == []


def test_a_long_chain_settles_in_few_rounds(spark):
    n = 2000
    cells = spark.createDataFrame([(1, i) for i in range(n)], "sample_id long, cell_id long")
    chain = graph.adjacency(spark.createDataFrame([(1, i, i + 1, 1.0) for i in range(n - 1)], graph.EDGES))
    assert {r.component for r in graph.components_by_stars(cells, chain, 16).collect()} == {0}
