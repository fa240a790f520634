"""Registered queries against DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from cytoplan.plans import catalog, oracles
from jobs import queries as jobs

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = sorted(oracles.oracle_sql())


@pytest.fixture(scope="module")
def world(spark):
    """One for all queries, so that the graph is made once."""
    return catalog.World(spark, SF)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(None if v is None or v != v else float(v) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(world, duck, name):
    df = catalog.QUERIES[name](world)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = [tuple(r[names.index(c)] for c in cols) for r in found.fetchall()]
    assert sorted(names) == cols and len(got) == len(want) and plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(jobs.oracle_sql()))
def test_job_equals_sql(spark, duck, name):
    df = jobs.queries()[name](spark, SF)
    found = duck.execute(jobs.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns) and plain(tuple(r[c] for c in sorted(names)) for r in df.collect()) == plain(tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())


@pytest.mark.parametrize("name", ["pca_features", "kmeans_niches", "kmeans_by_sample", "leiden_sweep", "dgi_embeddings", "niche_regions", "niche_outlines", "knn_lists", "niches_by_sample", "harmony_embeddings"])
def test_queries_without_sql(world, name):
    assert catalog.QUERIES[name](world).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
