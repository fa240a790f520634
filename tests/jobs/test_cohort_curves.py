"""The cohort job: two runs over growing input, changed and vanished samples, the command line."""

import json

import pytest

from cytoplan.plans import catalog
from cytoplan.sources import tables
from jobs import cohort_curves as job

SF = "/root/testdata/sf0.001"


def cells_of(spark, samples, shift=0.0):
    rows = [(s, i, float(i % 8) * 10 + (i * 7 + s) % 5 / 5, i // 8 * 10.0 + (i * 3 + s) % 7 / 7 + shift, "Tumor" if i % 8 < 4 else "lymphocyte") for s in samples for i in range(64)]
    return spark.createDataFrame(rows, tables.CELLS)


@pytest.fixture
def settings():
    return {**job.settings_of(), "table": "cells", "derive": None}


def shown(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_second_run_takes_only_new_and_changed_samples(spark, tmp_path, settings):
    where, out = str(tmp_path / "in"), str(tmp_path / "out")
    cells_of(spark, range(3)).write.parquet(f"{where}/cells.parquet")
    first = job.run(spark, where, out, settings)
    assert (first["samples"], first["computed"]) == (3, 3) and first["rows"] > 10
    before = shown(job.output(spark, out, settings))
    assert job.run(spark, where, out, settings) == {**first, "computed": 0} and shown(job.output(spark, out, settings)) == before
    # One sample more, one changed, one gone.
    cells_of(spark, [0, 5]).union(cells_of(spark, [1], 0.25)).write.mode("overwrite").parquet(f"{where}/cells.parquet")
    second = job.run(spark, where, out, settings)
    assert (second["samples"], second["computed"]) == (3, 2)
    after, other = shown(job.output(spark, out, settings)), str(tmp_path / "other")
    job.run(spark, where, other, settings)
    assert after == shown(job.output(spark, other, settings)) and after != before
    assert {r.sample_id for r in job.output(spark, out, settings).collect()} == {0, 1, 5}


def test_a_sample_that_loses_its_region_leaves_no_curve(spark, tmp_path, settings):
    where, out = str(tmp_path / "in"), str(tmp_path / "out")
    cells_of(spark, [0, 1]).write.parquet(f"{where}/cells.parquet")
    job.run(spark, where, out, settings)
    plain = cells_of(spark, [1]).selectExpr("sample_id", "cell_id", "x_um", "y_um", "'stroma' AS cell_type")
    spark.read.parquet(f"{where}/cells.parquet").where("sample_id = 0").union(plain).write.parquet(f"{where}/next")
    spark.read.parquet(f"{where}/next").write.mode("overwrite").parquet(f"{where}/cells.parquet")
    assert job.run(spark, where, out, settings)["computed"] == 1
    assert {r.sample_id for r in job.output(spark, out, settings).collect()} == {0}
    assert job.run(spark, where, out, settings)["computed"] == 0  # it is marked all the same


def test_settings_have_partitions_of_their_own_and_the_range_computes_nothing(spark, tmp_path, settings):
    where, out = str(tmp_path / "in"), str(tmp_path / "out")
    cells_of(spark, [0]).write.parquet(f"{where}/cells.parquet")
    job.run(spark, where, out, settings)
    whole = shown(job.output(spark, out, settings))
    assert job.run(spark, where, out, {**settings, "low": -1, "high": 1})["computed"] == 0
    assert {r.layer for r in job.output(spark, out, {**settings, "low": -1, "high": 1}).collect()} <= {-1, 0, 1}
    assert job.run(spark, where, out, {**settings, "hops": 1})["computed"] == 1
    job.run(spark, where, out, settings)
    assert shown(job.output(spark, out, settings)) == whole


def test_empty_table_nulls_and_further_columns(spark, tmp_path, settings):
    where, out = str(tmp_path / "in"), str(tmp_path / "out")
    cells_of(spark, [0]).limit(0).write.parquet(f"{where}/cells.parquet")
    assert job.run(spark, where, out, settings) == {"samples": 0, "computed": 0, "rows": 0} and job.output(spark, out, settings).count() == 0
    odd = spark.createDataFrame([(7, 1, None, 2.0, None), (7, 2, 1.0, None, "x")], tables.CELLS)
    cells_of(spark, [0]).union(odd).selectExpr("*", "'z' as config", "1 as layer").write.mode("overwrite").parquet(f"{where}/cells.parquet")
    assert job.run(spark, where, out, settings)["computed"] == 2
    assert {r.sample_id for r in job.output(spark, out, settings).collect()} == {0}


def test_equals_the_curves_of_the_library_and_leaves_the_session_alone(spark, tmp_path):
    out, settings = str(tmp_path / "out"), job.settings_of()
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    job.run(spark, SF, out, settings)
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before
    assert shown(job.output(spark, out, settings)) == shown(catalog.QUERIES["gapfill_summary"](catalog.World(spark, SF)))


def test_command_line(tmp_path, monkeypatch, capsys, spark):
    class Kept:
        """The session of the tests, which a command must not end."""

        def __init__(self, *_):
            pass

        appName = master = lambda self, *_: self
        getOrCreate = lambda self: type("S", (), {"__getattr__": lambda _, k: (lambda: None) if k == "stop" else getattr(spark, k)})()

    config = tmp_path / "c.json"
    config.write_text(json.dumps({**job.settings_of(), "hops": 1}))
    monkeypatch.setattr(job.SparkSession, "builder", Kept())
    with pytest.raises(SystemExit):
        job.main(["--out", str(tmp_path)])
    job.main(["--tables", SF, "--out", str(tmp_path / "out"), "--config", str(config)])
    assert json.loads(capsys.readouterr().out)["computed"] == 25
