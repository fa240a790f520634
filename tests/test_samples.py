"""Where samples lie, names that commands are given, and calls by name."""

import pytest

from cytoplan import cli
from cytoplan.operators import profile
from cytoplan.plans import adapters
from cytoplan.plans.engine import Engine, HplotConfig
from cytoplan.sources import samples, tables


def test_folders_manifests_and_plain_files(spark, tmp_path):
    for name in ("b.h5ad", "a.csv", "notes.txt"):
        (tmp_path / name).write_text("")
    (tmp_path / "c.zarr").mkdir()
    got = samples.enumerate_samples(spark, str(tmp_path)).collect()
    assert [r.sample_id for r in got] == ["a", "b", "c"] and got[0].path.endswith("/a.csv")
    (tmp_path / "list.txt").write_text("# two\ny.h5ad\tsecond\nx.h5ad\n")
    got = samples.enumerate_samples(spark, f"sample-list://{tmp_path}/list.txt").collect()
    assert [tuple(r) for r in got] == [("x.h5ad", "x"), ("y.h5ad", "second")]
    with pytest.raises(tables.ContractError, match="sample-list"):
        samples.enumerate_samples(spark, str(tmp_path / "notes.txt"))
    with pytest.raises(tables.MissingKeyError):
        samples.enumerate_samples(spark, str(tmp_path / "absent"))


def test_instrument_folders(spark, tmp_path):
    (tmp_path / "cells.csv.gz").write_text("")
    assert not samples.is_xenium(spark, str(tmp_path))
    (tmp_path / "cell_feature_matrix.h5").write_text("")
    assert samples.is_xenium(spark, str(tmp_path))


def test_headers_are_united(spark, tmp_path):
    for name, text in (("1", "cell_id,t cell\n1,1\n"), ("2", "b,cell_id\n5,2\n"), ("3", "cell_id,t cell\n3,0\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    df = samples.read_wide(spark, [str(tmp_path / f"{i}.csv") for i in (1, 2, 3)])
    assert df.columns == ["cell_id", "t cell", "b"]
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == [("1", "1", None), ("2", None, "5"), ("3", "0", None)]
    with pytest.raises(tables.ContractError):
        samples.read_wide(spark, [])


def test_names_are_found_in_any_case(spark):
    assert samples.resolved(spark, ["out_mean", "in_sum"], ["IN_SUM", "cci_out_mean"], "cci_") == ["in_sum", "out_mean"]
    with pytest.raises(tables.MissingKeyError, match="x, y"):
        samples.resolved(spark, ["out_mean"], ["x", "out_mean", "y"])
    assert samples.likely_type_columns(["n", "Cell_Type", "annotation"]) == ["Cell_Type", "annotation"]


def test_common_types(spark):
    cells = spark.createDataFrame([(1, 1, 0.0, 0.0, "b"), (1, 2, 0.0, 0.0, "a"), (2, 1, 0.0, 0.0, "b")], tables.CELLS)
    assert [tuple(r) for r in profile.most_common_types(cells).collect()] == [("b", 2, 2), ("a", 1, 1)]


def test_calls_by_name():
    parser = cli.parser()
    argv = adapters.to_argv(parser, "hplot", {"base_type": ["tumor", "t_cell"], "target_type": "b", "overwrite": True, "covering_only": False, "k": 3, "low": -2, "high": None})
    assert argv[0] == "hplot" and "--overwrite" in argv and "--covering-only" not in argv
    a = parser.parse_args(argv)
    assert a.base_type == ["tumor", "t_cell"]
    assert (a.target_type, a.k, a.low, a.high, a.overwrite) == (["b"], 3, -2, None, True)
    with pytest.raises(tables.ContractError, match="unknown options of cci: nonsense; missing options of cci: lr_pairs"):
        adapters.to_argv(parser, "cci", {"nonsense": 1})
    with pytest.raises(tables.ContractError, match="blanks"):
        adapters.to_argv(parser, "hplot", {"base_type": ["t cell"], "target_type": ["b"]})
    found = adapters.schema(parser)
    assert found["commands"]["run"]["needed"] == ["cells", "base_type", "target_type"]
    assert next(o for o in found["options"] if o["name"] == "kernel")["default"] == "exponential"


def test_layout_and_axes_by_name(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    assert adapters.layout(engine) == {"root": str(tmp_path), "tables": {}, "more": False}
    cells = spark.createDataFrame([(1, i, float(i % 5) * 9, float(i // 5) * 9 + 0.1 * (i % 5), "a" if i % 2 else "b") for i in range(25)], tables.CELLS)
    engine.ingest(cells)
    assert adapters.layout(engine)["tables"]["cells"] == ["sample_id=1"]
    with pytest.raises(tables.MissingKeyError):
        engine.hplot(HplotConfig(["a"], ["out_mean"], target_by="cci"))
    pairs = spark.createDataFrame([("L", "R")], "ligand string, receptor string")
    engine.ingest(cells, spark.createDataFrame([(1, i, g, 1.0 + i) for i in range(25) for g in ("L", "R")], tables.EXPRESSION))
    engine.cci(pairs)
    assert engine.hplot(HplotConfig(["a"], ["CCI_out_mean"], target_by="cci")).count() >= 0
    with pytest.raises(tables.MissingKeyError, match="out_best"):
        engine.hplot(HplotConfig(["a"], ["out_best"], target_by="cci"))
