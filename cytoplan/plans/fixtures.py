"""Cells, expression and niche labels derived from the driver's tables by arithmetic that both SQL engines do alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The columns and thresholds of the derived cells.
CUSTOMER = {"id": "c_custkey", "sample": "CAST(c_nationkey AS BIGINT)", "ty": "c_mktsegment", "val": "c_acctbal", "thr": "-500", "lym": "('BUILDING','MACHINERY')", "table": "customer"}
ORDERS = {"id": "o_orderkey", "sample": "o_custkey % 25", "ty": "o_orderpriority", "val": "o_totalprice", "thr": "30000", "lym": "('1-URGENT','2-HIGH')", "table": "orders"}


def cells_sql(spec: dict[str, str] = CUSTOMER) -> str:
    """SQL of sample_id, cell_id, x_um, y_um, cell_type and expr."""
    return """WITH base AS (SELECT {id} id, {sample} sample_id, {ty} ty, {val} val, row_number() OVER (PARTITION BY {sample} ORDER BY {id}) - 1 AS cell_id FROM {table}),
xy AS (SELECT *, CAST((cell_id % 8) * 10 AS DOUBLE) + CAST(((cell_id * 7919 + sample_id * 104729) % 997) AS DOUBLE) / 199.4 AS x_um,
  CAST((cell_id - cell_id % 8) / 8 * 10 AS DOUBLE) + CAST(((cell_id * 6101 + sample_id * 15485863) % 991) AS DOUBLE) / 198.2 AS y_um FROM base)
SELECT CAST(sample_id AS BIGINT) sample_id, CAST(cell_id AS BIGINT) cell_id, x_um, y_um,
  CASE WHEN (x_um-35)*(x_um-35) + (y_um-35)*(y_um-35) < 625 AND val > {thr} THEN 'tumor' WHEN ty IN {lym} THEN 'lymphocyte' ELSE 'stroma' END cell_type, val expr FROM xy""".format(**spec)


EXPRESSION_SQL = """SELECT sample_id, cell_id, 'LIG' AS gene, CAST((cell_id * 7) % 5 AS DOUBLE) AS value FROM cells
UNION ALL SELECT sample_id, cell_id, 'REC' AS gene, CAST((cell_id * 3 + sample_id) % 4 AS DOUBLE) AS value FROM cells
UNION ALL SELECT sample_id, cell_id, 'HLA-A' AS gene, CAST((cell_id + sample_id) % 3 AS DOUBLE) AS value FROM cells"""
PAIRS = [("LIG", "REC"), ("REC", "HLA-A"), ("LIG", "ABSENT")]
LABELS_SQL = ("SELECT sample_id, cell_id, CAST(cell_id % 4 AS INT) AS niche_id FROM cells", "SELECT sample_id, cell_id, CAST((cell_id * 7) % 3 AS INT) AS niche_id FROM cells")


def cells(spark: SparkSession, sf_dir: str, spec: dict[str, str] = CUSTOMER) -> DataFrame:
    return spark.sql(cells_sql({**spec, "table": f"parquet.`{sf_dir}/{spec['table']}.parquet`"}))


def expression(spark: SparkSession, base: DataFrame) -> DataFrame:
    return spark.sql(EXPRESSION_SQL.replace("FROM cells", "FROM {cells}"), cells=base)


def labels(spark: SparkSession, base: DataFrame, which: int = 0) -> DataFrame:
    return spark.sql(LABELS_SQL[which].replace("FROM cells", "FROM {cells}"), cells=base)


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "row_no int, ligand string, receptor string")


def footprints_sql(shifted: bool) -> str:
    """SQL of sample_id, owner, label and the corners xa, ya, ... xd, yd of a four-sided polygon for each cell; ``shifted`` moves some of them by 0.3."""

    def corner(name: str, right: int, up: int) -> str:
        at = f"(cell_id % 8 + {right})", f"(CAST((cell_id - cell_id % 8) / 8 AS BIGINT) + {up})"
        move = " + CASE WHEN cell_id % 11 = 3 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" if shifted else ""
        x = f"CAST({at[0]} * 10 AS DOUBLE) + CAST(({at[0]} * 7919 + {at[1]} * 104729 + sample_id * 31) % 97 AS DOUBLE) / 30"
        y = f"CAST({at[1]} * 10 AS DOUBLE) + CAST(({at[0]} * 6101 + {at[1]} * 15485863 + sample_id * 17) % 89 AS DOUBLE) / 30"
        return f"{x}{move} AS x{name}, {y}{move} AS y{name}"

    label = "CAST(CASE WHEN (cell_id % 8 - 3) * (cell_id % 8 - 3) + (CAST((cell_id - cell_id % 8) / 8 AS BIGINT) % 6 - 3) * (CAST((cell_id - cell_id % 8) / 8 AS BIGINT) % 6 - 3) < 4 THEN 1 ELSE 0 END AS INT)"
    corners = ", ".join(corner(*c) for c in (("a", 0, 0), ("b", 1, 0), ("c", 1, 1), ("d", 0, 1)))
    return f"SELECT sample_id, cell_id AS owner, {label} AS label, {corners} FROM cells"


def footprints(spark: SparkSession, base: DataFrame, shifted: bool = False) -> DataFrame:
    """sample_id, owner, label, x and y (corners) of each cell's footprint."""
    rows = spark.sql(footprints_sql(shifted).replace("FROM cells", "FROM {cells}"), cells=base)
    return rows.selectExpr("sample_id", "owner", "label", "array(xa, xb, xc, xd) AS x", "array(ya, yb, yc, yd) AS y")


def bench_cells(spark: SparkSession, sf_dir: str, samples: int = 64, columns: int = 100) -> DataFrame:
    """Larger samples: one cell for each lineitem, in jittered lattices of so many columns."""
    return spark.sql(f"""WITH base AS (SELECT l_orderkey % {samples} AS sample_id, l_quantity q, l_extendedprice v, row_number() OVER (PARTITION BY l_orderkey % {samples} ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS cell_id FROM parquet.`{sf_dir}/lineitem.parquet`)
SELECT CAST(sample_id AS BIGINT) sample_id, CAST(cell_id AS BIGINT) cell_id, CAST((cell_id % {columns}) * 10 AS DOUBLE) + CAST((cell_id * 7919 + sample_id * 104729) % 997 AS DOUBLE) / 199.4 AS x_um,
  CAST((cell_id - cell_id % {columns}) / {columns} * 10 AS DOUBLE) + CAST((cell_id * 6101 + sample_id * 15485863) % 991 AS DOUBLE) / 198.2 AS y_um,
  CASE WHEN (cell_id % {columns} BETWEEN 20 AND 45) AND q > 5 THEN 'tumor' WHEN q > 25 THEN 'lymphocyte' ELSE 'stroma' END cell_type, v expr FROM base""")
