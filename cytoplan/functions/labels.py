"""Labels and scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sanitise(label: Column | str) -> Column:
    """Trimmed, lower case, anything but letters, digits and ``_`` to ``_``, runs of ``_`` to one and none at the ends."""
    plain = F.regexp_replace(F.lower(F.trim(F.col(label) if isinstance(label, str) else label)), "[^0-9a-z_]+", "_")
    return F.regexp_replace(F.regexp_replace(plain, "_+", "_"), "^_|_$", "")


def gene_tag(gene: Column | str) -> Column:
    """Letters and digits only, upper case."""
    return F.upper(F.regexp_replace(F.col(gene) if isinstance(gene, str) else gene, "[^A-Za-z0-9]", ""))


def kernel_weight(kind: str, distance: Column, scale: float) -> Column:
    """Decay of an interaction with distance."""
    if kind == "exponential":
        return F.exp(-distance / scale)
    if kind == "gaussian":
        return F.exp(-distance * distance / (2.0 * scale * scale))
    if kind == "binary":
        return F.lit(1.0)
    raise ValueError(f"kernel must be exponential, gaussian or binary, not {kind!r}")


def hard_label(types: dict[str, str]) -> Column:
    """The type with the largest column, the first of equals; ``types`` maps columns to types, in order."""
    top = F.greatest(*[F.coalesce(F.col(c), F.lit(float("-inf"))) for c in types]) if len(types) > 1 else F.col(next(iter(types)))
    out = F.lit(None).cast("string")
    for column, name in reversed(types.items()):
        out = F.when(F.col(column) == top, F.lit(name)).otherwise(out)
    return out


def normalised(columns: list[str], epsilon: float = 1e-8) -> list[Column]:
    """Each column's share of the row's sum."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)) + F.lit(epsilon)
    return [(F.coalesce(F.col(c), F.lit(0.0)) / total).alias(c) for c in columns]


def one_hot(cells: DataFrame, types: list[str]) -> DataFrame:
    """The wide contract: sample_id, cell_id, centres and ``prob_<type>`` of the given vocabulary."""
    return cells.select("sample_id", "cell_id", F.col("x_um").alias("center_x_um"), F.col("y_um").alias("center_y_um"), *[F.when(sanitise("cell_type") == t, 1.0).otherwise(0.0).alias(f"prob_{t}") for t in types])


def cell_centre(columns: list[str]) -> tuple[Column, Column]:
    """Centre of a cell: the micron columns if there are any, else the middle of its box, rounded half to even."""
    if {"center_x_um", "center_y_um"} <= set(columns):
        return F.col("center_x_um"), F.col("center_y_um")
    if {"minx", "miny", "width", "height"} <= set(columns):
        return F.rint(F.col("minx") + F.col("width") / 2), F.rint(F.col("miny") + F.col("height") / 2)
    raise ValueError("cells have neither center_x_um and center_y_um nor minx, miny, width and height")


def short_ids(names: list[str]) -> list[str]:
    """Names without the parts between ``_`` that all of them begin or end with."""
    parts = [n.split("_") for n in names]
    if len(names) < 2:
        return list(names)
    least = min(map(len, parts)) - 1
    head = next((k for k in range(least) if len({p[k] for p in parts}) > 1), least)
    tail = next((k for k in range(least - head) if len({p[-1 - k] for p in parts}) > 1), least - head)
    return ["_".join(p[head : len(p) - tail]) for p in parts]


def niche_number(label: Column | str) -> Column:
    """The number at the end of a niche column's name, to sort by."""
    return F.regexp_extract(F.col(label) if isinstance(label, str) else label, r"(\d+)$", 1).try_cast("int")


def vocabulary(cells: DataFrame) -> list[str]:
    """Sanitised cell types of all samples, sorted. Types are a vocabulary, not data: their number is checked."""
    found = sorted(r[0] for r in cells.select(sanitise("cell_type").alias("t")).where("t is not null").distinct().limit(10_001).collect())
    if len(found) > 10_000:
        raise ValueError("more than 10000 cell types: is this column a cell type?")
    return found
