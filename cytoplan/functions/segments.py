"""Segments of the plane as column expressions: quantised places, direction-free keys, angles, distances, common length."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def on_grid(value: Column | str, grid: float) -> Column:
    """The number of the grid line next to a coordinate, halves to even."""
    return F.rint((F.col(value) if isinstance(value, str) else value) / F.lit(grid)).cast("long")


def key(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Struct of both ends, the smaller one first, and whether the segment runs from it."""
    forward = (x0 < x1) | ((x0 == x1) & (y0 <= y1))
    name = F.struct(F.when(forward, x0).otherwise(x1).alias("ax"), F.when(forward, y0).otherwise(y1).alias("ay"), F.when(forward, x1).otherwise(x0).alias("bx"), F.when(forward, y1).otherwise(y0).alias("by"))
    return name, forward


def _ends(s: Column) -> tuple[Column, Column, Column, Column]:
    return s["x0"], s["y0"], s["x1"], s["y1"]


def parallel(s: Column, t: Column, degrees: float) -> Column:
    """Whether two segments (structs x0, y0, x1, y1) of some length point the same or the opposite way but for ``degrees``."""
    (a, b, c, d), (e, f, g, h) = _ends(s), _ends(t)
    dot = (c - a) * (g - e) + (d - b) * (h - f)
    return F.abs(dot) >= math.cos(math.radians(degrees)) * F.sqrt((c - a) * (c - a) + (d - b) * (d - b)) * F.sqrt((g - e) * (g - e) + (h - f) * (h - f)) - 1e-12


def boxes_meet(s: Column, t: Column) -> Column:
    """Whether the boxes about two segments have a point in common."""
    (a, b, c, d), (e, f, g, h) = _ends(s), _ends(t)
    low, high = F.least, F.greatest
    return (low(a, c) <= high(e, g)) & (low(e, g) <= high(a, c)) & (low(b, d) <= high(f, h)) & (low(f, h) <= high(b, d))


def _from_point(px: Column, py: Column, s: Column) -> Column:
    """Squared distance of a point from a segment."""
    a, b, c, d = _ends(s)
    square = (c - a) * (c - a) + (d - b) * (d - b)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a) * (c - a) + (py - b) * (d - b)) / square))
    dx, dy = px - a - share * (c - a), py - b - share * (d - b)
    return dx * dx + dy * dy


def _side(s: Column, px: Column, py: Column) -> Column:
    a, b, c, d = _ends(s)
    return (c - a) * (py - b) - (d - b) * (px - a)


def within(s: Column, t: Column, distance: float) -> Column:
    """Whether two segments come within ``distance`` of each other."""
    (a, b, c, d), (e, f, g, h) = _ends(s), _ends(t)
    crossing = (_side(s, e, f) * _side(s, g, h) < 0) & (_side(t, a, b) * _side(t, c, d) < 0)
    return crossing | (F.least(_from_point(a, b, t), _from_point(c, d, t), _from_point(e, f, s), _from_point(g, h, s)) <= distance * distance)


def common_length(s: Column, t: Column) -> Column:
    """Length that the shadows of two segments have in common, each on the axis that it mostly runs along."""

    def shadow(q: Column) -> tuple[Column, Column]:
        a, b, c, d = _ends(q)
        flat = F.abs(c - a) >= F.abs(d - b)
        return F.when(flat, F.least(a, c)).otherwise(F.least(b, d)), F.when(flat, F.greatest(a, c)).otherwise(F.greatest(b, d))

    (low, high), (from_, to) = shadow(s), shadow(t)
    return F.greatest(F.lit(0.0), F.least(high, to) - F.greatest(low, from_))
