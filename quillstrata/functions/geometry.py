"""Boxes in points, origin top left, y downwards: struct<x0, y0, x1, y1>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def width(b: Column) -> Column:
    return F.round(b["x1"] - b["x0"], 2)


def height(b: Column) -> Column:
    return F.round(b["y1"] - b["y0"], 2)


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def overlap_share(a: Column, b: Column) -> Column:
    """Shared horizontal range as a fraction of a's width."""
    shared = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return F.when(width(a) > 0, shared / width(a)).otherwise(0.0)


MARGIN, LINE, PAGE_WIDTH = 72.0, 14.0, 612.0


def line_box(first: Column, after: Column) -> Column:
    """The synthetic box of source lines [first, after)."""
    return box(F.lit(MARGIN), MARGIN + first * LINE, F.lit(PAGE_WIDTH - MARGIN), MARGIN + F.greatest(after, first + 1) * LINE)


def scaled(b: Column, dpi: float) -> Column:
    f = dpi / 72.0
    return box(b["x0"] * f, b["y0"] * f, b["x1"] * f, b["y1"] * f)


def facing_edges(a: Column, b: Column) -> Column:
    """From the middle of a's edge that faces b to the middle of b's that faces a: struct<x0, y0, x1, y1>."""
    below, above, right = b["y0"] >= a["y1"], b["y1"] <= a["y0"], b["x0"] >= a["x1"]
    across = box(F.when(right, a["x1"]).otherwise(a["x0"]), center_y(a), F.when(right, b["x0"]).otherwise(b["x1"]), center_y(b))
    return F.when(below, box(center_x(a), a["y1"], center_x(b), b["y0"])).when(above, box(center_x(a), a["y0"], center_x(b), b["y1"])).otherwise(across)
