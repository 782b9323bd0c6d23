"""Boxes as Columns: struct<x, y, w, h>, all doubles, from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def js_round(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5).cast("double")


def scaled(b: Column, dpr: Column, up: bool = True) -> Column:
    """CSS pixels to image pixels, or back; a ratio that isn't positive counts as 1."""
    k = F.when(dpr > 0, dpr).otherwise(1.0)
    return box(*[(b[f] * k) if up else (b[f] / k) for f in "xywh"])


def padded(b: Column, by: float, width: Column, height: Column) -> Column:
    x0, y0 = F.greatest(F.lit(0.0), b["x"] - by), F.greatest(F.lit(0.0), b["y"] - by)
    x1, y1 = F.least(width.cast("double"), b["x"] + b["w"] + by), F.least(height.cast("double"), b["y"] + b["h"] + by)
    return box(x0, y0, F.greatest(F.lit(0.0), x1 - x0), F.greatest(F.lit(0.0), y1 - y0))


def rounded(b: Column, step: int = 1) -> Column:
    return box(*[js_round(b[f] / step) * step for f in "xywh"])


def center(b: Column) -> Column:
    return F.struct((b["x"] + b["w"] / 2).alias("x"), (b["y"] + b["h"] / 2).alias("y"))


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x"], b["x"] + b["w"]) & y.between(b["y"], b["y"] + b["h"])


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["w"]) * F.greatest(F.lit(0.0), b["h"])


def shared(a: Column, b: Column) -> Column:
    """The area that both have."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def intersection(a: Column, b: Column) -> Column:
    """The common box; null where there is none."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - x
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - y
    return F.when((w > 0) & (h > 0), box(x, y, w, h))


def moved(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x"] + dx, b["y"] + dy, b["w"], b["h"])


def iou(a: Column, b: Column) -> Column:
    own = shared(a, b)
    return F.coalesce(F.try_divide(own, a["w"] * a["h"] + b["w"] * b["h"] - own), F.lit(0.0))


def iom(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(shared(a, b), F.least(a["w"] * a["h"], b["w"] * b["h"])), F.lit(0.0))


def drift(a: Column, b: Column) -> Column:
    """How far the corner has moved."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def clipped(b: Column, sx: Column, sy: Column, width: Column, height: Column) -> Column:
    """A box in bitmap pixels, scaled and cut to the bitmap."""
    x, y = F.greatest(F.lit(0.0), F.floor(b["x"] * sx)), F.greatest(F.lit(0.0), F.floor(b["y"] * sy))
    w, h = F.least(F.ceil(b["w"] * sx), width - x), F.least(F.ceil(b["h"] * sy), height - y)
    return box(x, y, F.greatest(F.lit(0.0), w), F.greatest(F.lit(0.0), h))
