"""Boxes and landmarks in shares of the image size: ``struct<x,y,width,height>`` and ``struct<x,y>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(c: Column) -> Column:
    return F.least(F.greatest(F.when(F.isnan(c), F.lit(0.0)).otherwise(c), F.lit(0.0)), F.lit(1.0))


def clamp_box(box: Column) -> Column:
    """The box inside [0, 1]; what lies outside is cut off."""
    left, top = _unit(box["x"]), _unit(box["y"])
    right, bottom = _unit(box["x"] + F.greatest(box["width"], F.lit(0.0))), _unit(box["y"] + F.greatest(box["height"], F.lit(0.0)))
    return F.struct(
        left.cast("float").alias("x"), top.cast("float").alias("y"),
        F.greatest(right - left, F.lit(0.0)).cast("float").alias("width"), F.greatest(bottom - top, F.lit(0.0)).cast("float").alias("height"),
    )


def clamp_landmarks(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(_unit(p["x"]).cast("float").alias("x"), _unit(p["y"]).cast("float").alias("y")))


def area(box: Column) -> Column:
    return F.greatest(box["width"].cast("double"), F.lit(0.0)) * F.greatest(box["height"].cast("double"), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes apart or without area."""
    d = lambda box, f: box[f].cast("double")
    width = F.greatest(F.least(d(a, "x") + d(a, "width"), d(b, "x") + d(b, "width")) - F.greatest(d(a, "x"), d(b, "x")), F.lit(0.0))
    height = F.greatest(F.least(d(a, "y") + d(a, "height"), d(b, "y") + d(b, "height")) - F.greatest(d(a, "y"), d(b, "y")), F.lit(0.0))
    shared = width * height
    union = area(a) + area(b) - shared
    return F.when(union <= 0, F.lit(0.0)).otherwise(shared / union)


def valid_box(box: Column) -> Column:
    """Finite, of some size and inside [0, 1] but for a millionth."""
    v = [box[f].cast("double") for f in ("x", "y", "width", "height")]
    finite = ~F.isnan(v[0]) & ~F.isnan(v[1]) & ~F.isnan(v[2]) & ~F.isnan(v[3])
    inside = (v[0] >= 0) & (v[1] >= 0) & (v[2] > 0) & (v[3] > 0) & (v[0] + v[2] <= 1.000001) & (v[1] + v[3] <= 1.000001)
    return F.coalesce(finite & inside, F.lit(False))


def landmarks_to_pixels(points: Column, width: Column, height: Column, last_pixel: bool = True) -> Column:
    """Points in pixels. With ``last_pixel`` 1.0 is the last pixel and exactly five points are needed, else 1.0 is the full size."""
    less = 1 if last_pixel else 0
    scaled = F.transform(points, lambda p: F.struct((p["x"] * (width - less)).cast("float").alias("x"), (p["y"] * (height - less)).cast("float").alias("y")))
    return F.when(F.size(points) == 5, scaled) if last_pixel else scaled
