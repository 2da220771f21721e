"""Boxes: scaled integers, normalised doubles, pixels, page points under rotation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: boxes are used many times over."""
    return F.transform(F.array(value), body)[0]


def normalized(box: Column) -> Column:
    """left/top/right/bottom in 0..1000 to doubles in 0..1; null stays null."""
    scaled = _box(*[box[k] / F.lit(1000.0) for k in ("left", "top", "right", "bottom")])
    return F.when(box.isNotNull(), scaled)


def ordered(box: Column) -> Column:
    """Corners in order: the smaller first on both axes."""
    return _box(F.least(box["x0"], box["x1"]), F.least(box["y0"], box["y1"]), F.greatest(box["x0"], box["x1"]), F.greatest(box["y0"], box["y1"]))


def pixels(box: Column, width: Column, height: Column) -> Column:
    """A normalised box on an image, corners in order, inside the image."""
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))

    def clamped(b: Column) -> Column:
        raw = ordered(_box(b["x0"] * width, b["y0"] * height, b["x1"] * width, b["y1"] * height))
        return _box(inside(raw["x0"], width), inside(raw["y0"], height), inside(raw["x1"], width), inside(raw["y1"], height))

    return F.when(box.isNotNull(), _let(box, clamped))


def page_points(box: Column, width: Column, height: Column, page: Column, rotation: Column) -> Column:
    """A box in pixels of a page's image as a box in points of the page rectangle ``page`` (x0, y0,
    width, height), for a page shown under a rotation; null for angles other than quarter turns."""
    turn = F.pmod(rotation, F.lit(360))

    def point(x: Column, y: Column) -> tuple[Column, Column]:
        u, v = x / width, y / height
        right = F.when(turn == 0, u).when(turn == 90, 1 - v).when(turn == 180, 1 - u).when(turn == 270, v)
        down = F.when(turn == 0, v).when(turn == 90, u).when(turn == 180, 1 - v).when(turn == 270, 1 - u)
        return page["x0"] + right * page["width"], page["y0"] + down * page["height"]

    def around(b: Column) -> Column:
        corners = F.array(*[F.struct(*[c.alias(n) for c, n in zip(point(b[x], b[y]), "xy", strict=True)]) for x in ("x0", "x1") for y in ("y0", "y1")])
        xs, ys = (lambda c: F.transform(c, lambda p: p["x"])), (lambda c: F.transform(c, lambda p: p["y"]))
        return _let(corners, lambda c: _box(F.array_min(xs(c)), F.array_min(ys(c)), F.array_max(xs(c)), F.array_max(ys(c))))

    return F.when(turn.isin(0, 90, 180, 270), _let(box, around))


def crop(box: Column, width: Column, height: Column) -> Column:
    """Whole pixels inside the image, or null where nothing is left."""
    cut = lambda v, most: F.greatest(F.lit(0), F.least(v.cast("int"), most.cast("int")))
    whole = lambda b: _box(cut(b["x0"], width), cut(b["y0"], height), cut(b["x1"], width), cut(b["y1"], height))
    return _let(_let(box, whole), lambda w: F.when((w["x1"] > w["x0"]) & (w["y1"] > w["y0"]), w))
