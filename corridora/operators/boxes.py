"""Boxes, colours and small arithmetic of the image stages, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centre(box: Column) -> tuple[Column, Column]:
    """The mean of the four corners of an array x1, y1, .. x4, y4."""
    mean = lambda first: sum((box[i] for i in range(first + 2, 8, 2)), box[first]) / 4.0
    return mean(0), mean(1)


def has_negative(box: Column) -> Column:
    return F.exists(box, lambda v: v < 0)


def extents(box: Column) -> Column:
    """(x1, y1, x2, y2) of an array of corners."""
    of = lambda odd: F.filter(box, lambda v, i: i % 2 == odd)
    return F.struct(F.array_min(of(0)).alias("x1"), F.array_min(of(1)).alias("y1"), F.array_max(of(0)).alias("x2"), F.array_max(of(1)).alias("y2"))


def is_empty(box: Column) -> Column:
    e = extents(box)
    return ~((e["x2"] > e["x1"]) & (e["y2"] > e["y1"]))


def clamped(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """The box inside the image; its ends may be the image's width and height."""
    inside = lambda v, n: F.greatest(F.lit(0), F.least(v, n))
    return [inside(x1, width), inside(y1, height), inside(x2, width), inside(y2, height)]


def outside_boxes(points: DataFrame, boxes: DataFrame, margin: int = 3) -> DataFrame:
    """Points (id, x, y) that no box (box, x1, y1, x2, y2) grown by the margin holds."""
    from .spatial import in_boxes

    return points.join(in_boxes(points, boxes, margin=margin).select("id").distinct(), "id", "left_anti")


def polar(x: Column, y: Column, radius: Column, degrees: Column) -> tuple[Column, Column]:
    """The place at a distance and an angle, cut to integers."""
    return (x + radius * F.cos(F.radians(degrees))).cast("int"), (y + radius * F.sin(F.radians(degrees))).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def is_white(r: Column, g: Column, b: Column) -> Column:
    return (r == 255) & (g == 255) & (b == 255)


def resized(width: Column, height: Column, largest: int, magnify: float = 1.0) -> Column:
    """(ratio, width, height, padded_width, padded_height): the longer side times `magnify`, but `largest` at most; padded to 32."""
    side = F.greatest(width, height)
    ratio = F.least(side * F.lit(magnify), F.lit(float(largest))) / side
    w, h = (width * ratio).cast("int"), (height * ratio).cast("int")
    up = lambda v: (F.ceil(v / 32.0) * 32).cast("int")
    return F.struct(ratio.alias("ratio"), w.alias("width"), h.alias("height"), up(w).alias("padded_width"), up(h).alias("padded_height"))


def rescaled(v: Column, ratio: Column, net: float = 2.0) -> Column:
    """Coordinates of a score map, which is `net` times as small as its input, in the image again."""
    return v * net / ratio


def title(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def plot_color(a: Column, b: Column) -> Column:
    """Of an edge on the plot: outside, corridor, transition, room; the view has another order."""
    out = F.when(F.lit(False), "")
    for t in ("outside", "corridor", "transition", "room"):
        out = out.when((a == t) | (b == t), t)
    return out.otherwise("default")


def transition_names(found: DataFrame) -> DataFrame:
    """(ord, id) of transitions (ord, label): stairs and elevators are counted each, others take the number among all."""
    from pyspark.sql import Window

    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("ord"))
    own, whole = number("building", "label"), number("building")
    name = F.when(F.col("label").isin("stairs", "elevator"), F.concat("label", F.lit("_"), own)).otherwise(F.concat(F.lit("transition_"), whole))
    return found.select("building", "ord", name.alias("id"))
