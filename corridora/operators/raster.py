"""Pixel relations: classes, regions, doors, tiles, box merging and geodesic partition."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import connected_components

#: Class colours, in order of precedence.
COLORS = {"room": (255, 204, 102), "outdoor": (255, 102, 204), "corridor": (178, 255, 102), "unmarked": (255, 255, 255), "wall": (0, 0, 0)}


def color_is(rgb: tuple[int, int, int], tol: int) -> Column:
    out = F.lit(True)
    for c, v in zip("rgb", rgb):
        out = out & F.col(c).between(v - tol, v + tol)
    return out


def pixel_class(tol: int = 10) -> Column:
    """The class of (r, g, b); pixels of no class are drawn as walls."""
    out = F.when(F.lit(False), "")
    for name, rgb in COLORS.items():
        out = out.when(color_is(rgb, tol), name)
    return out.otherwise("wall")


def door_class(rois: DataFrame, pixels: DataFrame, cell: int = 32) -> DataFrame:
    """(id, door_class) of half-open boxes (id, x1, y1, x2, y2) over classified pixels (y, x, cls): outdoor, then corridor, then white."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell))
    b = rois.where("x2 > x1 and y2 > y1").withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    p = pixels.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    has = lambda c: F.coalesce(F.bool_or(F.col("cls") == c), F.lit(False))
    seen = p.join(b, ["cx", "cy"]).where(inside).groupBy("id").agg(*[has(c).alias(c) for c in ("outdoor", "corridor", "room", "unmarked")])
    cls = F.when(F.col("outdoor"), "exit").when(F.col("corridor"), F.when(F.col("room"), "r2c").otherwise("c2c")).when(F.col("unmarked"), "wardrobe").otherwise("r2r")
    return rois.select("id").join(seen, "id", "left").select("id", cls.alias("door_class"))


def region_stats(pixels: DataFrame, region: str) -> DataFrame:
    return pixels.groupBy(region).agg(F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.sqrt(F.count("*") / F.pi()).alias("eq_radius"))


def tiles(images: DataFrame, size: int = 300, overlap: int = 75) -> DataFrame:
    """(id, tx, ty, x2, y2): top left corners every size - overlap pixels, cut off at the image's edge."""
    step = size - overlap
    at = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(step).cast("long"))
    out = images.where("w > 0 and h > 0").withColumn("tx", F.explode(at("w"))).withColumn("ty", F.explode(at("h")))
    return out.select("id", "tx", "ty", F.least(F.col("tx") + size, F.col("w")).alias("x2"), F.least(F.col("ty") + size, F.col("h")).alias("y2"))


def greedy_merge(boxes: DataFrame, threshold: int = 20) -> DataFrame:
    """(grp, n, x1, y1, x2, y2): per group, in order, a box joins the first merged box that it touches or whose centre is near."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list[int]] = []
        for b in pdf.sort_values("ord")[["x1", "y1", "x2", "y2"]].to_numpy().tolist():
            for m in out:
                touch = b[0] <= m[2] and m[0] <= b[2] and b[1] <= m[3] and m[1] <= b[3]
                dx, dy = (b[0] + b[2] - m[0] - m[2]) / 2, (b[1] + b[3] - m[1] - m[3]) / 2
                if touch or dx * dx + dy * dy < threshold * threshold:
                    m[:] = [min(m[0], b[0]), min(m[1], b[1]), max(m[2], b[2]), max(m[3], b[3])]
                    break
            else:
                out.append(b)
        return pd.DataFrame([(pdf["grp"].iloc[0], i, *m) for i, m in enumerate(out)], columns=["grp", "n", "x1", "y1", "x2", "y2"])

    return boxes.groupBy("grp").applyInPandas(run, "grp long, n long, x1 long, y1 long, x2 long, y2 long")


def geodesic_partition(pixels: DataFrame, seeds: DataFrame) -> DataFrame:
    """(img, y, x, label, steps): per image, each pixel goes to the seed that is nearest inside the mask, by 4-neighbour steps; the queue decides ties."""

    def run(mask: pd.DataFrame, seed: pd.DataFrame) -> pd.DataFrame:
        free = set(zip(mask["y"].tolist(), mask["x"].tolist()))
        got: dict = {}
        queue: deque = deque()
        for label, y, x in seed.sort_values("label")[["label", "y", "x"]].itertuples(index=False):
            if (y, x) in free and (y, x) not in got:
                got[(y, x)] = (label, 0)
                queue.append((y, x))
        while queue:
            y, x = queue.popleft()
            label, s = got[(y, x)]
            for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if p in free and p not in got:
                    got[p] = (label, s + 1)
                    queue.append(p)
        img = mask["img"].iloc[0] if len(mask) else 0
        return pd.DataFrame([(img, y, x, label, s) for (y, x), (label, s) in got.items()], columns=["img", "y", "x", "label", "steps"])

    return pixels.toDF(*pixels.columns).groupBy("img").cogroup(seeds.toDF(*seeds.columns).groupBy("img")).applyInPandas(run, "img long, y long, x long, label string, steps long")


def touching_groups(spark: SparkSession, boxes: DataFrame, cell: int = 64) -> DataFrame:
    """(grp, x1, y1, x2, y2, n): boxes (grp, ord, x1, y1, x2, y2) of a group that touch, directly or over others, as one box."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    # equal boxes touch, so the first stands for all; one without an extent does not touch itself, and stands alone
    alone = F.when((F.col("x1") > F.col("x2")) | (F.col("y1") > F.col("y2")), F.col("ord"))
    boxes = boxes.groupBy("grp", "x1", "y1", "x2", "y2", alone.alias("_u")).agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    laid = boxes.withColumn("_x", span("x1", "x2")).withColumn("_y", span("y1", "y2"))
    other = laid.select("grp", "_x", "_y", *[F.col(c).alias(f"o_{c}") for c in ("ord", "x1", "y1", "x2", "y2")])
    touch = (F.col("ord") < F.col("o_ord")) & (F.col("x1") <= F.col("o_x2")) & (F.col("o_x1") <= F.col("x2")) & (F.col("y1") <= F.col("o_y2")) & (F.col("o_y1") <= F.col("y2"))
    comp = connected_components(spark, laid.join(other, ["grp", "_x", "_y"]).where(touch).select("ord", "o_ord"), "ord", "o_ord")
    out = boxes.join(comp, F.col("ord") == F.col("node"), "left").withColumn("_c", F.coalesce("component", "ord"))
    return out.groupBy("grp", "_c").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum("n").alias("n")).drop("_c")
