"""Several floors: mapping checks, merge, links between floors, and the view model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .stats import numbered


def mapping_issues(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """(level, code, detail). The strict rules allow one link for an ordered pair of floors, and only warn of a gap."""
    good, issue = parsed.where("ok"), lambda level, code, detail: [F.lit(level).alias("level"), F.lit(code).alias("code"), detail.alias("detail")]
    line = F.col("line_no").cast("string")
    gap = F.abs(F.col("tgt_floor") - F.col("src_floor"))
    images = good.select(F.col("src_image").alias("img"), F.col("src_floor").alias("f")).union(good.select("tgt_image", "tgt_floor")).distinct()
    out = [parsed.where("not ok").select(*issue("error", "malformed", line))]
    if strict:
        out.append(good.where(gap == 0).select(*issue("error", "same_floor", line)))
        out.append(good.where(gap > 1).select(*issue("warning", "floor_gap", line)))
        pairs = good.groupBy("src_floor", "tgt_floor").count().where("count > 1")
        out.append(pairs.select(*issue("error", "one_to_one", F.concat_ws("-", "src_floor", "tgt_floor"))))
        named = images.groupBy("img").agg(F.collect_set("f").alias("fs"))
        out.append(named.where(~F.array_contains("fs", T.floor_v1(F.col("img")).cast("long"))).select(*issue("warning", "floor_name", F.col("img"))))
    else:
        out.append(good.where(gap != 1).select(*issue("error", "floor_gap", line)))
        low, high = F.least("src_floor", "tgt_floor"), F.greatest("src_floor", "tgt_floor")
        pairs = good.groupBy(low.alias("lo"), high.alias("hi"), "src_node").count().where("count > 1")
        out.append(pairs.select(*issue("error", "one_to_one", F.concat(F.concat_ws("-", "lo", "hi"), F.lit(":"), "src_node"))))
        out.append(images.where(F.col("f") != T.floor_v2(F.col("img"))).select(*issue("warning", "floor_name", F.concat("img", F.lit(":"), "f"))))
    return reduce(DataFrame.unionByName, out)


def mapping_summary(parsed: DataFrame) -> DataFrame:
    good = parsed.where("ok")
    ends = good.select(F.explode(F.array(F.struct(F.col("src_image").alias("i"), F.col("src_floor").alias("f"), F.lit(1).alias("n")), F.struct(F.col("tgt_image").alias("i"), F.col("tgt_floor").alias("f"), F.lit(0).alias("n")))).alias("e"))
    return ends.agg(F.sum("e.n").cast("long").alias("mappings"), F.count_distinct("e.i").alias("images"), F.count_distinct("e.f").alias("floors"))


def sequence_names(named: DataFrame) -> DataFrame:
    """(building, name): the distinct floors in order, by their codes."""
    per = named.groupBy("building").agg(F.array_sort(F.collect_set("floor")).alias("fs"))
    return per.select("building", F.array_join(F.transform("fs", T.floor_name), "_").alias("name"))


def merge_floors(parts: list[DataFrame]) -> DataFrame:
    """Nodes of all floors, with their floor in front of their id; a part may name the image that it comes from."""
    image = lambda p: (F.col("source_image") if "source_image" in p.columns else F.lit(None).cast("string")).alias("source_image")
    out = [p.select(F.concat(F.col("floor").cast("string"), F.lit("_"), "id").alias("id"), F.col("id").alias("original_id"), "type", "floor", "x", "y", image(p)) for p in parts]
    return reduce(DataFrame.unionByName, out)


def inter_floor_edges(links: DataFrame, merged: DataFrame, cost: float = 1.0) -> DataFrame:
    """Edges of links (src_floor, src_image, src_node, tgt_floor, tgt_image, tgt_node) between merged nodes (id,
    original_id, floor, source_image); the cost is explicit. An end is found by image and node, or else by the id
    <floor>_<node>; links with an end that is not there give a row with `missing`, which names that end, and no ids."""
    ids = merged.select("id", F.col("original_id").alias("_node"), F.col("source_image").alias("_image"))

    def end(df: DataFrame, side: str, out: str) -> DataFrame:
        named = ids.select(F.col("id").alias("_a"), F.col("_node").alias(f"{side}_node"), F.col("_image").alias(f"{side}_image"))
        plain = merged.select(F.col("id").alias("_b"))
        guess = F.concat(F.col(f"{side}_floor").cast("string"), F.lit("_"), f"{side}_node")
        both = df.join(named, [f"{side}_node", f"{side}_image"], "left").join(plain, F.col("_b") == guess, "left")
        return both.withColumn(out, F.coalesce("_a", "_b")).drop("_a", "_b")

    both = end(end(links, "src", "src"), "tgt", "dst")
    lost = F.when(F.col("src").isNull(), F.col("src_node")).when(F.col("dst").isNull(), F.col("tgt_node"))
    ok = lambda c: F.when(lost.isNull(), F.col(c)).alias(c)
    return both.select(ok("src"), ok("dst"), "src_floor", "tgt_floor", F.lit("inter_floor").alias("edge_type"), F.lit(cost).alias("weight"), lost.alias("missing"))


def alignment(t: DataFrame, width: int, height: int, tolerance: float) -> DataFrame:
    """Normalised offsets of links (id, floor, c) of one chain c on neighbouring floors."""
    n = t.select("id", "floor", "c", F.when(F.lit(width > 0), F.col("x") / width).otherwise(0).alias("nx"), F.when(F.lit(height > 0), F.col("y") / height).otherwise(0).alias("ny"))
    a, b = n.toDF("a", "floor", "c", "ax", "ay"), n.select(F.col("id").alias("b"), (F.col("floor") - 1).alias("floor"), "c", F.col("nx").alias("bx"), F.col("ny").alias("by"))
    dx, dy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
    return a.join(b, ["floor", "c"]).select("a", "b", F.round(dx, 4).alias("dx"), F.round(dy, 4).alias("dy"), ((dx <= tolerance) & (dy <= tolerance)).alias("aligned"))


def view_nodes(nodes: DataFrame) -> DataFrame:
    kind = F.when(F.col("type") == "transition", "floor_transition").otherwise(F.coalesce("type", F.lit("unknown")))
    return nodes.select("id", F.col("id").alias("label"), kind.alias("type"), F.coalesce(F.col("floor").cast("string"), F.lit("")).alias("floor"))


def edge_color(a, b):
    """Transition, outside, corridor, room: the first that an end has."""
    out = F.when((a == "floor_transition") | (b == "floor_transition"), "transition")
    for t in ("outside", "corridor", "room"):
        out = out.when((a == t) | (b == t), t)
    return out.otherwise("default")


def view_edges(spark: SparkSession, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (s, t) in order, with ids e<place>_<source>_<target> and colours."""
    types = nodes.select("id", "type")
    n = numbered(spark, edges, ["s", "t"], "n")
    e = n.join(types.toDF("s", "a"), "s").join(types.toDF("t", "b"), "t")
    return e.select(F.concat(F.lit("e"), (F.col("n") - 1).cast("string"), F.lit("_"), "s", F.lit("_"), "t").alias("id"), F.col("s").alias("source"), F.col("t").alias("target"), edge_color(F.col("a"), F.col("b")).alias("color"))


def visible_edges(edges: DataFrame, nodes: DataFrame, hidden: list[str], keep: list[str]) -> DataFrame:
    shown = nodes.where(~F.col("type").isin(hidden) | F.col("id").isin(keep)).select("id")
    return edges.join(shown.toDF("s"), "s", "left_semi").join(shown.toDF("t"), "t", "left_semi").select("s", "t")


def route_endpoints(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Rooms and links between floors, without subnodes, by type and natural label."""
    some = nodes.where(F.col("type").isin("room", "floor_transition") & ~F.col("id").contains("_subnode_"))
    prefix, number = F.regexp_extract("label", r"^([^0-9]*)", 1), F.regexp_extract("label", r"([0-9]+)", 1).try_cast("long")
    return numbered(spark, some.withColumns({"_a": prefix, "_k": number}), ["type", "_a", "_k", "label"], "place").select("id", "type", F.col("place").cast("long").alias("place"))
