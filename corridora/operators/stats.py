"""Counts, reductions, connectivity and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import written


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def floor_matrix(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Nodes by floor and type, zero-filled; rows without a floor are left out."""
    return nodes.where("floor is not null").groupBy("floor").pivot("type", types).count().na.fill(0)


def reduction(nodes: DataFrame, key: str, stays: Column) -> DataFrame:
    """Rows before and after, and the share that went, in per cent with two digits."""
    pre, post = F.count("*"), F.count(F.when(stays, 1))
    return nodes.groupBy(key).agg(pre.alias("pre"), post.alias("post"), F.when(pre == 0, F.lit(0.0)).otherwise(F.round((1 - post.cast("double") / pre) * 100, 2)).alias("reduction"))


def first_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group, numbered in column n."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("n") <= n)


def numbered(spark: SparkSession, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A running number over all rows, from 1: rows are dealt by ranges of the whole order and sorted there, a place in its
    range and the number of rows in the ranges before (one row for each range) make a row's number."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())
    dealt = written(spark, dealt, "numbered").withColumn("_p", F.shiftright("_i", 33))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    place = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_o") + 1
    return dealt.join(F.broadcast(offsets), "_p").withColumn(name, place).drop("_p", "_i", "_o")


def connectivity_score(members: DataFrame) -> DataFrame:
    """(score, isolated, rooms_out, exits_out, n_components) over (id, comp, room, exit): whether a node is a main room or
    an exit door. The network is the component with the most main rooms, the first of equals; nodes alone in their
    component are isolated. An empty graph has score 100."""
    yes = lambda c: F.sum(F.col(c).cast("long"))
    comps = members.groupBy("comp").agg(F.count("*").alias("n"), yes("room").alias("rooms"), yes("exit").alias("exits"))
    alone, out = F.col("n") == 1, (F.col("n") > 1) & ~F.col("main")
    top = comps.agg(F.max(F.struct(F.col("rooms").alias("r"), (-F.col("comp")).alias("c"))).alias("top"))
    judged = comps.join(F.broadcast(top)).withColumn("main", -F.col("comp") == F.col("top.c"))
    add = lambda when, value: F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long")
    got = judged.agg(
        add(alone, 1).alias("isolated"), add(out, F.col("rooms")).alias("rooms_out"), add(out, F.col("exits")).alias("exits_out"),
        add(F.lit(True), F.when(alone, 1).otherwise(F.col("rooms") + F.col("exits"))).alias("tracked"), F.count("*").alias("n_components"),
    )
    bad = F.col("isolated") + F.col("rooms_out") + F.col("exits_out")
    score = F.when(F.col("tracked") == 0, 100).otherwise(F.floor(F.lit(100.0) * (F.col("tracked") - bad) / F.nullif("tracked", F.lit(0)) + 0.5))
    return got.select(score.cast("long").alias("score"), "isolated", "rooms_out", "exits_out", "n_components")


def backfill_weights(edges: DataFrame) -> DataFrame:
    """Weights that are missing or 1 become the distance."""
    return edges.withColumn("weight", F.when(F.col("weight").isNull() | (F.col("weight") == 1), F.col("distance")).otherwise(F.col("weight")))


def pre_post(pre: DataFrame, post: DataFrame, timed: DataFrame) -> DataFrame:
    """(floor, pre_nodes, post_nodes, reduction) of nodes before and after pruning; a count (floor, timed) goes before the one of `pre`."""
    a = pre.groupBy("floor").agg(F.count("*").alias("_n")).join(timed, "floor", "left").select("floor", F.coalesce("timed", "_n").alias("pre_nodes"))
    b = post.groupBy("floor").agg(F.count("*").alias("post_nodes"))
    both = a.join(b, "floor", "left").na.fill(0, ["post_nodes"])
    share = (1 - F.col("post_nodes") / F.nullif(F.col("pre_nodes").cast("double"), F.lit(0.0))) * 100
    return both.withColumn("reduction", F.coalesce(F.round(share, 2), F.lit(0.0)))
