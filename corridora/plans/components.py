"""Connected components: star rounds over written tables, or one union-find where the links are few."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .storage import discard, written

#: Links up to which one task joins them.
FEW = 20_000
#: Links of a vertex above which it is a hub; the share of all links keeps hubs to 2 * HUBS at any size.
HUB, HUBS = 1000, 10_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find; the root of a set is its least vertex."""
    root: dict = {}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for v in (a, b):
                root.setdefault(v, v)
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), kind), pa.array([find(v) for v in root], kind)], names=["node", "component"])


def _stored(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, int, object]:
    """The links as a table, their number and the sum of their hashes, all from one job."""
    seen = Observation()
    table = written(spark, edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
    return table, seen.get["n"], seen.get["h"]


def _star(edges: DataFrame, both_ways: bool, links: int) -> DataFrame:
    """Links the neighbours of each vertex to the least of them: all neighbours of both sides, or the smaller ones.

    A vertex's least neighbour comes from a partial aggregate. The few hubs are broadcast with theirs, so that the rows
    of a hub stay where they are; only other vertices' rows meet by vertex.
    """
    half = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        half = half.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = half.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hub = F.col("n") > max(HUB, links // HUBS)
    told = half.join(F.broadcast(least.where(hub).select("u", F.col("m").alias("h"))), "u", "left")
    near = told.where("h is null").drop("h").join(least.where(~hub).drop("n"), "u").unionByName(told.where("h is not null").withColumnRenamed("h", "m"))
    if both_ways:
        out = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(spark: SparkSession, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every vertex of an edge, component being its smallest vertex. Null ends and loops are dropped.

    FEW links at most are one task's work; more go through large-star and small-star rounds, whose number grows with
    the logarithm of the vertices. Links stay (larger, smaller).
    """
    x, y = F.col(a), F.col(b)
    now, links, mark = _stored(spark, edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), (x != y).alias("_d")).where("_d").select("a", "b").distinct())
    if links <= FEW:
        kind = now.schema["a"].dataType.simpleString()
        return now.repartition(1).mapInArrow(_united, f"node {kind}, component {kind}")
    seen = None
    while (links, mark) != seen:
        seen = links, mark
        half, links, _ = _stored(spark, _star(now, True, links))
        new, links, mark = _stored(spark, _star(half, False, links))
        discard(spark, half)
        discard(spark, now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
