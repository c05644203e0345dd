"""Distance joins on integer coordinates, by a grid of cells instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import written


def radius_join(left: DataFrame, right: DataFrame, radius: int, strict: bool = False) -> DataFrame:
    """All pairs (l_id, r_id, d2) of (id, x, y) rows within the radius, ends included unless strict.

    Each point has one cell as wide as the radius; the left side is repeated into the nine cells around its own, so
    the join is an equi-join on the cell, which adaptive execution can split where a cell is crowded.
    """
    cell = lambda c, by=0: (F.floor(F.col(c) / radius) + by).cast("long")
    near = [F.struct(cell("l_x", i).alias("cx"), cell("l_y", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("_c", F.explode(F.array(*near))).select("*", "_c.cx", "_c.cy").drop("_c")
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumns({"cx": cell("r_x"), "cy": cell("r_y")})
    dx, dy = F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y")
    d2 = (dx * dx + dy * dy).cast("long")
    limit = radius * radius
    return l.join(r, ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") < limit if strict else F.col("d2") <= limit).drop("cx", "cy")


def _least(df: DataFrame, by: list[str], order: list[str], k: int, name: str) -> DataFrame:
    """The first k rows of each group, numbered."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def knn_join(left: DataFrame, right: DataFrame, radius: int, k: int) -> DataFrame:
    """(l_id, r_id, d2, rank): the k nearest right rows of each left row within the radius, ties to the smaller id.

    Places meet, not rows: all left rows of a place have the same neighbours, and of a right place only the k smallest
    ids can be among them. So the work grows with the rows and with the places that are near each other, however many
    rows share a place.
    """
    at = left.select("id", "x", "y")
    places = at.select("x", "y").distinct()
    if k == 1:
        pairs = radius_join(places, right.groupBy("x", "y").agg(F.min("id").alias("id")), radius)
        near = pairs.groupBy("l_x", "l_y").agg(F.min(F.struct("d2", "r_id")).alias("b"))
        met = at.join(near.toDF("x", "y", "b"), ["x", "y"])
        return met.groupBy(F.col("id").alias("l_id")).agg(F.min("b").alias("b")).select("l_id", F.col("b.r_id").alias("r_id"), F.col("b.d2").alias("d2"), F.lit(1).alias("rank"))
    pairs = radius_join(places, _least(right.select("id", "x", "y"), ["x", "y"], ["id"], k, "_n").drop("_n"), radius)
    near = _least(pairs, ["l_x", "l_y"], ["d2", "r_id"], k, "_n").select(F.col("l_x").alias("x"), F.col("l_y").alias("y"), "r_id", "d2")
    met = at.withColumnRenamed("id", "l_id").join(near, ["x", "y"])
    return _least(met, ["l_id"], ["d2", "r_id"], k, "rank").select("l_id", "r_id", "d2", "rank")


def without_near(rows: DataFrame, others: DataFrame, radius: int) -> DataFrame:
    """The rows (.., x, y) that have none of the others (x, y) within the radius: again places meet, not rows."""
    met = radius_join(rows.select("x", "y").distinct(), others.select("x", "y").distinct(), radius)
    return rows.join(met.select(F.col("l_x").alias("x"), F.col("l_y").alias("y")).distinct(), ["x", "y"], "left_anti").select(*rows.columns)


def nearest_any(spark: SparkSession, left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id, d2) without a radius, by widening rings of the grid join over the left rows' places: only places still
    without a neighbour go on, as a table, until none is left. Nothing is found where right is empty."""
    corner = F.max(F.greatest(F.abs("x"), F.abs("y")))
    at, radius, out = left.select("id", "x", "y"), 64, None
    todo = at.select("x", "y").distinct()
    reach, span = left.agg(corner).first()[0], right.agg(corner).first()[0]
    if span is None or reach is None:
        return knn_join(left, right, 1, 1).drop("rank")
    heads = right.groupBy("x", "y").agg(F.min("id").alias("id"))
    while True:
        pairs = radius_join(todo, heads, radius)
        got = written(spark, pairs.groupBy(F.col("l_x").alias("x"), F.col("l_y").alias("y")).agg(F.min(F.struct("d2", "r_id")).alias("b")), "nearest")
        out = got if out is None else out.unionByName(got)
        todo = written(spark, todo.join(got.select("x", "y"), ["x", "y"], "left_anti"), "todo")
        if radius > 3 * (span + reach + 1) or todo.isEmpty():
            best = at.join(out, ["x", "y"]).groupBy(F.col("id").alias("l_id")).agg(F.min("b").alias("b"))
            return best.select("l_id", "b.r_id", "b.d2")
        radius *= 4


#: Tasks at least that a crowded place's pairs are dealt to.
SALTS = 16


def of_places(pairs: DataFrame, left: DataFrame, right: DataFrame, at: str) -> DataFrame:
    """The pairs of rows of pairs (l_at, r_at, ..) of places: the columns of left, right and pairs but the places.

    The pairs of rows are not held or shuffled. A place's left rows are dealt by their hash and its right rows repeated,
    so that no place's pairs are one task's work; the number of parts is stated, as the rows are few against their pairs.
    """
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * SALTS)
    near = left.withColumnRenamed(at, "l_at").join(pairs, "l_at").withColumn("_s", F.pmod(F.xxhash64(*[F.col("l_at" if c == at else c) for c in left.columns]), F.lit(SALTS)).cast("int"))
    far = right.withColumnRenamed(at, "r_at").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near, far = near.repartition(n, "r_at", "_s"), far.repartition(n, "r_at", "_s")
    return near.hint("merge").join(far, ["r_at", "_s"]).drop("l_at", "r_at", "_s")


def in_boxes(points: DataFrame, boxes: DataFrame, cell: int = 64, margin: int = 0) -> DataFrame:
    """Points (id, x, y) joined with boxes (box, x1, y1, x2, y2) that hold them, ends included."""
    span = lambda a, b: F.sequence(F.floor((F.col(a) - margin) / cell), F.floor((F.col(b) + margin) / cell))
    b = boxes.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    p = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    x, y = F.col("x"), F.col("y")
    return p.join(b, ["cx", "cy"]).where(x.between(F.col("x1") - margin, F.col("x2") + margin) & y.between(F.col("y1") - margin, F.col("y2") + margin)).drop("cx", "cy")


def lattice_edges(nodes: DataFrame, step: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, src, dst, d2) of lattice nodes that are 8-neighbours, inside each value of `by`: four forward offsets and an equi-join on the place."""
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in ((step, 0), (0, step), (step, step), (step, -step))])
    a = nodes.select(*by, F.col("id").alias("a"), "x", "y", F.explode(offsets).alias("o")).select(*by, "a", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), (F.abs("o.dx") + F.abs("o.dy")).alias("n"))
    pairs = a.join(nodes.select(*by, F.col("id").alias("b"), "x", "y"), [*by, "x", "y"])
    return pairs.select(*by, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.when(F.col("n") == step, step * step).otherwise(2 * step * step).cast("long").alias("d2"))


def dilate(pixels: DataFrame, reach: int = 7) -> DataFrame:
    """Pixels within a square of the given reach, row by row and then column by column (2 * 15 copies, not 225)."""
    around = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_d")
    wide = pixels.select("y", "x", around).select("y", (F.col("x") + F.col("_d")).alias("x")).distinct()
    return wide.select("y", "x", around).select((F.col("y") + F.col("_d")).alias("y"), "x").distinct()
