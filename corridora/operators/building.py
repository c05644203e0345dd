"""Building and editing of graphs: nodes, edges, doors, manual edits, attachments without a radius, keep sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spatial import dilate, in_boxes, nearest_any
from .stats import numbered

#: Node types, and door classes in the order in which they become nodes.
TYPES = ["room", "door", "corridor", "outside", "transition"]
DOOR_CLASSES = ["exit", "c2c", "r2c", "r2r"]

#: Pixels that lie between two floors in a search for the nearest node of the same floor; more than an image has.
FLOORS_APART = 1 << 24


def subnode(id: Column) -> Column:
    return id.contains("_subnode_")


def main_room(type: Column, id: Column, flag: Column | None = None) -> Column:
    """A room that is no subnode, by its flag or its id."""
    return (type == "room") & ~subnode(id) & ~F.coalesce(flag if flag is not None else F.lit(False), F.lit(False))


def parent_room(id: Column, attribute: Column) -> Column:
    """The room of a subnode: its attribute, or else what stands before `_subnode_`; null for other nodes."""
    return F.when(subnode(id) | attribute.isNotNull(), F.coalesce(attribute, F.split_part(id, F.lit("_subnode_"), F.lit(1))))


def add_nodes(nodes: DataFrame, default_floor: str) -> DataFrame:
    """(id, ord, type, floor, x, y, times) of additions (seq, id, type, floor, x, y): the last addition's values at the
    first one's place; outside nodes have the floor NA, others without a floor the default. An unknown type is an error."""
    known = F.when(F.col("type").isin(TYPES), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown node type "), F.coalesce("type", F.lit("null")))))
    last = lambda c: F.max_by(c, "seq")
    out = nodes.withColumn("type", known.cast("string")).groupBy("id").agg(F.min("seq").alias("ord"), *[last(c).alias(c) for c in ("type", "floor", "x", "y")], F.count("*").alias("times"))
    return out.withColumn("floor", F.when(F.col("type") == "outside", "NA").otherwise(F.coalesce("floor", F.lit(default_floor))))


def add_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, distance, weight) of additions (seq, src, dst, weight, distance): those with an end that is no node are
    left out, the last of a pair stays, the distance is measured where it is missing, and stands for a missing weight."""
    at = nodes.select("id", "x", "y")
    a, b = at.toDF("src", "ax", "ay"), at.toDF("dst", "bx", "by")
    measured = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    both = edges.join(a, "src").join(b, "dst").withColumn("distance", F.coalesce("distance", measured))
    pair = both.select("seq", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "distance", F.coalesce("weight", "distance", F.lit(1.0)).alias("weight"))
    last = pair.groupBy("src", "dst").agg(F.max_by(F.struct("distance", "weight"), "seq").alias("e"))
    return last.select("src", "dst", "e.distance", "e.weight")


def missing_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, missing): the warning rows of add_edges."""
    ends = edges.select("seq", F.explode(F.array("src", "dst")).alias("missing"))
    return ends.join(nodes.select(F.col("id").alias("missing")), "missing", "left_anti").select("seq", "missing")


def fill_weights(edges: DataFrame) -> DataFrame:
    """Missing weights become the distance, or 1; a weight of 1 stays."""
    return edges.withColumn("weight", F.coalesce("weight", "distance", F.lit(1.0)))


def door_nodes(doors: DataFrame) -> DataFrame:
    """(building, ord, id, x, y) of classified boxes (building, seq, door_class, x1, y1, x2, y2): numbered inside their
    class from 1, in the order of the classes; wardrobe doors are no nodes. Centres are floored."""
    some = doors.where(F.col("door_class").isin(DOOR_CLASSES)).withColumn("_c", F.array_position(F.array(*map(F.lit, DOOR_CLASSES)), F.col("door_class")))
    mine, all_ = Window.partitionBy("building", "door_class").orderBy("seq"), Window.partitionBy("building").orderBy("_c", "seq")
    half = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    return some.select("building", F.row_number().over(all_).cast("long").alias("ord"), F.concat("door_class", F.lit("_door_"), F.row_number().over(mine)).alias("id"), half("x1", "x2").alias("x"), half("y1", "y2").alias("y"))


def family_to_corridor(spark: SparkSession, family: DataFrame, corridors: DataFrame) -> DataFrame:
    """(room, id, corridor, d2): per room (room, id, floor, x, y) the pair of a family node and a corridor node (id, floor,
    x, y) that are nearest, on one floor if there is such a pair, and over all floors for rooms without one."""

    def best(rows: DataFrame, apart: int) -> DataFrame:
        placed = lambda d: d.select("id", "x", (F.col("y") + F.col("floor") * apart).alias("y"))
        near = nearest_any(spark, placed(rows), placed(corridors))
        pairs = rows.select("room", "id").join(near, F.col("id") == F.col("l_id"))
        return pairs.groupBy("room").agg(F.min(F.struct("d2", "id", F.col("r_id").alias("corridor"))).alias("b"))

    own = best(family.join(corridors.select("floor").distinct(), "floor", "left_semi"), FLOORS_APART)
    rest = best(family.join(own.select("room"), "room", "left_anti"), 0)
    return own.unionByName(rest).select("room", "b.id", "b.corridor", "b.d2")


def centroid_to_corridor(spark: SparkSession, family: DataFrame, corridors: DataFrame) -> DataFrame:
    """(room, corridor, d2): the corridor node nearest to the middle of each room's nodes (doubled coordinates cut to integers), on any floor."""
    middle = family.groupBy("room").agg(F.avg("x").cast("long").alias("x"), F.avg("y").cast("long").alias("y")).select(F.col("room").alias("id"), "x", "y")
    return nearest_any(spark, middle, corridors).select(F.col("l_id").alias("room"), F.col("r_id").alias("corridor"), "d2")


def reattach_transitions(spark: SparkSession, transitions: DataFrame, corridors: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, corridor, d2): the nearest corridor of each transition without an edge (src, dst) to a corridor."""
    ends = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("id", "corridor")
    beside = ends.join(corridors.select(F.col("id").alias("corridor")), "corridor", "left_semi").select("id").distinct()
    alone = transitions.join(beside, "id", "left_anti")
    return nearest_any(spark, alone, corridors).select(F.col("l_id").alias("id"), F.col("r_id").alias("corridor"), "d2")


def kept_graph(nodes: DataFrame, edges: DataFrame, keep_nodes: list[DataFrame], keep_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept nodes, removed nodes, kept edges): the union of the keep sets (id), the others, and the edges in the keep set
    (src, dst) with both ends kept; an edge's ends are in the order of their names."""
    keep = keep_nodes[0].select("id")
    for k in keep_nodes[1:]:
        keep = keep.union(k.select("id"))
    keep = keep.distinct().join(nodes.select("id"), "id", "left_semi")
    in_order = lambda e: e.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    stay = in_order(edges).join(in_order(keep_edges).select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    for end in ("src", "dst"):
        stay = stay.join(keep.withColumnRenamed("id", end), end, "left_semi")
    return keep, nodes.select("id").subtract(keep), stay


def edited(nodes: DataFrame, edges: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst) after edits (seq, op, a, b): add_node a, delete_node a with its edges, add_edge and
    delete_edge a b. Loops, edges to nodes that do not stand and edges that are there are not added. The last edit of a
    node, and of a pair, decides; an edge stands if it is younger than the last deletion of either end."""
    base = lambda df: df.withColumn("seq", F.lit(-1).cast("long"))
    of_nodes = edits.where("op IN ('add_node', 'delete_node')").select(F.col("a").alias("id"), "seq", (F.col("op") == "add_node").alias("stays"))
    of_nodes = of_nodes.unionByName(base(nodes.select("id")).withColumn("stays", F.lit(True)))
    state = of_nodes.groupBy("id").agg(F.max_by("stays", "seq").alias("stays"), F.max(F.when(~F.col("stays"), F.col("seq"))).alias("gone"), F.min(F.when(F.col("stays"), F.col("seq"))).alias("born"))
    pair = [F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")]
    of_edges = edits.where("op IN ('add_edge', 'delete_edge') AND a <> b").select(*pair, "seq", (F.col("op") == "add_edge").alias("stays"))
    of_edges = of_edges.unionByName(base(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).select(*pair)).withColumn("stays", F.lit(True)))
    # an addition counts if both ends stood then: the last event of each end before it was no deletion
    # by one pass over the events and additions of each node, in order, events first
    ends = of_edges
    for end in ("src", "dst"):
        events = of_nodes.select(F.col("id").alias(end), "seq", F.lit(0).alias("_e"), F.col("stays").alias("_f"))
        before = Window.partitionBy(end).orderBy("seq", "_e").rowsBetween(Window.unboundedPreceding, 0)
        both = ends.withColumn("_e", F.lit(1)).unionByName(events, allowMissingColumns=True)
        ends = both.withColumn(f"_{end}", F.last("_f", ignorenulls=True).over(before)).where("_e = 1").drop("_e", "_f")
    live = ends.where(~F.col("stays") | (F.coalesce("_src", F.lit(False)) & F.coalesce("_dst", F.lit(False))))
    last = live.groupBy("src", "dst").agg(F.max_by(F.struct("stays", "seq"), "seq").alias("e")).select("src", "dst", "e.stays", "e.seq").where("stays")
    for end in ("src", "dst"):
        last = last.join(state.select(F.col("id").alias(end), F.col("stays").alias("_ok"), "gone"), end).where("_ok AND (gone IS NULL OR seq > gone)").drop("_ok", "gone")
    return state.where("stays").select("id"), last.select("src", "dst")


def offenders(isolated: DataFrame, rooms_out: DataFrame, exits_out: DataFrame) -> DataFrame:
    """(id, reason): a node once, for the first of isolated, room, exit."""
    parts = [df.select("id", F.lit(reason).alias("reason"), F.lit(i).alias("p")) for i, (reason, df) in enumerate((("isolated", isolated), ("room", rooms_out), ("exit", exits_out)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id").agg(F.min_by("reason", "p").alias("reason"))


def route_stats(steps: DataFrame) -> DataFrame:
    """(route, distance, segments, nodes, types, cross_floor) of steps (route, step, type, floor, weight): the weight is of
    the edge to the step, null at the start; weights that are not finite and positive count as 1."""
    w = F.col("weight")
    fair = F.when(F.col("step") == 0, 0.0).when(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")), w).otherwise(1.0)
    return steps.groupBy("route").agg(F.sum(fair).alias("distance"), (F.count("*") - 1).alias("segments"), F.count("*").alias("nodes"), F.count_distinct("type").alias("types"), (F.count_distinct("floor") > 1).alias("cross_floor"))


def relinked(mains: DataFrame, subnodes: DataFrame, doors: DataFrame, radius: int) -> DataFrame:
    """(src, dst, d2): in rooms (id, x, y) with a door (room) to a corridor, all subnodes (room, id, x, y) within the radius of the main node, after pruning."""
    with_door = mains.join(doors.select(F.col("room").alias("id")).distinct(), "id", "left_semi")
    d2 = ((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2).cast("long")
    pairs = subnodes.join(with_door.select(F.col("id").alias("room"), F.col("x").alias("rx"), F.col("y").alias("ry")), "room").withColumn("d2", d2)
    return pairs.where(F.col("d2") <= radius * radius).select(F.least("room", "id").alias("src"), F.greatest("room", "id").alias("dst"), "d2")


def lattice_nodes(spark: SparkSession, ground: DataFrame, walls: DataFrame, step: int, reach: int, prefix: str) -> DataFrame:
    """(id, y, x): places of the ground (y, x) on a lattice, outside the walls (y, x) grown by `reach`, numbered row by row."""
    places = ground.where((F.pmod("y", F.lit(step)) == 0) & (F.pmod("x", F.lit(step)) == 0)).select("y", "x").distinct()
    free = places.join(dilate(walls, reach), ["y", "x"], "left_anti")
    return numbered(spark, free, ["y", "x"], "n").select(F.concat(F.lit(prefix), "n").alias("id"), "y", "x")


def doors_of_rooms(interior: DataFrame, boxes: DataFrame, doors: DataFrame) -> DataFrame:
    """(room, id): doors (id, x, y) of rooms by their interiors (room, y, x): those on the centre of a box (box, x1, y1, x2,
    y2) that holds a pixel of the room, or else all doors inside that box."""
    touched = in_boxes(interior, boxes).select("room", "box").distinct()
    centre = boxes.select("box", F.floor((F.col("x1") + F.col("x2")) / 2).alias("x"), F.floor((F.col("y1") + F.col("y2")) / 2).alias("y"))
    exact = centre.join(doors, ["x", "y"]).select("box", "id")
    inside = in_boxes(doors, boxes.join(exact, "box", "left_anti")).select("box", "id")
    return touched.join(exact.unionByName(inside), "box").select("room", "id").distinct()


def anchors(rooms: DataFrame, found: DataFrame, doors: DataFrame) -> DataFrame:
    """(room, anchor, d2): the nearest of each room's (id, x, y) own doors (room, id) that lead to a corridor (id, subtype, x, y)."""
    own = found.join(doors.where("subtype = 'r2c'").select("id", F.col("x").alias("dx"), F.col("y").alias("dy")), "id")
    d2 = ((F.col("x") - F.col("dx")) ** 2 + (F.col("y") - F.col("dy")) ** 2).cast("long")
    pairs = own.join(rooms.select(F.col("id").alias("room"), "x", "y"), "room").withColumn("d2", d2)
    return pairs.groupBy("room").agg(F.min(F.struct("d2", "id")).alias("b")).select("room", F.col("b.id").alias("anchor"), "b.d2")
