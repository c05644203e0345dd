"""All registered queries of the navigation-graph engine, and the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import floors, paths, raster, spatial, stats
from .plans.components import connected_components
from .plans.storage import written
from .sources import readers
from .sources.views import ctes, view
from .streaming import stages

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _knn_sql(left: str, right: str, radius: int, k: int) -> str:
    """Nearest rows by nested loop: what the grid join must equal."""
    return f"""SELECT l_id, r_id, d2, CAST(rank AS INTEGER) AS rank FROM (
      SELECT l.id AS l_id, r.id AS r_id, CAST((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y) AS BIGINT) AS d2,
             row_number() OVER (PARTITION BY l.id ORDER BY (l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y), r.id) AS rank
      FROM ({left}) l JOIN ({right}) r ON (l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y) <= {radius * radius}) q WHERE rank <= {k}"""


# ---- attachment of nodes within a radius


@query(ctes("v_doors", "v_lattice") + _knn_sql("SELECT * FROM v_doors WHERE subtype = 'r2c'", "SELECT * FROM v_lattice", 100, 1))
def r2c_door_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.knn_join(view(spark, sf, "v_doors").where("subtype = 'r2c'"), view(spark, sf, "v_lattice"), 100, 1)


@query(ctes("v_halls", "v_lattice") + _knn_sql("SELECT * FROM v_halls", "SELECT * FROM v_lattice", 200, 4))
def hall_knn4(spark, sf):
    return spatial.knn_join(view(spark, sf, "v_halls"), view(spark, sf, "v_lattice"), 200, 4)


@query(ctes("v_doors", "v_lattice") + _knn_sql("SELECT * FROM v_doors WHERE subtype = 'c2c'", "SELECT * FROM v_lattice", 100, 4))
def c2c_knn4(spark, sf):
    return spatial.knn_join(view(spark, sf, "v_doors").where("subtype = 'c2c'"), view(spark, sf, "v_lattice"), 100, 4)


@query(ctes("v_doors", "v_lattice", "v_outside") + f"SELECT 'corridor' AS side, * FROM ({_knn_sql('''SELECT * FROM v_doors WHERE subtype = 'exit' ''', 'SELECT * FROM v_lattice', 100, 1)}) a UNION ALL SELECT 'outside' AS side, * FROM ({_knn_sql('''SELECT * FROM v_doors WHERE subtype = 'exit' ''', 'SELECT * FROM v_outside', 100, 1)}) b")
def exit_door_dual_attach(spark, sf):
    doors = view(spark, sf, "v_doors").where("subtype = 'exit'")
    both = [spatial.knn_join(doors, view(spark, sf, v), 100, 1).withColumn("side", F.lit(s)) for s, v in (("corridor", "v_lattice"), ("outside", "v_outside"))]
    return both[0].unionByName(both[1])


_ISOLATED = "SELECT * FROM {v} v WHERE NOT EXISTS (SELECT 1 FROM v_doors d WHERE d.subtype = 'r2c' AND (d.x-v.x)*(d.x-v.x)+(d.y-v.y)*(d.y-v.y) <= 1600)"


def _isolated(spark, sf, name):
    """Rows without an edge to a door within 40."""
    return spatial.without_near(view(spark, sf, name), view(spark, sf, "v_doors").where("subtype = 'r2c'"), 40)


@query(ctes("v_rooms", "v_doors", "v_lattice") + _knn_sql(_ISOLATED.format(v="v_rooms"), "SELECT * FROM v_lattice", 400, 1))
def isolated_room_attach(spark, sf):
    return spatial.knn_join(_isolated(spark, sf, "v_rooms"), view(spark, sf, "v_lattice"), 400, 1)


@query(ctes("v_transitions", "v_doors", "v_lattice") + _knn_sql(_ISOLATED.format(v="v_transitions"), "SELECT * FROM v_lattice", 400, 1))
def transition_attach(spark, sf):
    return spatial.knn_join(_isolated(spark, sf, "v_transitions"), view(spark, sf, "v_lattice"), 400, 1)


@query(ctes("v_transitions", "v_lattice") + """SELECT l_id, r_id, d2 FROM (SELECT l.id AS l_id, r.id AS r_id, CAST((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y) AS BIGINT) AS d2,
  row_number() OVER (PARTITION BY l.id ORDER BY (l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y), r.id) AS k FROM v_transitions l, v_lattice r) q WHERE k = 1""")
def transition_nearest_any(spark, sf):
    return spatial.nearest_any(spark, view(spark, sf, "v_transitions"), view(spark, sf, "v_lattice"))


# ---- merging and components


_PAIRS = "SELECT a.k AS a, b.k AS b, CAST((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS BIGINT) AS d2 FROM v_rooms a JOIN v_rooms b ON a.k < b.k AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 2500"


def _merge_pairs(spark, sf):
    r = view(spark, sf, "v_rooms").select("id", "x", "y", "k")
    return spatial.radius_join(r, r, 50, strict=True).where("l_k < r_k").select(F.col("l_k").alias("a"), F.col("r_k").alias("b"), "d2")


def _room_components(spark, sf):
    """Each room with the first room of its cluster. Rooms of one place are in one cluster, so places are linked, each by
    the first of its rooms."""
    rooms = view(spark, sf, "v_rooms")
    heads = rooms.groupBy("x", "y").agg(F.min("k").alias("k"))
    near = spatial.radius_join(heads, heads, 50, strict=True).where("l_k < r_k").select(F.col("l_k").alias("a"), F.col("r_k").alias("b"))
    comp = connected_components(spark, near, "a", "b").withColumnRenamed("node", "k")
    first = heads.join(comp, "k", "left").select("x", "y", F.coalesce("component", "k").alias("comp"))
    return rooms.join(first, ["x", "y"], "left").select(*rooms.columns, "comp")


_COMPS = ctes("v_rooms").replace("WITH ", "WITH RECURSIVE ") + f""", pairs AS ({_PAIRS}), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
 reach(n, c) AS (SELECT k, k FROM v_rooms UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.n),
 comps AS (SELECT v_rooms.*, m.comp FROM v_rooms JOIN (SELECT n, min(c) AS comp FROM reach GROUP BY n) m ON m.n = v_rooms.k) """


@query(ctes("v_rooms") + _PAIRS)
def merge_pairs(spark, sf):
    return _merge_pairs(spark, sf)


@query(_COMPS + "SELECT concat('room_', comp) AS id, CAST(trunc(avg(x)) AS BIGINT) AS x, CAST(trunc(avg(y)) AS BIGINT) AS y, count(*) AS members FROM comps GROUP BY comp")
def merge_clusters(spark, sf):
    """Clusters keep the id of their first member; centres are cut to integers."""
    return _room_components(spark, sf).groupBy("comp").agg(F.avg("x").cast("long").alias("x"), F.avg("y").cast("long").alias("y"), F.count("*").alias("members")).select(F.concat(F.lit("room_"), "comp").alias("id"), "x", "y", "members")


@query(_COMPS + "SELECT id, comp FROM comps")
def components(spark, sf):
    return _room_components(spark, sf).select("id", "comp")


@query(_COMPS + "SELECT comp, count(*) AS nodes, count(DISTINCT floor) AS floors, min(floor) AS low, max(floor) AS high FROM comps GROUP BY comp")
def component_floors(spark, sf):
    return _room_components(spark, sf).groupBy("comp").agg(F.count("*").alias("nodes"), F.count_distinct("floor").alias("floors"), F.min("floor").alias("low"), F.max("floor").alias("high"))


@query(_COMPS + """, kinds AS (SELECT comp, count(*) AS n, count(*) FILTER (k % 4 <> 0) AS rooms, count(*) FILTER (k % 8 = 0) AS exits FROM comps GROUP BY comp),
 judged AS (SELECT *, comp = (SELECT comp FROM kinds ORDER BY rooms DESC, comp LIMIT 1) AS main FROM kinds),
 c AS (SELECT coalesce(sum(CASE WHEN n = 1 THEN 1 END), 0) AS isolated, coalesce(sum(CASE WHEN n > 1 AND NOT main THEN rooms END), 0) AS rooms_out, coalesce(sum(CASE WHEN n > 1 AND NOT main THEN exits END), 0) AS exits_out,
  coalesce(sum(CASE WHEN n = 1 THEN 1 ELSE rooms + exits END), 0) AS tracked, count(*) AS n_components FROM judged)
 SELECT CAST(CASE WHEN tracked = 0 THEN 100 ELSE floor(100.0 * (tracked - isolated - rooms_out - exits_out) / tracked + 0.5) END AS BIGINT) AS score, CAST(isolated AS BIGINT) AS isolated, CAST(rooms_out AS BIGINT) AS rooms_out, CAST(exits_out AS BIGINT) AS exits_out, n_components FROM c""")
def connectivity_score(spark, sf):
    """Nodes with k % 4 of 0 stand for other nodes, half of them for exits."""
    return stats.connectivity_score(_room_components(spark, sf).select("id", "comp", (F.col("k") % 4 != 0).alias("room"), (F.col("k") % 8 == 0).alias("exit")))


@query(_COMPS + """, r AS (SELECT *, row_number() OVER (PARTITION BY floor ORDER BY k) AS n FROM comps)
 SELECT a.floor AS src_floor, b.floor AS tgt_floor, CAST(avg(CASE WHEN a.comp = b.comp THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS ratio FROM r a JOIN r b ON a.floor <> b.floor AND a.n <= 5 AND b.n <= 5 GROUP BY a.floor, b.floor
 UNION ALL SELECT a.floor, a.floor, max(CASE WHEN a.n < b.n AND a.comp = b.comp THEN 1.0 ELSE 0.0 END) FROM r a JOIN r b ON a.floor = b.floor AND a.n <= 10 AND b.n <= 10 GROUP BY a.floor""")
def connectivity_matrix(spark, sf):
    """Share of connected pairs of the first five rooms of two floors; for a floor with itself, 1 if any two of its first ten are connected."""
    r = stats.first_n(_room_components(spark, sf).select("floor", "k", "comp"), "floor", "k", 10)
    a, b = (r.where("n <= 5").select(F.col("floor").alias(f"{p}_floor"), F.col("comp").alias(f"{p}_comp")) for p in ("src", "tgt"))
    across = a.join(F.broadcast(b), F.col("src_floor") != F.col("tgt_floor")).groupBy("src_floor", "tgt_floor").agg(F.avg((F.col("src_comp") == F.col("tgt_comp")).cast("double")).alias("ratio"))
    own = r.groupBy("floor").agg((F.count("*") > F.count_distinct("comp")).cast("double").alias("ratio"))
    return across.unionByName(own.select(F.col("floor").alias("src_floor"), F.col("floor").alias("tgt_floor"), "ratio"))


@query(_COMPS + """, r AS (SELECT *, row_number() OVER (PARTITION BY floor ORDER BY k) AS n FROM comps)
 SELECT a.floor, a.id AS a, b.id AS b, a.comp = b.comp AS connected FROM r a JOIN r b ON a.floor = b.floor AND a.n <= 5 AND b.n <= 6 AND a.n < b.n""")
def sample_pairs_within(spark, sf):
    r = stats.first_n(_room_components(spark, sf).select("floor", "k", "id", "comp"), "floor", "k", 6)
    a, b = (r.select("floor", F.col("id").alias(p), F.col("n").alias(f"{p}n"), F.col("comp").alias(f"{p}c")) for p in "ab")
    return a.where("an <= 5").join(b, "floor").where("an < bn").select("floor", "a", "b", (F.col("ac") == F.col("bc")).alias("connected"))


@query(_COMPS + """, r AS (SELECT *, row_number() OVER (PARTITION BY floor ORDER BY k) AS n FROM comps)
 SELECT a.floor AS src_floor, b.floor AS tgt_floor, a.id AS a, b.id AS b, a.comp = b.comp AS connected FROM r a JOIN r b ON a.floor < b.floor AND a.n <= 3 AND b.n <= 3""")
def sample_pairs_cross(spark, sf):
    r = stats.first_n(_room_components(spark, sf).select("floor", "k", "id", "comp"), "floor", "k", 3)
    a, b = (r.select(F.col("floor").alias(f"{p}f"), F.col("id").alias(p), F.col("comp").alias(f"{p}c")) for p in "ab")
    return a.join(F.broadcast(b), F.col("af") < F.col("bf")).select(F.col("af").alias("src_floor"), F.col("bf").alias("tgt_floor"), "a", "b", (F.col("ac") == F.col("bc")).alias("connected"))


# ---- lattice, rooms and doors


_EDGES = "SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, CAST((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS BIGINT) AS d2 FROM v_lattice a JOIN v_lattice b ON a.k < b.k AND abs(a.x-b.x) <= 20 AND abs(a.y-b.y) <= 20"


@query(ctes("v_lattice") + _EDGES)
def lattice_edges8(spark, sf):
    return spatial.lattice_edges(view(spark, sf, "v_lattice"))


_PIXELS = ", v_pixels AS (SELECT y, x, min(code) AS code FROM v_pixcode GROUP BY y, x), rgb AS (SELECT y, x, code, CASE floor(code / 10) WHEN 0 THEN 255 WHEN 1 THEN 255 WHEN 2 THEN 178 WHEN 3 THEN 250 ELSE 0 END - code % 10 AS r, CASE floor(code / 10) WHEN 0 THEN 204 WHEN 1 THEN 102 WHEN 2 THEN 255 WHEN 3 THEN 250 ELSE 5 END + CASE floor(code / 10) WHEN 2 THEN 0 ELSE code % 4 END AS g, CASE floor(code / 10) WHEN 0 THEN 102 WHEN 1 THEN 204 WHEN 2 THEN 102 WHEN 3 THEN 250 ELSE 5 END + code % 3 * 4 AS b FROM v_pixels)"
_CLS = """, cls AS (SELECT y, x, CASE WHEN r BETWEEN 245 AND 265 AND g BETWEEN 194 AND 214 AND b BETWEEN 92 AND 112 THEN 'room' WHEN r BETWEEN 245 AND 265 AND g BETWEEN 92 AND 112 AND b BETWEEN 194 AND 214 THEN 'outdoor'
 WHEN r BETWEEN 168 AND 188 AND g BETWEEN 245 AND 265 AND b BETWEEN 92 AND 112 THEN 'corridor' WHEN r BETWEEN 245 AND 265 AND g BETWEEN 245 AND 265 AND b BETWEEN 245 AND 265 THEN 'unmarked' ELSE 'wall' END AS cls FROM rgb)"""


def _pixels(spark, sf):
    p = view(spark, sf, "v_pixcode").groupBy("y", "x").agg(F.min("code").alias("code"))
    k, m = F.floor(F.col("code") / 10), F.col("code") % 10
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.least(k, F.lit(4)) + 1).cast("int"))
    return p.select("y", "x", "code", (pick(255, 255, 178, 250, 0) - m).alias("r"), (pick(204, 102, 255, 250, 5) + F.when(k == 2, 0).otherwise(F.col("code") % 4)).alias("g"), (pick(102, 204, 102, 250, 5) + F.col("code") % 3 * 4).alias("b"))


def _classes(spark, sf):
    return _pixels(spark, sf).select("y", "x", raster.pixel_class().alias("cls"))


@query(ctes("v_pixcode") + _PIXELS + _CLS + "SELECT * FROM cls")
def pixel_class(spark, sf):
    return _classes(spark, sf)


@query(ctes("v_pixcode") + _PIXELS + _CLS + "SELECT cls, count(*) AS n FROM cls GROUP BY cls")
def pixel_class_counts(spark, sf):
    return _classes(spark, sf).groupBy("cls").agg(F.count("*").alias("n"))


_ROIS = "SELECT id, x % 360 AS x1, y % 360 AS y1, x % 360 + k % 12 AS x2, y % 360 + k % 9 AS y2 FROM v_doors"


def _rois(spark, sf):
    return view(spark, sf, "v_doors").selectExpr("id", "x % 360 AS x1", "y % 360 AS y1", "x % 360 + k % 12 AS x2", "y % 360 + k % 9 AS y2")


@query(ctes("v_pixcode", "v_doors") + _PIXELS + _CLS + f""", rois AS ({_ROIS}), seen AS (SELECT rois.id, bool_or(cls = 'outdoor') AS o, bool_or(cls = 'corridor') AS c, bool_or(cls = 'room') AS r, bool_or(cls = 'unmarked') AS u
 FROM rois LEFT JOIN cls ON x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY rois.id)
 SELECT id, CASE WHEN o THEN 'exit' WHEN c AND r THEN 'r2c' WHEN c THEN 'c2c' WHEN u THEN 'wardrobe' ELSE 'r2r' END AS door_class FROM seen""")
def door_class(spark, sf):
    return raster.door_class(_rois(spark, sf), _classes(spark, sf))


@query(ctes("v_pixcode") + _PIXELS + _CLS + "SELECT concat(cls, '_', CAST(floor(y / 50) AS BIGINT)) AS region, count(*) AS area, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(sqrt(count(*) / pi()), 4) AS eq_radius FROM cls GROUP BY 1")
def region_area_centroid(spark, sf):
    s = raster.region_stats(_classes(spark, sf).withColumn("region", F.concat("cls", F.lit("_"), F.floor(F.col("y") / 50))), "region")
    return s.select("region", "area", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "eq_radius")])


@query(ctes("v_pixcode", "v_lattice") + """, wall AS (SELECT DISTINCT y, x FROM v_pixcode WHERE code = 47), free AS (SELECT id, k, x, y FROM v_lattice WHERE y < 400 AND x < 400
   AND NOT EXISTS (SELECT 1 FROM wall w WHERE abs(w.x - v_lattice.x) <= 7 AND abs(w.y - v_lattice.y) <= 7))
 SELECT concat('corridor_connect_', row_number() OVER (ORDER BY y, x)) AS id, x, y FROM free""")
def lattice_nodes_clear_of_walls(spark, sf):
    """Lattice places outside the walls grown by 7, numbered row by row."""
    walls = view(spark, sf, "v_pixcode").where("code = 47").select("y", "x").distinct()
    grid = view(spark, sf, "v_lattice").where("y < 400 AND x < 400").select("x", "y")
    return stats.numbered(spark, grid.join(spatial.dilate(walls), ["y", "x"], "left_anti"), ["y", "x"], "n").select(F.concat(F.lit("corridor_connect_"), "n").alias("id"), "x", "y")


_RB = "SELECT k AS box, x AS x1, y % 400 AS y1, x + 30 AS x2, y % 400 + 20 AS y2 FROM v_rooms"


def _room_boxes(spark, sf):
    return view(spark, sf, "v_rooms").selectExpr("k AS box", "x AS x1", "y % 400 AS y1", "x + 30 AS x2", "y % 400 + 20 AS y2")


@query(ctes("v_pixcode", "v_rooms") + f", boxes AS ({_RB}) SELECT DISTINCT box, concat('region_', CAST(floor(code / 10) AS BIGINT)) AS region FROM boxes JOIN (SELECT DISTINCT y, x, code FROM v_pixcode) p ON p.x BETWEEN x1 AND x2 AND p.y BETWEEN y1 AND y2")
def door_room_overlap(spark, sf):
    p = view(spark, sf, "v_pixcode").select("y", "x", F.concat(F.lit("region_"), F.floor(F.col("code") / 10)).alias("region")).distinct()
    return spatial.in_boxes(p, _room_boxes(spark, sf)).select("box", "region").distinct()


_BC = "SELECT box, floor((x1 + x2) / 2) AS cx, floor((y1 + y2) / 2) AS cy, x1, y1, x2, y2 FROM boxes"


@query(ctes("v_doors", "v_rooms") + f""", boxes AS ({_RB}), centred AS ({_BC}), d AS (SELECT id, x, y % 400 AS y FROM v_doors), exact AS (SELECT box, id FROM centred JOIN d ON d.x = cx AND d.y = cy)
 SELECT box, id, true AS exact FROM exact UNION ALL SELECT box, id, false AS exact FROM boxes JOIN d ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 WHERE box NOT IN (SELECT box FROM exact)""")
def door_in_box_fallback(spark, sf):
    """Doors on a box's centre, or else all doors inside the box."""
    # first of the distinct boxes and the doors' places, then their rows
    at, ends = F.array("x", "y").alias("at"), F.array("x1", "y1", "x2", "y2")
    rows, doors = _room_boxes(spark, sf), view(spark, sf, "v_doors").selectExpr("id", "x", "y % 400 AS y")
    boxes, places = rows.select("x1", "y1", "x2", "y2", ends.alias("box")).distinct(), doors.select("x", "y", at).distinct()
    centre = boxes.select("box", F.floor((F.col("x1") + F.col("x2")) / 2).alias("x"), F.floor((F.col("y1") + F.col("y2")) / 2).alias("y"))
    exact = centre.join(places, ["x", "y"]).select("box", "at")
    inside = spatial.in_boxes(places, boxes.join(exact, "box", "left_anti")).select("box", "at", F.lit(False).alias("exact"))
    both = exact.withColumn("exact", F.lit(True)).unionByName(inside).toDF("l_at", "r_at", "exact")
    return spatial.of_places(both, rows.select("box", ends.alias("at")), doors.select("id", at), "at").select("box", "id", "exact")


@query(ctes("v_rooms", "v_doors") + "SELECT l_id AS room, r_id AS anchor, d2 FROM (" + _knn_sql("SELECT * FROM v_rooms", "SELECT * FROM v_doors WHERE subtype = 'r2c'", 120, 1) + ") q")
def anchor_door(spark, sf):
    return spatial.knn_join(view(spark, sf, "v_rooms"), view(spark, sf, "v_doors").where("subtype = 'r2c'"), 120, 1).select(F.col("l_id").alias("room"), F.col("r_id").alias("anchor"), "d2")


_FAMILY = ", fam AS (SELECT id AS room, id, x, y FROM v_rooms UNION ALL SELECT room, id, x, y FROM v_subnodes)"


def _family(spark, sf):
    rooms = view(spark, sf, "v_rooms").select(F.col("id").alias("room"), "id", "x", "y")
    return rooms.unionByName(view(spark, sf, "v_subnodes").select("room", "id", "x", "y"))


@query(ctes("v_rooms", "v_subnodes", "v_doors") + _FAMILY + """, a AS (SELECT concat('room_', k % 50) AS room, id AS door, x, y FROM v_doors WHERE subtype <> 'c2c')
 SELECT door, id, d2 FROM (SELECT door, fam.id, CAST((fam.x-a.x)*(fam.x-a.x)+(fam.y-a.y)*(fam.y-a.y) AS BIGINT) AS d2, row_number() OVER (PARTITION BY door ORDER BY (fam.x-a.x)*(fam.x-a.x)+(fam.y-a.y)*(fam.y-a.y), fam.id) AS n FROM a JOIN fam ON fam.room = a.room) q WHERE n = 1""")
def family_attach(spark, sf):
    """The node of a room's family that is nearest to each of its doors."""
    doors = view(spark, sf, "v_doors").where("subtype <> 'c2c'").select(F.concat(F.lit("room_"), F.col("k") % 50).alias("room"), F.col("id").alias("door"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    d2 = (F.col("x") - F.col("dx")) ** 2 + (F.col("y") - F.col("dy")) ** 2
    # doors of one place have one nearest place, and of its nodes the first counts
    family = _family(spark, sf).groupBy("room", "x", "y").agg(F.min("id").alias("id"))
    place = ["room", "dx", "dy"]
    best = doors.select(*place).distinct().join(family, "room").groupBy(*place).agg(F.min(F.struct(d2.cast("long").alias("d2"), "id")).alias("b"))
    return doors.join(best, place).groupBy("door").agg(F.min("b").alias("b")).select("door", "b.id", "b.d2")


@query(ctes("v_rooms", "v_subnodes") + _FAMILY + " SELECT a.room, a.id AS src, b.id AS dst, CAST((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS BIGINT) AS d2 FROM fam a JOIN fam b ON a.room = b.room AND a.id < b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 5625")
def funnel_lattice(spark, sf):
    """Pairs of one room's nodes within 75: pairs of a room's places, then their nodes."""
    f = _family(spark, sf).withColumn("at", F.array("room", F.col("x").cast("string"), F.col("y").cast("string")))
    places = f.select("room", "x", "y", "at").distinct()
    a, b = (places.select("room", *[F.col(c).alias(f"{p}_{c}") for c in ("x", "y", "at")]) for p in "lr")
    d2 = ((F.col("l_x") - F.col("r_x")) * (F.col("l_x") - F.col("r_x")) + (F.col("l_y") - F.col("r_y")) * (F.col("l_y") - F.col("r_y"))).cast("long")
    near = a.join(b, "room").withColumn("d2", d2).where(F.col("d2") <= 75 * 75).select("room", "l_at", "r_at", "d2")
    ends = [f.select("at", F.col("id").alias(c)) for c in ("src", "dst")]
    return spatial.of_places(near, *ends, "at").where("src < dst").select("room", "src", "dst", "d2")


@query()
def funnel_kept_edges(spark, sf):
    """The ways inside rooms, from each node to the room's own. Nodes of one place have the same ways, of which those over
    the first node of a place are taken; so the first nodes' ways are found, and the others join theirs. The room's own
    node, where the ways begin, stands apart from others of its place."""
    f = _family(spark, sf).distinct().withColumn("main", F.col("id") == F.col("room"))
    place = ["room", "x", "y", "main"]
    heads = f.groupBy(*place).agg(F.min("id").alias("id"))
    a, b = (heads.select("room", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "x", "y")]) for p in "lr")
    d2 = (F.col("l_x") - F.col("r_x")) * (F.col("l_x") - F.col("r_x")) + (F.col("l_y") - F.col("r_y")) * (F.col("l_y") - F.col("r_y"))
    floor = F.regexp_extract("room", r"(\d+)", 1).cast("long")
    near = a.join(b, "room").withColumn("d2", d2).where("l_id < r_id").where(F.col("d2") <= 75 * 75)
    anchors = view(spark, sf, "v_rooms").select(F.col("k").alias("floor"), F.col("id").alias("anchor"))
    ways = paths.funnel(near.select(floor.alias("floor"), F.col("l_id").alias("src"), F.col("r_id").alias("dst"), F.sqrt("d2").alias("weight")), anchors)
    of = ways.join(heads.withColumnRenamed("id", "node"), "node").select("floor", "before", *place)
    return f.join(of, place).select("floor", F.least("id", "before").alias("src"), F.greatest("id", "before").alias("dst"))


# ---- statistics


_NODES = "SELECT id, 'room' AS type, floor FROM v_rooms UNION ALL SELECT id, 'door' AS type, k % 3 + 1 AS floor FROM v_doors UNION ALL SELECT id, 'corridor' AS type, 1 AS floor FROM v_lattice UNION ALL SELECT id, 'transition' AS type, floor FROM v_transitions UNION ALL SELECT id, CAST(NULL AS STRING) AS type, CAST(NULL AS BIGINT) AS floor FROM v_halls"
_NODE_VIEWS = ("v_rooms", "v_doors", "v_lattice", "v_transitions", "v_halls")


def _nodes(spark, sf):
    kinds = [("v_rooms", "room", "floor"), ("v_doors", "door", "k % 3 + 1"), ("v_lattice", "corridor", "1L"), ("v_transitions", "transition", "floor"), ("v_halls", None, "CAST(NULL AS BIGINT)")]
    out = [view(spark, sf, v).selectExpr("id", f"CAST({repr(t) if t else 'NULL'} AS STRING) AS type", f"CAST({fl} AS BIGINT) AS floor") for v, t, fl in kinds]
    first = out[0]
    for o in out[1:]:
        first = first.unionByName(o)
    return first


@query(ctes(*_NODE_VIEWS) + f"SELECT coalesce(type, 'unknown') AS type, count(*) AS n FROM ({_NODES}) q GROUP BY 1")
def node_type_counts(spark, sf):
    return stats.type_counts(_nodes(spark, sf))


@query(ctes(*_NODE_VIEWS) + f"SELECT floor, count(*) FILTER (type = 'room') AS room, count(*) FILTER (type = 'door') AS door, count(*) FILTER (type = 'corridor') AS corridor, count(*) FILTER (type = 'transition') AS transition FROM ({_NODES}) q WHERE floor IS NOT NULL GROUP BY floor")
def floor_type_matrix(spark, sf):
    return stats.floor_matrix(_nodes(spark, sf), ["room", "door", "corridor", "transition"])


@query(ctes(*_NODE_VIEWS) + f"SELECT floor, count(*) AS pre, count(*) FILTER (type <> 'corridor') AS post, CASE WHEN count(*) = 0 THEN 0 ELSE round((1 - CAST(count(*) FILTER (type <> 'corridor') AS DOUBLE) / count(*)) * 100, 2) END AS reduction FROM ({_NODES}) q WHERE floor IS NOT NULL GROUP BY floor")
def prune_reduction(spark, sf):
    return stats.reduction(_nodes(spark, sf).where("floor is not null"), "floor", F.col("type") != "corridor")


_FILES = ", files AS (SELECT file_name, string_agg(line, chr(10) ORDER BY k) AS content FROM v_log GROUP BY file_name)"


def _files(spark, sf):
    return view(spark, sf, "v_log").groupBy("file_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("content"))


@query(ctes("v_log") + _FILES + r""", hits AS (SELECT file_name, k, line FROM v_log), firsts AS (SELECT file_name,
   arg_min(line, k) FILTER (regexp_matches(line, '^Image Dimensions: [0-9]+ x [0-9]+')) AS dims, arg_min(line, k) FILTER (starts_with(line, 'Total graph nodes (before pruning): ')) AS before, arg_min(line, k) FILTER (starts_with(line, 'JSON File Size (after pruning): ')) AS size FROM hits GROUP BY file_name)
 SELECT file_name, CAST(split_part(split_part(dims, ': ', 2), ' x ', 1) AS INTEGER) AS width, CAST(split_part(split_part(split_part(dims, ': ', 2), ' x ', 2), ' ', 1) AS INTEGER) AS height, CAST(NULL AS DOUBLE) AS total_time,
  CAST(split_part(before, ': ', 2) AS DOUBLE) AS nodes_before, CAST(NULL AS DOUBLE) AS nodes_after, CAST(NULL AS DOUBLE) AS json_size_before_kb, CAST(replace(split_part(split_part(size, ': ', 2), ' ', 1), ',', '') AS DOUBLE) AS json_size_after_kb FROM firsts""")
def timer_metrics(spark, sf):
    return readers.timer_metrics(_files(spark, sf))


_STEPS = ", steps AS (SELECT file_name, regexp_extract(line, '^([A-Za-z &]+? check):', 1) AS step, TRY_CAST(regexp_extract(line, 'check:\\s*([\\d.]+)\\s*seconds', 1) AS DOUBLE) AS secs FROM v_log WHERE line LIKE '% check: %')"


@query(ctes("v_log") + _STEPS + " SELECT step, round(avg(secs), 4) AS mean, count(*) AS n FROM steps WHERE secs > 1.0 GROUP BY step")
def step_averages(spark, sf):
    return readers.timer_steps(_files(spark, sf)).groupBy("step").agg(F.round(F.avg("secs"), 4).alias("mean"), F.count("*").alias("n"))


@query(ctes("v_log") + r""", kv AS (SELECT k, trim(regexp_extract(line, '^([^:]*):(.*)$', 1)) AS key, trim(regexp_extract(line, '^([^:]*):(.*)$', 2)) AS v FROM v_log WHERE line LIKE '%:%' AND line NOT LIKE '%=%')
 SELECT * FROM (SELECT k, key, CASE WHEN lower(v) LIKE '%seconds%' THEN TRY_CAST(trim(replace(v, 'seconds', '')) AS DOUBLE) ELSE TRY_CAST(regexp_extract(v, '(\d+(?:\.\d+)?)', 1) AS DOUBLE) END AS value FROM kv) q WHERE value IS NOT NULL""")
def timer_keyvalue(spark, sf):
    return readers.timer_keyvalue(view(spark, sf, "v_log"))


@query("SELECT c_mktsegment AS grp, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 4) AS positive_mean FROM customer GROUP BY 1")
def conditional_means(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.groupBy(F.col("c_mktsegment").alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), 4).alias("positive_mean"))


# ---- mapping files and names


_Q = r"^\(\s*(-?\d+)\s*,\s*([^,]+?)\s*,\s*([^)]+?)\s*\)\s*:\s*\(\s*(-?\d+)\s*,\s*([^,]+?)\s*,\s*([^)]+?)\s*\)"
_MAP = ctes("v_map") + f""", parsed AS (SELECT line_no, regexp_matches(trim(line), '{_Q}') AS ok, TRY_CAST(regexp_extract(trim(line), '{_Q}', 1) AS BIGINT) AS src_floor,
  CASE WHEN regexp_matches(trim(line), '{_Q}') THEN trim(regexp_extract(trim(line), '{_Q}', 2)) END AS src_image, CASE WHEN regexp_matches(trim(line), '{_Q}') THEN trim(regexp_extract(trim(line), '{_Q}', 3)) END AS src_node,
  TRY_CAST(regexp_extract(trim(line), '{_Q}', 4) AS BIGINT) AS tgt_floor, CASE WHEN regexp_matches(trim(line), '{_Q}') THEN trim(regexp_extract(trim(line), '{_Q}', 5)) END AS tgt_image, CASE WHEN regexp_matches(trim(line), '{_Q}') THEN trim(regexp_extract(trim(line), '{_Q}', 6)) END AS tgt_node
  FROM v_map WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')) """


def _mapping(spark, sf):
    return readers.parse_mapping(view(spark, sf, "v_map"))


@query(_MAP + "SELECT * FROM parsed")
def mapping_parse(spark, sf):
    return _mapping(spark, sf)


_V1 = "CASE upper(regexp_extract({n}, '^\\s*(\\S+)', 1)) WHEN 'FF' THEN 1 WHEN 'SF' THEN 2 WHEN 'TF' THEN 3 ELSE coalesce(TRY_CAST(regexp_extract(regexp_extract({n}, '^\\s*(\\S+)', 1), '(\\d+)', 1) AS INTEGER), 1) END"
_V2 = "CASE upper(regexp_extract({n}, '^\\s*(\\S+)', 1)) WHEN 'B2' THEN -2 WHEN 'B1' THEN -1 WHEN 'GF' THEN 0 WHEN 'G' THEN 0 WHEN 'FF' THEN 1 WHEN 'SF' THEN 2 WHEN 'TF' THEN 3 WHEN 'FO' THEN 4 WHEN 'FI' THEN 5 ELSE coalesce(TRY_CAST(regexp_extract({n}, '^\\s*(\\S+)', 1) AS INTEGER), TRY_CAST(regexp_extract({n}, '(-?\\d+)', 1) AS INTEGER), 1) END"


@query(_MAP + f""", g AS (SELECT * FROM parsed WHERE ok), imgs AS (SELECT src_image AS img, src_floor AS f FROM g UNION SELECT tgt_image, tgt_floor FROM g)
 SELECT 'error' AS level, 'malformed' AS code, CAST(line_no AS STRING) AS detail FROM parsed WHERE NOT ok
 UNION ALL SELECT 'error', 'floor_gap', CAST(line_no AS STRING) FROM g WHERE abs(tgt_floor - src_floor) <> 1
 UNION ALL SELECT 'error', 'one_to_one', concat(least(src_floor, tgt_floor), '-', greatest(src_floor, tgt_floor), ':', src_node) FROM g GROUP BY least(src_floor, tgt_floor), greatest(src_floor, tgt_floor), src_node HAVING count(*) > 1
 UNION ALL SELECT 'warning', 'floor_name', concat(img, ':', f) FROM imgs WHERE f <> {_V2.format(n="regexp_replace(img, '[.][^.]*$', '')")}""")
def mapping_issues(spark, sf):
    return floors.mapping_issues(_mapping(spark, sf))


@query(_MAP + f""", g AS (SELECT * FROM parsed WHERE ok), imgs AS (SELECT src_image AS img, src_floor AS f FROM g UNION SELECT tgt_image, tgt_floor FROM g), det AS (SELECT img, list(f) AS fs, {_V1.format(n="regexp_replace(img, '[.][^.]*$', '')")} AS d FROM imgs GROUP BY img)
 SELECT 'error' AS level, 'malformed' AS code, CAST(line_no AS STRING) AS detail FROM parsed WHERE NOT ok
 UNION ALL SELECT 'error', 'same_floor', CAST(line_no AS STRING) FROM g WHERE tgt_floor = src_floor
 UNION ALL SELECT 'warning', 'floor_gap', CAST(line_no AS STRING) FROM g WHERE abs(tgt_floor - src_floor) > 1
 UNION ALL SELECT 'error', 'one_to_one', concat(src_floor, '-', tgt_floor) FROM g GROUP BY src_floor, tgt_floor HAVING count(*) > 1
 UNION ALL SELECT 'warning', 'floor_name', img FROM det WHERE NOT list_contains(fs, d)""")
def mapping_issues_strict(spark, sf):
    return floors.mapping_issues(_mapping(spark, sf), strict=True)


@query(_MAP + "SELECT count(*) AS mappings, (SELECT count(DISTINCT i) FROM (SELECT src_image AS i FROM parsed UNION ALL SELECT tgt_image FROM parsed) a) AS images, (SELECT count(DISTINCT f) FROM (SELECT src_floor AS f FROM parsed UNION ALL SELECT tgt_floor FROM parsed) b) AS floors FROM parsed WHERE ok")
def mapping_summary(spark, sf):
    return floors.mapping_summary(_mapping(spark, sf))


@query(ctes("v_names") + f"SELECT name, CAST({_V1.format(n='''regexp_replace(name, '[.][^.]*$', '')''')} AS INTEGER) AS floor FROM v_names")
def floor_from_name_v1(spark, sf):
    return view(spark, sf, "v_names").select("name", T.floor_v1(F.col("name")).cast("int").alias("floor"))


@query(ctes("v_names") + f"SELECT name, CAST({_V2.format(n='''regexp_replace(name, '[.][^.]*$', '')''')} AS INTEGER) AS floor FROM v_names")
def floor_from_name_v2(spark, sf):
    return view(spark, sf, "v_names").select("name", T.floor_v2(F.col("name")).cast("int").alias("floor"))


@query(ctes("v_names") + f", f AS (SELECT k % 4 AS building, CAST({_V2.format(n='''regexp_replace(name, '[.][^.]*$', '')''')} AS INTEGER) AS floor FROM v_names), d AS (SELECT DISTINCT building, floor FROM f) SELECT building, string_agg(CASE floor WHEN -2 THEN 'B2' WHEN -1 THEN 'B1' WHEN 0 THEN 'G' WHEN 1 THEN 'FF' WHEN 2 THEN 'SF' WHEN 3 THEN 'TF' WHEN 4 THEN 'FO' WHEN 5 THEN 'FI' ELSE CAST(floor AS STRING) END, '_' ORDER BY floor) AS name FROM d GROUP BY building")
def sequence_name(spark, sf):
    named = view(spark, sf, "v_names").select((F.col("k") % 4).alias("building"), T.floor_v2(F.col("name")).cast("int").alias("floor"))
    return floors.sequence_names(named)


# ---- labels


_NORM = r"translate({t}, 'lLIi|!/\oOQDGS$BgqZz -_.,~', '11111111000065589922')"


@query(ctes("v_words") + "SELECT k, text, " + _NORM.format(t="text") + " AS normal FROM v_words")
def normalize_numeric(spark, sf):
    return view(spark, sf, "v_words").select("k", "text", T.normalize_numeric(F.col("text")).alias("normal"))


@query(ctes("v_words") + "SELECT k, CASE WHEN lower(text) = 'hall' THEN 'corridor' WHEN lower(text) = 'na' THEN 'outside' WHEN lower(text) IN ('stairs','stair','staircase','elev','elevator','lift') THEN 'transition' ELSE 'room' END AS cls FROM v_words")
def label_class(spark, sf):
    return view(spark, sf, "v_words").select("k", T.label_class(F.col("text")).alias("cls"))


@query()
def label_cascade(spark, sf):
    return view(spark, sf, "v_words").select("k", "text", "conf", T.accepted_label(F.col("text"), F.col("conf"), 85).alias("label"))


@query()
def fuzzy_lcs_ratio(spark, sf):
    words = view(spark, sf, "v_words").select("text").distinct()
    labels = F.array(*map(F.lit, T.ROOM_LABELS))
    return words.select("text", F.explode(labels).alias("label")).select("text", "label", T.fuzzy_ratio(F.lower("text"), F.lower("label")).alias("ratio"))


_TOK = "SELECT o_custkey AS seq, o_orderkey AS pos, CAST(o_orderkey % 7 * (o_custkey % 2) + o_custkey % 3 AS BIGINT) AS t FROM orders"


@query(f"SELECT seq, pos, t FROM (SELECT *, lag(t) OVER (PARTITION BY seq ORDER BY pos) AS p FROM ({_TOK}) a) q WHERE t <> 0 AND (p IS NULL OR p <> t)")
def ctc_collapse(spark, sf):
    """Tokens that are not blank and differ from the one before."""
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey AS seq", "o_orderkey AS pos", "CAST(o_orderkey % 7 * (o_custkey % 2) + o_custkey % 3 AS BIGINT) AS t")
    before = F.lag("t").over(Window.partitionBy("seq").orderBy("pos"))
    return o.withColumn("p", before).where("t <> 0 AND (p IS NULL OR p <> t)").drop("p")


# ---- paths


def _floor_lattice(spark, sf):
    """Bands of ten lattice rows as floors: edges (floor, src, dst, weight)."""
    nodes = view(spark, sf, "v_lattice").withColumn("floor", F.floor(F.col("y") / 200))
    return spatial.lattice_edges(nodes, by=("floor",)).select("floor", "src", "dst", F.sqrt("d2").alias("weight"))


def _floor_graph(spark, sf):
    """Bands of ten lattice rows as floors: edges (floor, src, dst, weight) and nodes (floor, id, kind, x, y, anchor)."""

    def banded(name, kind, where="true"):
        # bands lie farther apart than any radius, so no join reaches from one into another
        floor = F.floor(F.col("y") / 200)
        return view(spark, sf, name).where(where).select("id", "x", (F.col("y") + floor * 1000).alias("y"), floor.alias("floor"), F.lit(kind).alias("kind"))

    anywhere = 450  # the diagonal of a band
    lattice, halls, rooms, transitions = banded("v_lattice", "corridor"), banded("v_halls", "corridor"), banded("v_rooms", "room"), banded("v_transitions", "transition")
    r2c, c2c, exits = (banded("v_doors", k, f"subtype = '{s}'") for s, k in (("r2c", "door"), ("c2c", "door"), ("exit", "exit")))
    ways = [spatial.knn_join(rows, lattice, radius, k) for rows, radius, k in ((r2c, 100, 1), (exits, 100, 1), (c2c, 100, 4), (halls, 200, 4))]
    doors = r2c.join(ways[0].select(F.col("l_id").alias("id")), "id", "left_semi")
    for rows in (rooms, transitions):
        met = spatial.radius_join(rows.select("id", "x", "y"), doors.select("id", "x", "y"), 40)
        ways += [met, spatial.knn_join(rows.join(met.select(F.col("l_id").alias("id")), "id", "left_anti"), lattice, anywhere, 1)]
    links = [w.select("l_id", "r_id", "d2") for w in ways]
    joined = links[0]
    for w in links[1:]:
        joined = joined.unionByName(w)
    near = spatial.knn_join(rooms, doors, 120, 1).select(F.col("l_id").alias("id"), F.col("r_id").alias("door"))
    place = spatial.knn_join(rooms, lattice, anywhere, 1).select(F.col("l_id").alias("id"), F.col("r_id").alias("node"))
    anchored = rooms.join(near, "id", "left").join(place, "id", "left").select(*rooms.columns, F.coalesce("door", "node").alias("anchor"))
    nodes = anchored
    for rows in (lattice, halls, transitions, r2c, c2c, exits):
        nodes = nodes.unionByName(rows.withColumn("anchor", F.lit(None).cast("string")))
    at = nodes.select(F.col("id").alias("l_id"), "floor")
    attached = joined.join(at, "l_id").select("floor", F.least("l_id", "r_id").alias("src"), F.greatest("l_id", "r_id").alias("dst"), F.sqrt("d2").alias("weight"))
    own = _floor_lattice(spark, sf).select("floor", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return own.unionByName(attached), nodes


_OCTILE = "20.0 * (greatest(dx, dy) - least(dx, dy)) + 20.0 * sqrt(2.0) * least(dx, dy)"


@query(ctes("v_lattice") + f", n AS (SELECT id, k, x, y, CAST(floor(y / 200) AS BIGINT) AS floor FROM v_lattice), p AS (SELECT a.floor, a.id AS source, b.id AS node, abs(a.x - b.x) / 20 AS dx, abs(a.y - b.y) / 20 AS dy FROM n a JOIN n b ON a.floor = b.floor AND a.k % 50 = 0) SELECT floor, source, node, round({_OCTILE}, 4) AS distance FROM p")
def sssp_distance(spark, sf):
    src = view(spark, sf, "v_lattice").where("k % 50 = 0").select(F.floor(F.col("y") / 200).alias("floor"), F.col("id").alias("source"))
    return paths.shortest_distances(_floor_lattice(spark, sf), src).withColumn("distance", F.round("distance", 4))


def _pairs(spark, sf):
    """The query set, ids divisible by 50, against all other places of their floors."""
    n = view(spark, sf, "v_lattice").withColumn("floor", F.floor(F.col("y") / 200))
    a = n.where("k % 50 = 0").select("floor", F.col("id").alias("source"))
    return a.join(n.select("floor", F.col("id").alias("target")), "floor").where("source <> target")


@query(ctes("v_lattice") + f", n AS (SELECT id, k, x, y, CAST(floor(y / 200) AS BIGINT) AS floor FROM v_lattice), p AS (SELECT a.floor, a.id AS source, b.id AS target, abs(a.x - b.x) / 20 AS dx, abs(a.y - b.y) / 20 AS dy FROM n a JOIN n b ON a.floor = b.floor AND a.k % 50 = 0 AND a.id <> b.id) SELECT floor, source, target, round({_OCTILE}, 4) AS distance, CAST(greatest(dx, dy) AS INTEGER) AS segments FROM p")
def route_info(spark, sf):
    n = view(spark, sf, "v_lattice").select("id", "k", F.floor(F.col("y") / 200).alias("floor"))
    r = paths.routes_to_all(_floor_lattice(spark, sf), n, n.where("k % 50 = 0").select("floor", F.col("id").alias("source")))
    return r.select("floor", "source", "target", F.round("distance", 4).alias("distance"), "segments")


@query()
def route_paths(spark, sf):
    """The ways between all rooms of a floor, and from each room to every transition."""
    edges, nodes = _floor_graph(spark, sf)
    ends = nodes.where("kind IN ('room', 'transition')").select("floor", F.col("id").alias("target"), F.col("kind").alias("to"))
    pairs = nodes.where("kind = 'room'").select("floor", F.col("id").alias("source")).join(ends, "floor").where("to = 'transition' OR source < target").drop("to")
    return paths.routes(edges, pairs).select("floor", "source", "target", F.posexplode("path").alias("step", "node"))


@query()
def prune_keep_edges(spark, sf):
    return paths.prune_web(*_floor_graph(spark, sf))


_G07 = "SELECT src, dst, distance, CASE WHEN weight IS NULL OR weight = 1 THEN distance ELSE weight END AS weight FROM (SELECT src, dst, round(sqrt(d2), 4) AS distance, CASE d2 WHEN 400 THEN CAST(NULL AS DOUBLE) ELSE 1.0 END AS weight FROM e) q"


@query(ctes("v_lattice") + f", e AS ({_EDGES}) " + _G07)
def edge_metrics(spark, sf):
    """Distances filled in, and weights that are missing or 1 replaced by them."""
    e = spatial.lattice_edges(view(spark, sf, "v_lattice")).select("src", "dst", F.round(F.sqrt("d2"), 4).alias("distance"), F.when(F.col("d2") == 400, F.lit(None).cast("double")).otherwise(1.0).alias("weight"))
    return stats.backfill_weights(e)


# ---- floors


@query(ctes("v_rooms", "v_transitions") + "SELECT concat(floor, '_', id) AS id, id AS original_id, 'room' AS type, floor, x, y FROM v_rooms UNION ALL SELECT concat(floor, '_', id), id, 'transition', floor, x, y FROM v_transitions")
def merged_floors(spark, sf):
    rooms = view(spark, sf, "v_rooms").withColumn("type", F.lit("room"))
    return floors.merge_floors([rooms, view(spark, sf, "v_transitions").withColumn("type", F.lit("transition"))]).drop("source_image")


_LINKS = """, pages AS (SELECT id, floor, chain, concat('plan_', floor, '.png') AS image FROM v_transitions),
 links AS (SELECT a.floor AS src_floor, a.image AS src_image, a.id AS src_node, b.floor AS tgt_floor, CASE WHEN b.chain % 2 = 1 THEN 'other.png' ELSE b.image END AS tgt_image, CASE WHEN b.chain = 3 THEN concat(b.id, 'x') ELSE b.id END AS tgt_node
  FROM pages a JOIN pages b ON b.floor = a.floor + 1 AND a.chain = b.chain),
 merged AS (SELECT concat(floor, '_', id) AS id, id AS node, image FROM pages),
 found AS (SELECT links.*, coalesce(a.id, b.id) AS src, coalesce(c.id, d.id) AS dst FROM links LEFT JOIN merged a ON a.image = src_image AND a.node = src_node LEFT JOIN merged b ON b.id = concat(src_floor, '_', src_node)
  LEFT JOIN merged c ON c.image = tgt_image AND c.node = tgt_node LEFT JOIN merged d ON d.id = concat(tgt_floor, '_', tgt_node))"""


@query(ctes("v_transitions") + _LINKS + " SELECT CASE WHEN dst IS NOT NULL THEN src END AS src, CASE WHEN src IS NOT NULL THEN dst END AS dst, src_floor, tgt_floor, 'inter_floor' AS edge_type, 1.0 AS weight, CASE WHEN src IS NULL THEN src_node WHEN dst IS NULL THEN tgt_node END AS missing FROM found")
def inter_floor_edges(spark, sf):
    """Links of one chain between neighbouring floors; some name another image, some a node that is not there."""
    t = view(spark, sf, "v_transitions").withColumn("source_image", F.concat(F.lit("plan_"), "floor", F.lit(".png")))
    a, b = (t.select(F.col("floor").alias(f"{p}_floor"), F.col("source_image").alias(f"{p}_image"), F.col("id").alias(f"{p}_node"), "chain") for p in ("src", "tgt"))
    links = a.join(b, "chain").where("tgt_floor = src_floor + 1").withColumns({"tgt_image": F.when(F.col("chain") % 2 == 1, "other.png").otherwise(F.col("tgt_image")), "tgt_node": F.when(F.col("chain") == 3, F.concat("tgt_node", F.lit("x"))).otherwise(F.col("tgt_node"))})
    return floors.inter_floor_edges(links.drop("chain"), floors.merge_floors([t.withColumn("type", F.lit("transition"))]))


@query(ctes("v_transitions") + ", t AS (SELECT id, floor, chain, x / 400.0 AS nx, y / 2000.0 AS ny FROM v_transitions) SELECT a.id AS a, b.id AS b, round(abs(a.nx - b.nx), 4) AS dx, round(abs(a.ny - b.ny), 4) AS dy, abs(a.nx - b.nx) <= 0.25 AND abs(a.ny - b.ny) <= 0.25 AS aligned FROM t a JOIN t b ON b.floor = a.floor + 1 AND a.chain = b.chain")
def transition_alignment(spark, sf):
    t = view(spark, sf, "v_transitions").select("id", "floor", F.col("chain").alias("c"), "x", "y")
    return floors.alignment(t, 400, 2000, 0.25)


# ---- tiles and boxes


@query(ctes("v_rooms") + ", i AS (SELECT id, 300 + k % 700 AS w, 200 + k % 500 AS h FROM v_rooms), a AS (SELECT id, w, h, unnest(range(0, w, 225)) AS tx FROM i), b AS (SELECT id, w, h, tx, unnest(range(0, h, 225)) AS ty FROM a) SELECT id, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, CAST(least(tx + 300, w) AS BIGINT) AS x2, CAST(least(ty + 300, h) AS BIGINT) AS y2 FROM b")
def tiles(spark, sf):
    return raster.tiles(view(spark, sf, "v_rooms").selectExpr("id", "300 + k % 700 AS w", "200 + k % 500 AS h"))


@query(ctes("v_boxes") + "SELECT ord, x1 + ord % 4 * 225 AS x1, y1 + ord % 3 * 225 AS y1, x2 + ord % 4 * 225 AS x2, y2 + ord % 3 * 225 AS y2, floor((x1 + x2) / 2) + ord % 4 * 225 AS cx FROM v_boxes")
def tile_box_offset(spark, sf):
    dx, dy = F.col("ord") % 4 * 225, F.col("ord") % 3 * 225
    return view(spark, sf, "v_boxes").select("ord", (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"), (F.floor((F.col("x1") + F.col("x2")) / 2) + dx).alias("cx"))


@query()
def greedy_box_merge(spark, sf):
    return raster.greedy_merge(view(spark, sf, "v_boxes").select("grp", "ord", "x1", "y1", "x2", "y2"))


@query()
def geodesic_partition(spark, sf):
    mask = view(spark, sf, "v_pixcode").groupBy("y", "x").agg(F.min("code").alias("c")).select(F.floor(F.col("y") / 50).cast("long").alias("img"), (F.col("y") % 50).alias("y"), "x")
    seeds = view(spark, sf, "v_rooms").selectExpr("CAST(k % 8 AS BIGINT) AS img", "id AS label", "y % 50 AS y", "x")
    return raster.geodesic_partition(mask, seeds)


# ---- view model


_VN = f"SELECT id, id AS label, CASE type WHEN 'transition' THEN 'floor_transition' ELSE coalesce(type, 'unknown') END AS type, coalesce(CAST(floor AS STRING), '') AS floor FROM ({_NODES}) q"
_VE = ", e AS (SELECT l_id AS s, r_id AS t FROM (" + _knn_sql("SELECT * FROM v_doors WHERE subtype = 'r2c'", "SELECT * FROM v_lattice", 100, 1) + ") a UNION ALL SELECT l_id, r_id FROM (" + _knn_sql("SELECT * FROM v_transitions", "SELECT * FROM v_rooms", 300, 2) + ") b)"


def _view_edges(spark, sf):
    doors = spatial.knn_join(view(spark, sf, "v_doors").where("subtype = 'r2c'"), view(spark, sf, "v_lattice"), 100, 1)
    return doors.select("l_id", "r_id").unionByName(spatial.knn_join(view(spark, sf, "v_transitions"), view(spark, sf, "v_rooms"), 300, 2).select("l_id", "r_id")).toDF("s", "t")


@query(ctes(*_NODE_VIEWS) + _VN)
def view_nodes(spark, sf):
    return floors.view_nodes(_nodes(spark, sf))


_COLOR = "CASE WHEN 'floor_transition' IN (a.type, b.type) THEN 'transition' WHEN 'outside' IN (a.type, b.type) THEN 'outside' WHEN 'corridor' IN (a.type, b.type) THEN 'corridor' WHEN 'room' IN (a.type, b.type) THEN 'room' ELSE 'default' END"


@query(ctes(*_NODE_VIEWS) + _VE + f", n AS ({_VN}) SELECT concat('e', row_number() OVER (ORDER BY s, t) - 1, '_', s, '_', t) AS id, s AS source, t AS target, {_COLOR} AS color FROM e JOIN n a ON a.id = s JOIN n b ON b.id = t")
def view_edges(spark, sf):
    return floors.view_edges(spark, _view_edges(spark, sf), floors.view_nodes(_nodes(spark, sf)))


@query(ctes(*_NODE_VIEWS) + _VE + f", n AS ({_VN}) SELECT color, count(*) AS n FROM (SELECT {_COLOR} AS color FROM e JOIN n a ON a.id = s JOIN n b ON b.id = t) q GROUP BY color")
def edge_color_class(spark, sf):
    return view_edges(spark, sf).groupBy("color").agg(F.count("*").alias("n"))


@query(ctes(*_NODE_VIEWS) + _VE + f", n AS ({_VN}), vis AS (SELECT id FROM n WHERE type NOT IN ('corridor') OR id IN ('corridor_connect_4', 'corridor_connect_9')) SELECT s, t FROM e WHERE s IN (SELECT id FROM vis) AND t IN (SELECT id FROM vis)")
def visible_edges(spark, sf):
    """Edges whose ends are both visible: corridors are hidden but for a keep list."""
    return floors.visible_edges(_view_edges(spark, sf), floors.view_nodes(_nodes(spark, sf)), ["corridor"], ["corridor_connect_4", "corridor_connect_9"])


@query(ctes(*_NODE_VIEWS) + f", n AS ({_VN}) SELECT id, type, row_number() OVER (ORDER BY type, regexp_extract(label, '^([^0-9]*)', 1), TRY_CAST(regexp_extract(label, '([0-9]+)', 1) AS BIGINT), label) AS place FROM n WHERE type IN ('room', 'floor_transition') AND id NOT LIKE '%\\_subnode\\_%' ESCAPE '\\'")
def route_endpoints(spark, sf):
    return floors.route_endpoints(spark, floors.view_nodes(_nodes(spark, sf)))


@query("SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS stage, max(ts) AS at, count(*) AS n FROM events GROUP BY user_id")
def latest_stage(spark, sf):
    return stages.latest(spark.read.parquet(f"{sf}/events.parquet"))


@query()
def edit_log_state(spark, sf):
    """The edits that stand after all undo and redo steps of each user."""
    return stages.replay(spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id AS session", "event_id AS seq", "CASE event_id % 5 WHEN 3 THEN 'undo' WHEN 4 THEN 'redo' ELSE 'add' END AS op", "event_type AS node"))
