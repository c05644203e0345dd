import glob
import math
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corridora import catalog, catalog_parts  # noqa: F401  (it registers queries)
from corridora.functions import text as T
from corridora.operators import spatial

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def canon(rows, names):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if type(v).__name__ == "Decimal":
            v = float(v)
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canon(df.collect(), df.columns) == canon(cur.fetchall(), names)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_fuzzy_ratio(spark):
    words = ["", "kitchn", "kitchen", "halls", "hall", "living rom", "abc", "aaaa"]
    rows = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.fuzzy_ratio(*map(__import__("pyspark.sql.functions", fromlist=["col"]).col, "ab")).alias("r")).collect()
    assert all(r.r == (100 if not r.a + r.b else round(200 * lcs(r.a, r.b) / (len(r.a) + len(r.b)))) for r in got)


def test_label_cascade(spark):
    from pyspark.sql import functions as F

    rows = [("l0O1", 90, "1001"), ("halls", 90, "halls"), ("lift", 90, "lift"), ("a", 90, None), ("S", 90, "5"), ("", 90, None), ("kitchn", 90, "kitchn"), ("xyz", 90, None), ("101", 80, None), ("12x", 90, None)]
    got = spark.createDataFrame(rows, "t string, c int, want string").select("want", T.accepted_label(F.col("t"), F.col("c"), 85).alias("got")).collect()
    assert all(r.want == r.got for r in got)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(-90, 90), st.integers(-90, 90)), min_size=1, max_size=25))
def test_radius_join_equals_cross_join(spark, points):
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "id long, x long, y long")
    want = {(i, j) for i, a in enumerate(points) for j, b in enumerate(points) if (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 30 * 30}
    assert {(r.l_id, r.r_id) for r in spatial.radius_join(df, df, 30).collect()} == want


def test_merge_threshold_is_strict_and_radius_is_not(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 30, 40)], "id long, x long, y long")
    assert spatial.radius_join(df, df, 50).where("l_id < r_id").count() == 1
    assert spatial.radius_join(df, df, 50, strict=True).where("l_id < r_id").count() == 0


def test_pruning_keeps_distances(spark):
    from corridora.operators import paths

    edges, pairs = catalog._floor_lattice(spark, SF), catalog._pairs(spark, SF)
    before = {(r.source, r.target): round(r.distance, 6) for r in paths.routes(edges, pairs).collect()}
    after = {(r.source, r.target): round(r.distance, 6) for r in paths.routes(paths.prune_to_routes(edges, pairs), pairs).collect()}
    assert before == after


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id long, x long, y long")
    assert spatial.radius_join(none, none, 5).count() == 0 and spatial.nearest_any(spark, none, none).count() == 0


def test_prune_keeps_what_rooms_exits_and_transitions_need(spark):
    from corridora.operators import paths

    sf = SF.replace("0.001", "0.01")
    edges, nodes = (x.toPandas() for x in catalog._floor_graph(spark, sf))
    kept = catalog.QUERIES["prune_keep_edges"](spark, sf).toPandas()
    assert 0 < len(kept) < len(edges) and not kept.duplicated(["src", "dst"]).any()
    corridor = set(nodes.loc[nodes["kind"] == "corridor", "id"])
    pairs = 0
    for floor, n in nodes.groupby("floor"):
        of = {k: list(v) for k, v in n.groupby("kind")["id"]}
        full, web = (paths.adjacency(e[e["floor"] == floor]) for e in (edges, kept))
        reached = {}
        for r in of.get("room", []):
            old, way = paths.dijkstra(full, r)
            new = paths.dijkstra(web, r)[0]
            for t in [*of["room"], *of.get("transition", []), *n.loc[n["id"] == r, "anchor"].dropna()]:
                if t in old:
                    assert new[t] <= old[t] + 1e-6  # a transition that is attached anew may be nearer
                    pairs += 1
            for t in of.get("exit", []):
                if t in old:
                    reached[t] = min(reached.get(t, (9e9, 9e9)), (len(paths.path_to(way, r, t)), round(old[t], 6)))
                    assert t in new
        for t, (_, d) in reached.items():
            assert min(paths.dijkstra(web, t)[0].get(r, 9e9) for r in of["room"]) <= d + 1e-6
        if any(v in corridor for v in web):
            assert all(any(v in corridor for v, _ in web[t]) for t in of.get("transition", []))
    assert pairs > 1000


def test_prune_of_a_small_floor(spark):
    edges = [("a", "c1", 2.0), ("c1", "c2", 2.0), ("b", "c2", 2.0), ("a", "b", 9.0), ("c2", "c3", 2.0), ("c3", "e", 2.0), ("c3", "c4", 2.0), ("c4", "c5", 2.0), ("d", "b", 1.0), ("d", "t", 1.0)]
    places = {"a": (0, 0), "b": (6, 0), "c1": (2, 0), "c2": (4, 0), "c3": (4, 2), "c4": (4, 4), "c5": (4, 6), "d": (7, 0), "e": (6, 2), "t": (8, 0), "u": (4, 7)}
    kind = lambda v: {"a": "room", "b": "room", "e": "exit", "t": "transition", "u": "transition", "d": "door"}.get(v, "corridor")
    e = spark.createDataFrame([(1, *x) for x in edges], "floor long, src string, dst string, weight double")
    n = spark.createDataFrame([(1, v, kind(v), x, y, None) for v, (x, y) in places.items()], "floor long, id string, kind string, x long, y long, anchor string")
    from corridora.operators import paths

    got = {(r.src, r.dst): r.weight for r in paths.prune_web(e, n).collect()}
    # rooms a-c1-c2-b, exit from b (as many steps from a are more), t over the door and then to c2, u anew to c3
    want = {("a", "c1"): 2, ("c1", "c2"): 2, ("b", "c2"): 2, ("c2", "c3"): 2, ("c3", "e"): 2, ("b", "d"): 1, ("d", "t"): 1, ("c2", "t"): 4, ("c3", "u"): 5}
    assert got == want


def test_funnel_keeps_the_shortest_way_of_each_node(spark):
    from corridora.operators import paths

    lattice = catalog.QUERIES["funnel_lattice"](spark, SF).collect()
    kept = catalog.QUERIES["funnel_kept_edges"](spark, SF).collect()
    rooms = {r.room for r in lattice}
    assert rooms and len(kept) <= len(lattice)
    for room in rooms:
        frame = lambda rows: __import__("pandas").DataFrame(rows, columns=["src", "dst", "weight"])
        weight = {(r.src, r.dst): r.d2**0.5 for r in lattice if r.room == room}
        mine = [(r.src, r.dst, weight[r.src, r.dst]) for r in kept if r.floor == int(room[5:])]
        full, web = paths.adjacency(frame([(*e, w) for e, w in weight.items()])), paths.adjacency(frame(mine))
        want, got = paths.dijkstra(full, room)[0], paths.dijkstra(web, room)[0]
        assert want.keys() == got.keys() and all(abs(want[v] - got[v]) < 1e-9 for v in want)
        assert len(mine) == len(want) - 1  # a tree


def test_greedy_merge_goes_by_the_order(spark):
    from corridora.operators import raster

    boxes = {"a": (0, 0, 10, 10), "b": (40, 0, 50, 10), "c": (8, 0, 42, 10), "far": (200, 200, 210, 210), "near": (212, 200, 222, 210)}
    df = lambda order: spark.createDataFrame([(1, i, *boxes[k]) for i, k in enumerate(order)], "grp long, ord long, x1 long, y1 long, x2 long, y2 long")
    got = lambda order: sorted((r.x1, r.y1, r.x2, r.y2) for r in raster.greedy_merge(df(order)).collect())
    # c joins a, the first that it touches; b stays alone if it came before, and joins if it comes after
    assert got(["a", "b", "c"]) == [(0, 0, 42, 10), (40, 0, 50, 10)]
    assert got(["a", "c", "b", "far", "near"]) == [(0, 0, 50, 10), (200, 200, 222, 210)]


def test_geodesic_partition_equals_breadth_first_search(spark):
    from collections import deque

    from corridora.operators import raster

    wall = {(1, x) for x in range(1, 6)}
    mask = [(y, x) for y in range(4) for x in range(7) if (y, x) not in wall]
    seeds = [("p", 0, 0), ("q", 3, 6), ("beside", 1, 3)]
    got = {(r.y, r.x): (r.label, r.steps) for r in raster.geodesic_partition(spark.createDataFrame([(0, *p) for p in mask], "img long, y long, x long"), spark.createDataFrame([(0, *s) for s in seeds], "img long, label string, y long, x long")).collect()}
    steps = {}
    for label, y, x in seeds[:2]:
        d, queue = {(y, x): 0}, deque([(y, x)])
        while queue:
            a, b = queue.popleft()
            for p in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if p in mask and p not in d:
                    d[p] = d[a, b] + 1
                    queue.append(p)
        steps[label] = d
    assert set(got) == set(mask)
    for p, (label, n) in got.items():
        assert n == steps[label][p] == min(d[p] for d in steps.values())


def test_routes_are_ways_of_their_length(spark):
    edges, _ = catalog._floor_graph(spark, SF)
    weight = {}
    for e in edges.collect():
        weight[e.src, e.dst] = min(e.weight, weight.get((e.src, e.dst), 9e9))
    ways = {}
    for r in catalog.QUERIES["route_paths"](spark, SF).collect():
        ways.setdefault((r.source, r.target), {})[r.step] = r.node
    assert ways
    for (a, b), way in ways.items():
        nodes = [way[i] for i in range(len(way))]
        assert (nodes[0], nodes[-1]) == (a, b) and all((min(u, v), max(u, v)) in weight for u, v in zip(nodes, nodes[1:]))


def test_ring_seeds(spark):
    from corridora.operators import masks

    regions = spark.createDataFrame([(0, y, x, 900 if x < 60 else 60) for y in range(100) for x in range(100) if 40 <= x < 60 or x >= 75], "img long, y long, x long, area long")
    nodes = spark.createDataFrame([("in", 0, 50.5, 50.0), ("beside", 0, 20.0, 50.0), ("poor", 0, 110.0, 50.0), ("lost", 0, 500.0, 500.0)], "id string, img long, x double, y double")
    got = {}
    for r in masks.ring_seeds(nodes, regions, first=20, last=40, step=10).orderBy("id", "n").collect():
        got.setdefault(r.id, []).append((r.x, r.y))
    assert got["in"][0] == (50, 50) and 1 < len(got["in"]) <= 12 and got["lost"] == [(500, 500)]
    assert got["beside"][0] == (40, 50) and all(40 <= x < 60 for x, _ in got["beside"])
    assert len(got["poor"]) == 4 and all(x >= 75 for x, _ in got["poor"])


def test_score_of_an_empty_graph(spark):
    from corridora.operators import stats

    none = spark.createDataFrame([], "id string, comp long, room boolean, exit boolean")
    assert [tuple(r) for r in stats.connectivity_score(none).collect()] == [(100, 0, 0, 0, 0)]
    rows = [("a", 1, True, False), ("b", 1, True, False), ("c", 3, True, False), ("d", 4, False, True), ("e", 4, True, False), ("f", 6, False, False)]
    # a, b are the network; c and f stand alone; of d and e the room and the exit are cut off
    assert [tuple(r) for r in stats.connectivity_score(spark.createDataFrame(rows, "id string, comp long, room boolean, exit boolean")).collect()] == [(33, 2, 1, 1, 4)]


def test_unknown_types_are_errors(spark):
    from corridora.operators import building

    bad = spark.createDataFrame([(1, "a", "attic", None, 0, 0)], "seq long, id string, type string, floor string, x long, y long")
    with pytest.raises(Exception, match="unknown node type attic"):
        building.add_nodes(bad, "1").collect()
