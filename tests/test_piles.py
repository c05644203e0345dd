"""Queries over tables whose rows lie on a few places: SQL's rows, without all pairs of rows on the way."""

import duckdb
import pytest
from test_queries import canon

from corridora import catalog, catalog_parts  # noqa: F401  (it registers queries)
from corridora.operators import masks, raster

SF, N = "/root/testdata/sf0.001", 120
#: Keys that are equal modulo all that the views take of them.
KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "events": "event_id"}


def piled(tmp_path, first, step=6000, extra=""):
    con = duckdb.connect()
    for table, key in KEYS.items():
        more = extra if table == "events" else ""
        con.execute(f"COPY (SELECT t.* REPLACE ({first} + i * {step} AS {key}{more}) FROM (SELECT * FROM read_parquet('{SF}/{table}.parquet') LIMIT 1) t, range({N}) r(i)) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT t.* REPLACE (y AS l_orderkey, x AS l_partkey, 'A' AS l_returnflag, 'F' AS l_linestatus) FROM (SELECT * FROM read_parquet('{SF}/lineitem.parquet') LIMIT 1) t, range(100, 400) a(y), range(75, 105) b(x) WHERE y BETWEEN 120 AND 130 OR y BETWEEN 366 AND 384) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    for table in (*KEYS, "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    return con


def as_in_sql(con, name, df):
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    rows = df.collect()
    assert canon(rows, df.columns) == canon(cur.fetchall(), names)
    return rows


def most_rows(df):
    """The largest number of rows that a step of the executed plan gave."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            kids = [plan.executedPlan()]
        elif kind.endswith("QueryStageExec"):
            kids = [plan.plan()]
        else:
            kids = [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(walk, kids)])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name,first", [("family_attach", 2), ("anchor_of_own_doors", 2), ("room_interiors", 2), ("reached_in_disc", 2), ("edited_edges", 0)])
def test_no_pairs_of_piled_rows(spark, tmp_path, name, first):
    # events: additions and deletions of room_0, and edges from it, in turn
    con = piled(tmp_path, first, *((1, ", 0 AS user_id") if name == "edited_edges" else ()))
    df = catalog.QUERIES[name](spark, str(tmp_path))
    rows = as_in_sql(con, name, df)
    if name in ("family_attach", "room_interiors"):
        assert len(rows) == N
    assert most_rows(df) < {"family_attach": 2 * N, "edited_edges": 4 * N}.get(name, 9000)


def test_edits_of_all_events(spark, tmp_path):
    """Also of those with an id of 100000000 and more."""
    con = piled(tmp_path, 99999990, 1, ", i AS user_id")
    con.execute(f"COPY (SELECT * REPLACE (row_number() OVER () AS s_suppkey) FROM supplier) TO '{tmp_path}/s.parquet' (FORMAT parquet)")
    (tmp_path / "s.parquet").replace(tmp_path / "supplier.parquet")
    rows = as_in_sql(con, "edited_edges", catalog.QUERIES["edited_edges"](spark, str(tmp_path)))
    nodes, edges = {f"room_{k}" for k in range(1, N + 1)}, {tuple(sorted((f"room_{k}", f"room_{k + 1}"))) for k in range(1, N)}
    for i in range(N):
        seq = 99999990 + i
        a, b = f"room_{i % 60}", f"room_{seq * 7 % 60}"
        pair = tuple(sorted((a, b)))
        if seq % 7 == 0:
            nodes.discard(a)
            edges = {e for e in edges if a not in e}
        elif seq % 7 == 1:
            nodes.add(a)
        elif seq % 7 == 6:
            edges.discard(pair)
        elif a != b and {a, b} <= nodes:
            edges.add(pair)
    assert {(r.src, r.dst) for r in rows} == edges


def test_pairs_of_a_place_are_dealt_to_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    con = piled(tmp_path, 2)
    holds = lambda k: 0 <= 74 - (k * 41 + 7) % 400 <= 30 and 0 <= 182 - (k * 173 + 29) % 2000 % 400 <= 20
    key = next(k for k in range(1, 2001) if holds(k))  # a room whose box holds the doors' place
    con.execute(f"COPY (SELECT * REPLACE ({key} + i * 6000 AS s_suppkey) FROM (SELECT * FROM supplier LIMIT 1), range({N}) r(i)) TO '{tmp_path}/s.parquet' (FORMAT parquet)")
    (tmp_path / "s.parquet").replace(tmp_path / "supplier.parquet")
    df = catalog.QUERIES["door_in_box_fallback"](spark, str(tmp_path))
    assert len(as_in_sql(con, "door_in_box_fallback", df)) == N * N
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < N * N / 4
    assert len(as_in_sql(con, "doors_of_rooms", catalog.QUERIES["doors_of_rooms"](spark, str(tmp_path)))) in (0, N * N)
    as_in_sql(con, "funnel_lattice", catalog.QUERIES["funnel_lattice"](spark, str(tmp_path)))


def test_equal_boxes_are_linked_once(spark, tmp_path, monkeypatch):
    links, plain = [], raster.connected_components
    monkeypatch.setattr(raster, "connected_components", lambda s, e, a, b: links.append(e.count()) or plain(s, e, a, b))
    con = piled(tmp_path, 2, 1200)
    rows = as_in_sql(con, "touching_box_groups", catalog.QUERIES["touching_box_groups"](spark, str(tmp_path)))
    assert [r.n for r in rows] == [N] and links == [0]
    bad = spark.createDataFrame([(1, 1, 9, 0, 5, 5), (1, 2, 9, 0, 5, 5), (1, 3, 0, 0, 9, 9), (1, 4, 20, 20, 30, 30), (1, 4, 20, 20, 30, 30)], "grp long, ord long, x1 long, y1 long, x2 long, y2 long")
    got = sorted((r.x1, r.x2, r.n) for r in raster.touching_groups(spark, bad, cell=64).collect())
    assert got == [(0, 9, 3), (20, 30, 2)]


def test_seeds_of_one_place_fill_their_disc_once(spark):
    white = spark.createDataFrame([(0, y, x) for y in range(30) for x in range(30) if x != 10 or y == 29], "img long, y long, x long")
    seeds = spark.createDataFrame([(f"s{i}", 0, 5, 5) for i in range(40)] + [("wall", 0, 5, 10), ("far", 1, 0, 0)], "seed string, img long, sy long, sx long")
    df = masks.reached_in_disc(spark, white, seeds, radius=8)
    want = sum((y - 5) ** 2 + (x - 5) ** 2 <= 64 and x < 10 for y in range(30) for x in range(30))
    assert {(r.seed, r.area) for r in df.collect()} == {(f"s{i}", want) for i in range(40)}
    assert most_rows(df) < 9 * 900


def test_ways_of_piled_nodes_in_a_room(spark, tmp_path):
    """As Dijkstra over all nodes, of equal ways that over the smaller node."""
    import pandas as pd

    from corridora.operators import paths

    con = piled(tmp_path, 2)
    keys = [2 + 50 * j + 6000 * i for j in range(8) for i in range(12)]
    con.execute(f"COPY (SELECT t.* REPLACE (k AS c_custkey) FROM (SELECT * FROM customer LIMIT 1) t, (SELECT unnest({keys}) AS k)) TO '{tmp_path}/c.parquet' (FORMAT parquet)")
    (tmp_path / "c.parquet").replace(tmp_path / "customer.parquet")
    edges = [(r.src, r.dst, r.d2**0.5) for r in catalog.QUERIES["funnel_lattice"](spark, str(tmp_path)).collect()]
    before = paths.dijkstra(paths.adjacency(pd.DataFrame(edges, columns=["src", "dst", "weight"])), "room_2")[1]
    df = catalog.QUERIES["funnel_kept_edges"](spark, str(tmp_path))
    got = [(r.floor, r.src, r.dst) for r in df.collect()]
    assert len(before) == len(got) == len(keys) and set(got) == {(2, min(e), max(e)) for e in before.items()}
    assert len(edges) > 1000 > most_rows(df)


def test_routes_to_all_of_repeated_rows_in_more_partitions(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from corridora.operators import paths

    monkeypatch.setattr(paths, "SOURCES", 1)
    con = piled(tmp_path, 0, 1)
    con.execute(f"COPY (SELECT p_partkey + 200 * i AS p_partkey FROM part, range(12) r(i) UNION ALL SELECT unnest([50, 51])) TO '{tmp_path}/p.parquet' (FORMAT parquet)")
    (tmp_path / "p.parquet").replace(tmp_path / "part.parquet")
    df = catalog.QUERIES["route_info"](spark, str(tmp_path))
    assert as_in_sql(con, "route_info", df)
    assert df.select(F.spark_partition_id()).distinct().count() > 4
