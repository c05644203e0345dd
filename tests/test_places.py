"""Many rows on few places: places meet, not rows, with the results of a nested loop."""

import pytest

from corridora import catalog
from corridora.operators import spatial


def piled(spark, prefix, places, n=60):
    return spark.createDataFrame([(f"{prefix}{i}", *places[i % len(places)]) for i in range(n)], "id string, x long, y long")


@pytest.fixture
def met(monkeypatch):
    """The rows that go into each grid join."""
    seen, plain = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda l, r, *a, **k: seen.append((l.count(), r.count())) or plain(l, r, *a, **k))
    return seen


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_of_piled_rows(spark, met, k):
    left, right = piled(spark, "l", [(0, 0), (30, 5), (500, 0)]), piled(spark, "r", [(3, 4), (4, 3), (-70, 0)])
    a, b = left.collect(), right.collect()
    want = set()
    for p in a:
        near = sorted((d, q.id) for q in b if (d := (p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 10000)
        want |= {(p.id, q, d, n + 1) for n, (d, q) in enumerate(near[:k])}
    assert {tuple(r) for r in spatial.knn_join(left, right, 100, k).collect()} == want and want
    assert met == [(3, 3 * k)]


def test_nearest_of_repeated_rows(spark):
    """Repeated rows count as often as they are there, as in the SQL."""
    left = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("b", 1, 1)], "id string, x long, y long")
    right = spark.createDataFrame([("p", 2, 0), ("p", 2, 0), ("q", 9, 0)], "id string, x long, y long")
    got = sorted((r.l_id, r.r_id, r.rank) for r in spatial.knn_join(left, right, 20, 3).collect())
    assert got == [("a", "p", 1), ("a", "p", 2), ("a", "p", 3), ("b", "p", 1), ("b", "p", 2), ("b", "q", 3)]


def test_nearest_any_and_without_near_of_piled_rows(spark, met):
    left, right = piled(spark, "l", [(0, 0), (900, 5)]), piled(spark, "r", [(3, 4), (2000, 0)])
    got = {tuple(r) for r in spatial.nearest_any(spark, left, right).collect()}
    assert got == {(f"l{i}", "r0", 25 if i % 2 == 0 else 897**2 + 1) for i in range(60)}
    assert {r.id for r in spatial.without_near(left, right, 40).collect()} == {f"l{i}" for i in range(1, 60, 2)}
    assert max(n for pair in met for n in pair) == 2


def rooms_of(monkeypatch, frame):
    plain = catalog.view
    monkeypatch.setattr(catalog, "view", lambda spark, sf, name: frame if name == "v_rooms" else plain(spark, sf, name))


def test_components_of_piled_rooms(spark, monkeypatch, met):
    """Rooms of a place, of places less than 50 apart in a chain, and of one exactly 50 away."""
    rows = [(f"room_{k}", k, *[(0, 0), (40, 0), (90, 0), (400, 400)][k % 4], 1) for k in range(7, 107)]
    rooms_of(monkeypatch, spark.createDataFrame(rows, "id string, k long, x long, y long, floor long"))
    got = {r.id: r.comp for r in catalog.QUERIES["components"](spark, "").collect()}
    assert got == {f"room_{k}": [8, 8, 10, 7][k % 4] for k in range(7, 107)}
    assert met == [(4, 4)]
