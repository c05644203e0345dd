import random

import pytest

from corridora.plans import components


@pytest.mark.parametrize("few,hub", [(10**6, 1000), (0, 1000), (0, 20)])
def test_components_equal_union_find(spark, monkeypatch, few, hub):
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components, "HUB", hub)
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(5, i) for i in range(0, 100, 2)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3), (2, 2), (7, 7)]
    root = {v: v for link in links for v in link}
    for _ in range(len(root)):
        for a, b in links:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    want = {(v, root[v]) for a, b in links if a is not None and a != b for v in (a, b)}
    got = [tuple(r) for r in components.connected_components(spark, spark.createDataFrame(links, "x long, y long"), "x", "y").collect()]
    assert len(got) == len(want) and set(got) == want


def test_components_of_names_and_of_nothing(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "x string, y string")
    assert {tuple(r) for r in components.connected_components(spark, df, "x", "y").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert components.connected_components(spark, df.limit(0), "x", "y").collect() == []
