import random

from lexmill.operators.graph import connected_components
from lexmill.plans.storage import join_checked


def brute(edges):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 150)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    edges = [(a, b) for a, b in edges if a != b]
    odd = [(None, 5), (7, None), (9, 9)]
    found = connected_components(spark.createDataFrame(edges + odd + edges[:5], "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in found} == brute(edges)
    assert len(found) == len(brute(edges))


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_join_checked_either_way(spark):
    left = spark.createDataFrame([(i % 5, i) for i in range(40)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    assert sorted(join_checked(left, right, "k").collect()) == sorted(join_checked(left, right, "k", most=1).collect())
    assert join_checked(left, right, "k", "left_anti", most=0).count() == 24
