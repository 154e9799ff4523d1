"""Loops over edges: read once, the same for short and large frontiers, on cycles and hubs."""

import random

import pytest

from strataq.errors import UnsupportedQueryError
from strataq.graph import algorithms as A
from strataq.plans.prefix import with_next

EDGES = [(1, 2, 1.0), (1, 3, 4.0), (2, 3, 1.0), (3, 4, 2.0), (2, 4, 9.0), (4, 5, 1.0), (6, 5, 1.0)]


@pytest.fixture
def counted(spark):
    """Edges that count how often they are made, and that count."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(EDGES, "src long, dst long, weight double").coalesce(1)
    return df.mapInArrow(count, df.schema), seen


@pytest.mark.parametrize("run", [A.critical_path, lambda e: A.topological_levels(e)[0], A.closure, lambda e: A.dijkstra(e, 1), lambda e: A.weighted_path(e, 1, 5), lambda e: A.dependents(e, 5),
                                 lambda e: A.dependencies(e, 1), lambda e: A.local_community(e, 4, 2), lambda e: A.shortest_paths(e, 1, 5, every=True)])
def test_edges_are_made_once(counted, run):
    """They were made again in every round, with the shuffles behind them."""
    edges, seen = counted
    assert run(edges).collect()
    assert seen.value == len(EDGES)


def test_edges_of_components_and_cycles_are_made_once(counted):
    edges, seen = counted
    assert {r[1] for r in A.components(edges).collect()} == {1}
    assert seen.value <= 2 * len(EDGES)  # one for each direction
    before = seen.value
    assert A.find_cycles(edges, 3).collect() == [] and seen.value - before == len(EDGES)


@pytest.mark.parametrize("few", [0, 100_000])
def test_large_and_short_frontiers_agree(spark, monkeypatch, few):
    monkeypatch.setattr(A, "FEW", few)
    e = spark.createDataFrame(EDGES, "src long, dst long, weight double")
    assert dict(A.bfs(e, spark.createDataFrame([(1,)], "id long")).collect()) == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert dict(A.dijkstra(e, 1).collect()) == {1: 0, 2: 1, 3: 2, 4: 4, 5: 5}
    assert [tuple(r) for r in A.weighted_path(e, 1, 5).collect()] == [([1, 2, 3, 4, 5], 5.0)]
    assert A.weighted_path(e, 5, 1).count() == 0 and [r["path"] for r in A.weighted_path(e, 5, 5).collect()] == [[5]]
    assert sorted(r["path"] for r in A.shortest_paths(e, 1, 5, every=True).collect()) == [[1, 2, 4, 5], [1, 3, 4, 5]]
    assert dict(A.critical_path(e).collect()) == {1: 0, 6: 0, 2: 1, 3: 4, 4: 10, 5: 11}
    assert dict(A.topological_levels(e)[0].collect()) == {1: 0, 6: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    assert {r[0] for r in A.dependents(e, 4).collect()} == {1, 2, 3}
    assert dict(A.local_community(e, 5, 1).collect()) == {5: 0, 4: 1, 6: 1}


def test_cycles_are_left_over(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (5, 5), (6, 1), (6, 1)], "src long, dst long")
    done, left = A.topological_levels(e)
    assert dict(done.collect()) == {6: 0, 1: 1} and {r[0] for r in left.collect()} == {2, 3, 4, 5}
    with pytest.raises(UnsupportedQueryError):
        A.critical_path(e)
    assert A.has_cycle(e) and not A.has_cycle(e.where("src in (1, 6)"))


def test_closure_of_random_graphs(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    want = set(pairs)
    while more := {(a, d) for a, b in want for c, d in pairs if b == c} - want:
        want |= more
    assert sorted(map(tuple, A.closure(spark.createDataFrame([*pairs, *pairs], "src long, dst long")).collect())) == sorted(want)


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_cycles_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(A, "LIST", 3)  # a hub's neighbours take several rows
    rng = random.Random(most)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(60)} | {(0, k) for k in range(14)} | {(k, 0) for k in range(1, 14)}
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    want = []

    def walk(path):
        for x in out.get(path[-1], []):
            if x == path[0]:
                want.append(path)
            elif x > path[0] and x not in path and len(path) < most:
                walk([*path, x])

    for a in out:
        walk([a])
    assert sorted(r["path"] for r in A.find_cycles(spark.createDataFrame(list(pairs), "src long, dst long"), most).collect()) == sorted(want)


def test_longest_paths_of_triangles_are_not_written(spark, monkeypatch):
    """A hub with n edges in and n out has n * n paths of two edges through it, which were written to find what closes."""
    wrote = []
    monkeypatch.setattr(A, "cut", lambda df, old=None, f=A.cut: (lambda t: (wrote.append(t.count()), t)[1])(f(df, old)))
    pairs = [(0, k) for k in range(1, 60)] + [(k, 60) for k in range(1, 60)] + [(60, k) for k in range(61, 120)] + [(60, 0)]
    assert A.find_cycles(spark.createDataFrame(pairs, "src long, dst long"), 3).count() == 59
    assert max(wrote) <= len(pairs)


def test_components_of_chains_and_loops(spark):
    pairs = [(k, k + 1) for k in range(100, 140)] + [(7, 7), (200, 150), (150, 200)] + [(-1, None)]
    got = dict(A.components(spark.createDataFrame(pairs, "src long, dst long")).collect())
    assert got == {**{k: 100 for k in range(100, 141)}, 7: 7, 150: 150, 200: 150, -1: -1}


def test_next_of_a_global_order(spark):
    rows = [(k * 7919 % 1000 if k % 50 else None, k, k % 13 if k % 9 else None) for k in range(2000)]
    got = {r["id"]: r["n"] for r in with_next(spark.createDataFrame(rows, "t long, id long, v long"), ["t", "id"], "v", "n").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == {a[1]: b[2] for a, b in zip(order, order[1:])} | {order[-1][1]: None}
