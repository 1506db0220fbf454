from pyspark.sql import functions as F

from mnemospark.operators import graph
from mnemospark.operators.components import connected_components


def _edges(spark, pairs, kind="Caused"):
    return spark.createDataFrame([(a, kind, b, 0.5) for a, b in pairs], "src long, kind string, dst long, weight double")


def test_bfs_hop_is_least(spark):
    import collections
    import random

    rnd = random.Random(3)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(90)]
    out = {r.node: r.hop for r in graph.bfs(spark.createDataFrame([(0,)], "start long"), graph.directed(_edges(spark, pairs)), 4).collect()}
    want, todo = {0: 0}, collections.deque([0])
    while todo:
        n = todo.popleft()
        for a, b in pairs:
            if a == n and b not in want and want[n] < 4:
                want[b] = want[n] + 1
                todo.append(b)
    assert out == want


def test_path_is_simple_and_joined(spark):
    e = _edges(spark, [(1, 2), (2, 3), (3, 4), (2, 4)])
    p = graph.meet_in_the_middle(spark.createDataFrame([(1,)], "start long"), spark.createDataFrame([(4,)], "goal long"), e, 4).collect()
    assert [(r.path, r.length) for r in p] == [([1, 2, 4], 2)]


def test_no_path_gives_both_ends(spark):
    out = graph.shortest_path(F.lit(1), F.lit(9), _edges(spark, [(1, 2)]), 3).collect()
    assert sorted((r.node, r.from_target, r.score) for r in out) == [(1, 0, 1.0), (9, 0, 1.0)]


def test_reason_and_verdict(spark):
    e = _edges(spark, [(1, 2), (2, 3)], "Supports")
    out = {r.node: r.score for r in graph.reason(spark.createDataFrame([(1, 1.0)], "node long, sim double"), e, 3, ("Supports",)).collect()}
    assert out == {2: 0.25, 3: round(0.25 / 3 + 1e-9, 6)}
    assert spark.range(1).select(graph.verdict(F.lit(0.0), F.lit(0.0))).first()[0] == 0.0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (200, 100), (7, 7)] + [(300, j) for j in range(301, 340)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[101] == got[200] == 100 and all(got[j] == 300 for j in range(300, 340))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
