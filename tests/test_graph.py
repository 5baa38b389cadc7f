"""Loops of the graph operators run to their end."""

from webloom.operators import graph as G


def test_ancestors_of_long_chains(spark):
    n = 68
    parents = spark.createDataFrame([(i, i - 1) for i in range(1, n + 1)], "node long, parent long").coalesce(1)
    got = {(r.node, r.ancestor, r.level) for r in G.ancestors(parents).collect()}
    assert got == {(i, j, i - j) for i in range(1, n + 1) for j in range(i)}


def test_depths_of_long_paths_and_loops(spark):
    n = 40
    path = [(i, i + 1) for i in range(n)] + [(n, 3), (5, 2), (20, 0), (7, 7), (100, 101)]
    short = [(10, 30)]
    homes = spark.createDataFrame([(0,), (0,)], "node long")
    got = {r.node: r.depth for r in G.depths(spark.createDataFrame(path + short, "from_id long, to_id long").coalesce(1), homes).collect()}
    assert got == {i: i if i < 30 else i - 19 for i in range(n + 1)}
    assert G.depths(spark.createDataFrame([], "from_id long, to_id long"), homes).collect() == [(0, 0)]
