import random

import pytest
from pyspark.sql import functions as F

from factmill.operators import graph, joins, picks


def edges(spark, pairs):
    return spark.createDataFrame([("f", a, b) for a, b in pairs], "file string, a int, b int")


def nodes(spark, ids):
    return spark.createDataFrame([("f", i) for i in ids], "file string, id int")


CASES = {
    "chain": ([0, 1, 2, 3], [(0, 1), (1, 2), (2, 3)], {1: 0, 2: 1, 3: 2}),
    "diamond": ([0, 1, 2, 3], [(0, 1), (0, 2), (1, 3), (2, 3)], {1: 0, 2: 0, 3: 0}),
    "loop": ([0, 1, 2, 3], [(0, 1), (1, 2), (2, 1), (1, 3)], {1: 0, 2: 1, 3: 1}),
    "single": ([0], [], {}),
    "unreachable": ([0, 1, 5, 6], [(0, 1), (5, 6)], {1: 0}),
}


@pytest.mark.parametrize("name", CASES)
def test_dominators(spark, name):
    ids, pairs, idom = CASES[name]
    d = graph.dominators(nodes(spark, ids), edges(spark, pairs), nodes(spark, [0]), ["file"], "id", "a", "b")
    got = {(r.id, r.dominator) for r in d.collect()}
    assert {(i, i) for i in ids} <= got
    assert {r.id: r.idom for r in graph.immediate_dominators(d, ["file"], "id").collect()} == idom
    # the definition: without the dominator the node is not reached
    def reach(skip):
        seen, todo = set(), [0] if skip != 0 else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b in pairs if a == x and b != skip]
        return seen

    live = reach(None)
    assert got == {(n, n) for n in ids} | {(n, x) for n in live for x in live if n not in reach(x)}


def test_empty(spark):
    none = edges(spark, [])
    assert graph.dominators(nodes(spark, []), none, nodes(spark, []), ["file"], "id", "a", "b").count() == 0
    assert graph.closure(none, ["file"], "a", "b").count() == 0
    assert graph.components(none, ["file"], "a", "b").count() == 0


def test_closure_and_paths(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    got = {(r.src, r.dst): r.hops for r in graph.closure(e, ["file"], "a", "b").collect()}
    assert got[0, 3] == 3 and got[0, 0] == 3 and (3, 0) not in got
    assert {r.node: r.component for r in graph.components(e, ["file"], "a", "b").collect()} == {0: 0, 1: 0, 2: 0}
    assert {tuple(r.path) for r in graph.simple_paths(nodes(spark, [0]), e, ["file"], "id", "a", "b", 10).collect()} == {(0,), (0, 1), (0, 1, 2), (0, 1, 2, 3)}
    assert {r.id: (r.depth, r.parent) for r in graph.shortest_with_parent(nodes(spark, [0]), e, ["file"], "id", "a", "b").collect()} == {0: (0, None), 1: (1, 0), 2: (2, 1), 3: (3, 2)}
    assert {r.id for r in graph.reachable(nodes(spark, [0]), e, ["file"], "id", "a", "b", stop=nodes(spark, [1])).collect()} == {0, 1}
    assert {r.id for r in graph.reachable(nodes(spark, [0]), e, ["file"], "id", "a", "b", at_most=1).collect()} == {0, 1}


def test_range_join_is_the_theta_join(spark):
    p = spark.createDataFrame([("f", i) for i in range(0, 200, 7)], "file string, at int")
    r = spark.createDataFrame([("f", a, a + w) for a in range(0, 180, 11) for w in (0, 5, 90)], "file string, lo int, hi int")
    want = sorted((x.at, y.lo, y.hi) for x in p.collect() for y in r.collect() if y.lo <= x.at <= y.hi)
    for size in (None, 8, 64):
        got = joins.range_join(p, r, ["file"], "at", "lo", "hi", bin_size=size)
        assert sorted((x.at, x.lo, x.hi) for x in got.collect()) == want


def test_asof(spark):
    left = spark.createDataFrame([("u", i) for i in (1, 5, 9)], "k string, t int")
    right = spark.createDataFrame([("u", 1, "a"), ("u", 5, "b"), ("u", 5, "c"), ("u", 8, "d")], "k string, s int, v string")
    get = lambda **o: {r.t: r.asof_v for r in joins.asof_join(left, right, ["k"], "t", "s", ["v"], **o).collect()}
    assert get() == {1: "a", 5: "c", 9: "d"}
    assert get(strict=True) == {1: None, 5: "a", 9: "d"}
    assert get(direction="forward") == {1: "a", 5: "c", 9: None}
    assert get(direction="forward", strict=True) == {1: "c", 5: "d", 9: None}


def test_pairs_and_picks(spark):
    m = spark.createDataFrame([("c", i) for i in range(3)], "k string, m int")
    uses = spark.createDataFrame([("c", 0, "x"), ("c", 1, "x"), ("c", 2, "y")], "k string, m int, f string")
    (r,) = picks.lcom2(picks.lcom(picks.shared_pairs(m, uses, ["k"], "m", "f"))).collect()
    assert (r.n, r.p, r.q, r.lcom) == (3, 2, 1, 1) and r.lcom2 == pytest.approx(1 / 3)
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.9)], "k string, o int, c double")
    assert [r.o for r in picks.keep_best(rows, ["k"], "c", ["o"]).collect()] == [2]


def brute_dominators(n, pairs):
    def reached(without):
        seen, todo = set(), [] if without == 0 else [0]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b in pairs if a == x and b != without]
        return seen

    live = reached(None)
    return {(x, d) for x in live for d in live if x == d or x not in reached(d)} | {(x, x) for x in range(n) if x not in live}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    """Dominators by their definition, and components by mutual reach, on graphs of some dozens of nodes in two files."""
    r = random.Random(seed)
    n = 30
    pairs = sorted({(r.randrange(n), r.randrange(n)) for _ in range(45 if seed % 2 else 70)})
    e = spark.createDataFrame([(f, a, b) for f in ("f", "g") for a, b in pairs], "file string, a int, b int")
    blocks = spark.createDataFrame([(f, i) for f in ("f", "g") for i in range(n)], "file string, id int")
    roots = spark.createDataFrame([("f", 0), ("g", 0)], "file string, id int")
    got = {(x.file, x.id, x.dominator) for x in graph.dominators(blocks, e, roots, ["file"], "id", "a", "b").collect()}
    assert got == {(f, x, d) for f in ("f", "g") for x, d in brute_dominators(n, pairs)}
    reach = {x: {x} for x in range(n)}
    for _ in range(n):
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {(f, x, min(y for y in reach[x] if x in reach[y])) for f in ("f", "g") for x in range(n) if any(y != x and x in reach[y] for y in reach[x])}
    assert {(x.file, x.node, x.component) for x in graph.components(e, ["file"], "a", "b").collect()} == want


def test_deep_graph(spark):
    """A chain of thousands of blocks: the tree has a row for each, and no recursion."""
    n = 5000
    e = spark.range(n - 1).selectExpr("'f' AS file", "cast(id AS int) AS a", "cast(id + 1 AS int) AS b")
    blocks = spark.range(n).selectExpr("'f' AS file", "cast(id AS int) AS id")
    t = graph.dominator_tree(blocks, e, blocks.where("id = 0"), ["file"], "id", "a", "b")
    assert t.count() == n and t.where("id > 0 and idom != id - 1").count() == 0
    assert t.where(f"leave != {n - 1}").count() == 0


def test_enclosing_across_bins(spark):
    points = spark.createDataFrame([("f", i, i * 700) for i in range(8)] + [("g", 0, 5)], "file string, k int, line int")
    ranges = spark.createDataFrame([("f", 1, 10**6, "all"), ("f", 1400, 1400, "one"), ("f", 2000, 3600, "some"), ("f", 9, 8, "none")], "file string, lo int, hi int, name string").withColumn("size", F.col("hi") - F.col("lo"))
    got = {(r.file, r.k): r.name for r in joins.enclosing(points, ranges, ["file"], "line", "lo", "hi", ["size"], ["k"]).collect()}
    assert got == {("f", 1): "all", ("f", 2): "one", ("f", 3): "some", ("f", 4): "some", ("f", 5): "some", ("f", 6): "all", ("f", 7): "all"}
    left = {(r.file, r.k): r.name for r in joins.enclosing(points, ranges, ["file"], "line", "lo", "hi", ["size"], ["k"], "left").collect()}
    assert left == got | {("f", 0): None, ("g", 0): None}


def test_reached_is_reachable(spark):
    e = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 0), ("f", 3, 4), ("g", 0, 5), ("g", 5, 6)], "file string, a int, b int")
    seeds = spark.createDataFrame([("f", 0), ("g", 0), ("h", 9)], "file string, id int")
    stop = spark.createDataFrame([("g", 5), ("f", 3)], "file string, id int")
    for at in (None, stop):
        got = sorted(map(tuple, graph.reached(seeds, e, ["file"], "id", "a", "b", at).collect()))
        assert got == sorted(tuple(r)[:2] for r in graph.reachable(seeds, e, ["file"], "id", "a", "b", stop=at).collect())


def test_dominators_query_without_edges(spark, tmp_path):
    """Every nation buys as much from every other: no edge is left, and the SQL has a row of nulls."""
    import duckdb

    from factmill.queries import ORACLES, QUERIES

    n, at = 3, str(tmp_path)
    made = {
        "customer": spark.range(n).selectExpr("id AS c_custkey", "cast(id AS int) AS c_nationkey"),
        "supplier": spark.range(n).selectExpr("id AS s_suppkey", "cast(id AS int) AS s_nationkey"),
        "orders": spark.range(n * n).selectExpr("id AS o_orderkey", f"id % {n} AS o_custkey"),
        "lineitem": spark.range(n * n).selectExpr("id AS l_orderkey", f"id div {n} AS l_suppkey", "'R' AS l_returnflag"),
    }
    con = duckdb.connect()
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    want = con.execute(ORACLES["graph_dominators"]).fetchall()
    assert want == [(None, None)]
    assert [tuple(r) for r in QUERIES["graph_dominators"](spark, at).collect()] == want
