"""Fixpoints over edge tables. Each round is a join of the frontier with the edges, written to the shared folder.

Frames are partitioned by `keys` (a file, a project) and a round ends when its frontier is empty; rounds are bounded, and a bound that is
hit raises unless `at_most` is what the caller asked for. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import first_match, range_join
from .storage import cut

ROUNDS = 10_000


def reachable(seeds: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, src: str, dst: str, at_most: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """keys, node, depth: all nodes that the seeds reach, seeds at depth 0. stop: nodes (keys, node) that are reached but not left."""
    on = [*keys, node]
    e = edges.select(*keys, F.col(src).alias("_src"), F.col(dst).alias("_dst")).distinct()
    seen = cut(seeds.select(*on).distinct().withColumn("depth", F.lit(0)))
    frontier, rounds = seen, 0
    while rounds < (ROUNDS if at_most is None else at_most):
        left = frontier if stop is None else frontier.join(stop.select(*on), on, "left_anti")
        step = left.select(*keys, F.col(node).alias("_src")).join(e, [*keys, "_src"]).select(*keys, F.col("_dst").alias(node)).distinct()
        rounds += 1
        frontier = cut(step.join(seen, on, "left_anti").withColumn("depth", F.lit(rounds)))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    if at_most is None:
        raise RuntimeError("no fixpoint")
    return seen


def closure(edges: DataFrame, keys: Sequence[str], src: str, dst: str, at_most: int | None = None) -> DataFrame:
    """keys, src, dst, hops: pairs with a path of one edge or more. Path doubling: rounds grow with the logarithm of the longest path."""
    e = edges.select(*keys, F.col(src).alias("src"), F.col(dst).alias("dst")).distinct().withColumn("hops", F.lit(1))
    known = cut(e)
    n = known.count()
    while True:
        a = known.select(*keys, "src", F.col("dst").alias("mid"), F.col("hops").alias("h1"))
        b = known.select(*keys, F.col("src").alias("mid"), "dst", F.col("hops").alias("h2"))
        longer = a.join(b, [*keys, "mid"]).select(*keys, "src", "dst", (F.col("h1") + F.col("h2")).alias("hops"))
        if at_most is not None:
            longer = longer.where(F.col("hops") <= at_most)
        known = cut(known.unionByName(longer).groupBy(*keys, "src", "dst").agg(F.min("hops").alias("hops")))
        total = known.agg(F.count("*").alias("n"), F.sum("hops").alias("h")).first()
        now = (total["n"], total["h"])
        if now == n:
            return known
        n = now


def shortest_with_parent(seeds: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, src: str, dst: str, most: int = ROUNDS) -> DataFrame:
    """keys, node, depth, parent, seed: one search from all seeds at once; among equally near parents the least one wins."""
    on = [*keys, node]
    e = edges.select(*keys, F.col(src).alias("_src"), F.col(dst).alias("_dst")).distinct()
    seen = cut(seeds.select(*on).distinct().select(*on, F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema[node].dataType).alias("parent"), F.col(node).alias("seed")))
    frontier = seen
    for depth in range(1, most + 1):
        step = frontier.select(*keys, F.col(node).alias("_src"), "seed").join(e, [*keys, "_src"]).groupBy(*keys, F.col("_dst").alias(node)).agg(F.min(F.struct(F.col("_src"), F.col("seed"))).alias("m"))
        frontier = cut(step.join(seen.select(*on), on, "left_anti").select(*on, F.lit(depth).alias("depth"), F.col("m._src").alias("parent"), F.col("m.seed").alias("seed")))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def with_decay(seeds: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, src: str, dst: str, decay: float, blocked: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """keys, carry, node, depth, confidence: breadth-first from seeds (with confidence), which loses a factor at each edge.

    The first visit counts; of visits in the same round the most confident. blocked: (keys, src, dst) edges that are not taken.
    """
    on = [*keys, *carry, node]
    e = edges.select(*keys, F.col(src).alias("_src"), F.col(dst).alias("_dst")).distinct()
    if blocked is not None:
        e = e.join(blocked.select(*keys, F.col(src).alias("_src"), F.col(dst).alias("_dst")), [*keys, "_src", "_dst"], "left_anti")
    e = cut(e)
    seen = cut(seeds.groupBy(*on).agg(F.max("confidence").alias("confidence")).withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while depth < ROUNDS:
        depth += 1
        step = frontier.select(*keys, *carry, F.col(node).alias("_src"), "confidence").join(e, [*keys, "_src"])
        step = step.groupBy(*keys, *carry, F.col("_dst").alias(node)).agg((F.max("confidence") * decay).alias("confidence"))
        frontier = cut(step.join(seen.select(*on), on, "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen.select(*on, "depth", "confidence")
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError("no fixpoint")


def simple_paths(seeds: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, src: str, dst: str, most_hops: int, branching: int | None = None) -> DataFrame:
    """keys, node, path: all paths from seeds without a repeated node, up to most_hops edges. branching: edges taken out of a node at most, in order of their targets."""
    e = edges.select(*keys, F.col(src).alias(node), F.col(dst).alias("_dst")).distinct()
    if branching is not None:
        from .picks import capped

        e = capped(e, [*keys, node], ["_dst"], branching)
    e = cut(e)
    paths = cut(seeds.select(*keys, node).distinct().withColumn("path", F.array(node)))
    found, frontier = paths, paths
    for _ in range(most_hops):
        frontier = cut(frontier.join(e, [*keys, node]).where(~F.array_contains("path", F.col("_dst"))).select(*keys, F.col("_dst").alias(node), F.concat("path", F.array("_dst")).alias("path")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def _trimmed(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges (src, dst) between nodes that have edges in and out, over and over: what is left holds all cycles."""
    e = cut(edges)
    n = e.count()
    while n:
        ins = e.select(*keys, F.col("dst").alias("src")).distinct()
        outs = e.select(*keys, F.col("src").alias("dst")).distinct()
        e = cut(e.join(ins, [*keys, "src"], "left_semi").join(outs, [*keys, "dst"], "left_semi").select(*keys, "src", "dst"))
        left = e.count()
        if left == n:
            break
        n = left
    return e


def _least_reaching(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, node, color: the least node from which each node can be reached, itself included."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct()
    color = cut(ends.withColumn("color", F.col("node")))
    changed = color
    while not changed.isEmpty():
        told = changed.select(*keys, F.col("node").alias("src"), "color").join(edges, [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.min("color").alias("told"))
        changed = cut(color.join(told, [*keys, "node"]).where("told < color").select(*keys, "node", F.col("told").alias("color")))
        color = cut(color.join(changed.withColumnRenamed("color", "new"), [*keys, "node"], "left").select(*keys, "node", F.coalesce("new", "color").alias("color")))
    return color


def components(edges: DataFrame, keys: Sequence[str], src: str, dst: str) -> DataFrame:
    """keys, node, component: strongly connected components of two nodes or more; a component is named by its least node.

    By trimming and colouring: the least node that reaches a node colours it; what reaches that least node again within its colour is its
    component. Frames stay as large as the edges, which pairs of all that reach each other would not.
    """
    left = edges.select(*keys, F.col(src).alias("src"), F.col(dst).alias("dst")).where("src != dst").distinct()
    found = None
    while True:
        left = _trimmed(left, keys)
        if left.isEmpty():
            break
        color = _least_reaching(left, keys)
        ends = [color.select(*keys, F.col("node").alias(x), F.col("color").alias(f"{x}_color")) for x in ("src", "dst")]
        same = left.join(ends[0], [*keys, "src"]).join(ends[1], [*keys, "dst"]).where("src_color = dst_color").select(*keys, F.col("src_color").alias("color"), "src", "dst")
        back = reachable(color.where("node = color").select(*keys, "color", "node"), same, [*keys, "color"], "node", "dst", "src")
        own = cut(back.select(*keys, "node", F.col("color").alias("component")))
        found = own if found is None else found.unionByName(own)
        gone = [own.select(*keys, F.col("node").alias(x)) for x in ("src", "dst")]
        left = left.join(gone[0], [*keys, "src"], "left_anti").join(gone[1], [*keys, "dst"], "left_anti").select(*keys, "src", "dst")
    if found is None:
        none = edges.select(*keys, F.col(src).alias("node"), F.col(src).alias("component")).limit(0)
        return none
    several = found.groupBy(*keys, "component").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return found.join(several, [*keys, "component"]).select(*keys, "node", "component")


def orphans(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, src: str, dst: str) -> DataFrame:
    """Nodes that no other node has an edge to."""
    entered = edges.where(F.col(src) != F.col(dst)).select(*keys, F.col(dst).alias(node)).distinct()
    return nodes.join(entered, [*keys, node], "left_anti")


def reached(seeds: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, src: str, dst: str, stop: DataFrame | None = None) -> DataFrame:
    """keys, node: what the seeds reach, themselves included, as reachable() has it. For graphs that are small each (one value of the keys: a
    file, a loop), which are handled in one call without rounds. stop: nodes (keys, node) that are reached but not left."""
    from pyspark.sql.types import StructField, StructType

    kind = seeds.schema[node].dataType
    rows = seeds.select(*keys, F.col(node).alias("a"), F.lit(None).cast(kind).alias("b"), F.lit(0).alias("k"))
    rows = rows.unionByName(edges.select(*keys, F.col(src).cast(kind).alias("a"), F.col(dst).cast(kind).alias("b"), F.lit(1).alias("k")))
    if stop is not None:
        rows = rows.unionByName(stop.select(*keys, F.col(node).cast(kind).alias("a"), F.lit(None).cast(kind).alias("b"), F.lit(2).alias("k")))
    schema = StructType([*[StructField(k, seeds.schema[k].dataType) for k in keys], StructField(node, kind)])

    def go(key, table):
        import pyarrow as pa

        succ, todo, ends = {}, [], set()
        for a, b, k in zip(*(table.column(x).to_pylist() for x in ("a", "b", "k")), strict=True):
            if k == 1:
                succ.setdefault(a, []).append(b)
            elif k == 0:
                todo.append(a)
            else:
                ends.add(a)
        seen = set(todo)
        while todo:
            x = todo.pop()
            for to in succ.get(x, ()) if x not in ends else ():
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return pa.table([*[pa.array([v.as_py()] * len(seen), v.type) for v in key], pa.array(sorted(seen), table.column("a").type)], names=schema.names)

    return rows.groupBy(*keys).applyInArrow(go, schema)


def _tree_of(nodes: list, succ: dict, root) -> dict:
    """node: (idom, enter, leave) of what the root reaches: immediate dominators to a fixpoint in reverse postorder, then the tree's intervals."""
    order, seen, stack = [], {root}, [(root, iter(succ.get(root, ())))]
    while stack:
        for to in stack[-1][1]:
            if to not in seen:
                seen.add(to)
                stack.append((to, iter(succ.get(to, ()))))
                break
        else:
            order.append(stack.pop()[0])
    order.reverse()
    at = {n: i for i, n in enumerate(order)}
    pred: dict = {}
    for n in order:
        for to in succ.get(n, ()):
            pred.setdefault(to, []).append(at[n])
    idom = [None] * len(order)
    idom[0] = 0
    changed = True
    while changed:
        changed = False
        for i in range(1, len(order)):
            new = None
            for p in pred[order[i]]:
                if idom[p] is None:
                    continue
                if new is None:
                    new = p
                    continue
                a, b = p, new
                while a != b:
                    while a > b:
                        a = idom[a]
                    while b > a:
                        b = idom[b]
                new = a
            if idom[i] != new:
                idom[i], changed = new, True
    children: list[list[int]] = [[] for _ in order]
    for i in range(1, len(order)):
        children[idom[i]].append(i)
    out, clock, work = {}, 0, [(0, False)]
    enter = [0] * len(order)
    while work:
        i, done = work.pop()
        if done:
            out[order[i]] = (order[idom[i]] if i else None, enter[i], clock - 1)
            continue
        enter[i] = clock
        clock += 1
        work.append((i, True))
        work += [(k, False) for k in reversed(children[i])]
    return out


def dominator_tree(blocks: DataFrame, edges: DataFrame, roots: DataFrame, keys: Sequence[str], node: str, src: str, dst: str) -> DataFrame:
    """keys, node, idom, enter, leave: a dominates b if a.enter <= b.enter <= a.leave. Nodes that the root does not reach stand alone.

    A graph (one value of the keys: a file, a method) is small and is handled in one call, in time linear but for rounds that its loops need; what it
    returns is one row for each node, where pairs of dominators would be their square.
    """
    kind = blocks.schema[node].dataType
    from pyspark.sql.types import IntegerType, StructField, StructType

    rows = blocks.select(*keys, F.col(node).alias("a"), F.lit(None).cast(kind).alias("b"), F.lit(0).alias("k"))
    rows = rows.unionByName(edges.select(*keys, F.col(src).cast(kind).alias("a"), F.col(dst).cast(kind).alias("b"), F.lit(1).alias("k")))
    rows = rows.unionByName(roots.select(*keys, F.col(node).cast(kind).alias("a"), F.lit(None).cast(kind).alias("b"), F.lit(2).alias("k")))
    schema = StructType([*[StructField(k, blocks.schema[k].dataType) for k in keys], StructField(node, kind), StructField("idom", kind), StructField("enter", IntegerType()), StructField("leave", IntegerType())])

    def go(key, table):
        import pyarrow as pa

        a, b, k = (table.column(x).to_pylist() for x in ("a", "b", "k"))
        nodes = sorted({x for x, y in zip(a, k, strict=True) if y != 1})
        known, succ = set(nodes), {}
        for x, to in sorted({(x, z) for x, z, y in zip(a, b, k, strict=True) if y == 1}):
            if x in known and to in known:
                succ.setdefault(x, []).append(to)
        start = [x for x, y in zip(a, k, strict=True) if y == 2]
        tree = _tree_of(nodes, succ, min(start)) if start else {}
        clock = len(tree)
        rows = []
        for i, x in enumerate(x for x in nodes if x not in tree):
            rows.append((x, None, clock + i, clock + i))
        rows += [(x, *v) for x, v in tree.items()]
        own = [pa.array([v.as_py()] * len(rows), v.type) for v in key]
        return pa.table([*own, *[pa.array([r[i] for r in rows], t) for i, t in enumerate((table.column("a").type, table.column("a").type, pa.int32(), pa.int32()))]], names=schema.names)

    return rows.groupBy(*keys).applyInArrow(go, schema)


def dominators(blocks: DataFrame, edges: DataFrame, roots: DataFrame, keys: Sequence[str], node: str, src: str, dst: str) -> DataFrame:
    """keys, node, dominator: who dominates whom, everyone itself; nodes that the root does not reach have themselves alone. For callers that want pairs."""
    tree = cut(dominator_tree(blocks, edges, roots, keys, node, src, dst))
    above = tree.select(*keys, F.col(node).alias("dominator"), F.col("enter").alias("_lo"), F.col("leave").alias("_hi"))
    return range_join(tree.select(*keys, node, "enter"), above, keys, "enter", "_lo", "_hi").select(*keys, node, "dominator")


def immediate_dominators(pairs: DataFrame, keys: Sequence[str], node: str) -> DataFrame:
    """keys, node, idom: of the strict dominators the one with the most dominators of its own."""
    depth = pairs.groupBy(*keys, F.col(node).alias("dominator")).agg(F.count("*").alias("depth"))
    strict = pairs.where(F.col(node) != F.col("dominator")).join(depth, [*keys, "dominator"])
    return first_match(strict, [*keys, node], [F.col("depth").desc()]).select(*keys, node, F.col("dominator").alias("idom"))


def natural_loops(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """file, loop_start, loop_end, loop_ord: a back edge's header start to its tail's end."""
    tail = blocks.select("file", F.col("id").alias("from"), F.col("end_line").alias("loop_end"))
    head = blocks.select("file", F.col("id").alias("to"), F.col("start_line").alias("loop_start"))
    back = edges.where("type = 'back'").select("file", "from", "to")
    return back.join(tail, ["file", "from"]).join(head, ["file", "to"]).select("file", "loop_start", "loop_end", F.col("from").alias("loop_tail"), F.col("to").alias("loop_head"))
