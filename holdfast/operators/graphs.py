"""Fixpoints over graphs: loops of joins and aggregates over written tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import parts_of, written

#: Edges that one task searches for components at once: some MB.
FEW_EDGES = 100_000
#: Times that nodes without a way in or out are trimmed before a search, at most.
TRIMS = 4


def closure(edges: DataFrame) -> DataFrame:
    """src, dst and the least number of steps, one at least, by doubling: paths join paths.

    When all paths of up to `span` steps are known, each longer one of up to twice as many begins with one of exactly `span` steps, so only
    those are joined with all that are known: a path is made once for each node at that distance, not once for each node on it.
    The rounds grow with the logarithm of the longest shortest path. What a round has made is counted before it is sorted out, and dealt
    to as many tasks as it needs; what is known already isn't written again.
    """
    spark = edges.sparkSession
    known = written(edges.select("src", "dst").distinct().withColumn("steps", F.lit(1)), "closure")
    size, span = known.count(), 1
    while True:
        far = known.where(F.col("steps") == span)
        n = parts_of(spark, size)
        left = far.select("src", F.col("dst").alias("mid")).repartition(n, "mid")
        right = known.select(F.col("src").alias("mid"), "dst", F.col("steps").alias("b")).repartition(n, "mid")
        made = written(left.join(right, "mid").select("src", "dst", (F.col("b") + span).alias("steps")), "closure-made")
        n_made = made.count()
        if not n_made:
            return known
        n = parts_of(spark, size + n_made)
        best = made.repartition(n, "src", "dst").groupBy("src", "dst").agg(F.min("steps").alias("steps")).alias("m")
        before = known.select("src", "dst").repartition(n, "src", "dst").alias("k")
        same = F.col("m.src").eqNullSafe(F.col("k.src")) & F.col("m.dst").eqNullSafe(F.col("k.dst"))
        new = written(best.join(before, same, "left_anti"), "closure")
        n_new = new.count()
        if not n_new:
            return known
        known, size, span = known.unionByName(new), size + n_new, 2 * span


def with_self(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The reflexive closure: every node of `nodes` (node) reaches itself in 0 steps."""
    self_ = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("steps"))
    return closure(edges).where("src <> dst").unionByName(self_)


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, label and dist: labels of `start` (node, label at distance 1) carried along edges up to `depth`.

    Costs are 1, so the least distance is the first level that a label reaches a node in; the
    fixpoint is a breadth-first search of at most `depth` rounds over what is new. A null label
    carries nothing.
    """
    level = written(start.select("node", "label").where("label is not null").distinct().withColumn("dist", F.lit(1)), "level")
    known, at = level, 1
    while at < depth and not level.isEmpty():
        at += 1
        moved = level.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), "label").distinct()
        level = written(moved.join(known, ["node", "label"], "left_anti").withColumn("dist", F.lit(at)), "level")
        # A written table a level: what is known already isn't written again.
        known = known.unionByName(level)
    return known


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All nodes at or after those of `start` (node)."""
    known = written(start.select("node").distinct(), "reachable")
    new = known
    while not new.isEmpty():
        moved = new.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node")).distinct()
        new = written(moved.join(known, "node", "left_anti"), "new")
        known = written(known.unionByName(new), "reachable")
    return known


def traced(edges: DataFrame, start: DataFrame, depth: int, hubs: DataFrame | None = None) -> DataFrame:
    """As `reach`, with pred: where a shortest way of the label to the node comes from.

    `edges` (src, dst, via) and `start` (node, label, pred, via); of several ways the least via decides, then the
    least pred. The level that first reaches a node settles its pred with it, so one search finds distances and ways.
    Nodes below zero of edges' dst and of `start` are `hubs` (hub, node): what comes to one is in the same step at all its nodes, by
    the same way; of those that bring a label to a hub only the best goes on.
    """
    way = lambda pred: F.min(F.struct("via", pred)).alias("way")
    edges = edges.withColumnRenamed("src", "pred")

    def arrived(rows: DataFrame) -> DataFrame:
        """node, label and the best way of rows (node, label, via, pred)."""
        if hubs is not None:
            rows = rows.select("node", "label", "via", "pred")
            best = rows.where("node < 0").groupBy(F.col("node").alias("hub"), "label").agg(way("pred"))
            rows = rows.where("node >= 0").unionByName(best.join(hubs, "hub").select("node", "label", "way.via", "way.pred"))
        return rows.groupBy("node", "label").agg(way("pred"))

    first = arrived(start.where("label is not null"))
    level = written(first.select("node", "label", F.lit(1).alias("dist"), "way.pred"), "level")
    known, at = level, 1
    while at < depth and not level.isEmpty():
        at += 1
        near = level.select(F.col("node").alias("pred"), "label")
        moved = arrived(near.join(edges, "pred").withColumnRenamed("dst", "node"))
        moved = moved.join(known, ["node", "label"], "left_anti")
        level = written(moved.select("node", "label", F.lit(at).alias("dist"), "way.pred"), "level")
        known = known.unionByName(level)
    return known


def paths(steps: DataFrame, depth: int) -> DataFrame:
    """node, label, dist and path of what `traced` gave: from the pred of distance 1, if there is one, down to the node.

    Lookups in `steps` alone, a level at a time; a way is as long as its distance.
    """
    level = steps.where("dist = 1").select("node", "label", "dist", F.array_compact(F.array("pred", "node")).alias("path"))
    out = level
    for at in range(2, depth + 1):
        nearer = level.select(F.col("node").alias("pred"), "label", F.col("path").alias("_path"))
        level = steps.where(F.col("dist") == at).join(nearer, ["pred", "label"])
        level = level.select("node", "label", "dist", F.concat("_path", F.array("node")).alias("path"))
        out = out.unionByName(level)
    return out


def strong(src: list[int], dst: list[int]) -> dict[int, int]:
    """The least node of each node's strongly connected component, in a graph that fits a task: depth first, without recursion."""
    out: dict[int, list[int]] = {}
    for a, b in zip(src, dst, strict=True):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order, low, label, open_ = {}, {}, {}, []
    for root in out:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        open_.append(root)
        way = [(root, iter(out[root]))]
        while way:
            node, rest = way[-1]
            for to in rest:
                if to not in order:
                    order[to] = low[to] = len(order)
                    open_.append(to)
                    way.append((to, iter(out[to])))
                    break
                if to not in label:
                    low[node] = min(low[node], order[to])
            else:
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[node])
                if low[node] == order[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(open_.pop())
                    label |= dict.fromkeys(own, min(own))
    return label


def cycles(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """node, component (its least node) and size, for strongly connected components of two nodes or more.

    Nodes are numbers or texts. In each round, nodes that no edge enters or none leaves are trimmed, edge by edge, a few times; then every node
    takes the greatest colour of all that lead to it, by a hash as good as drawn, and edges between colours go, as no component has two of them.
    What leads back to the node that a colour comes from, within the colour, is that node's component; all other nodes stay for the next
    round. So a round finds a component in each colour, however many there are side by side, and no table has more rows than nodes or edges.
    A search takes as many joins as its longest shortest way, and the rounds are about the logarithm of the number of components in a
    row. When no more than `few` edges are left, whatever the input was, one task does the rest.
    """
    kind = edges.schema["src"].dataType.simpleString()
    left = written(edges.select("src", "dst").where("src <> dst").distinct(), "open-edges")
    found = []

    def finish(batches):
        src, dst = [], []
        for batch in batches:
            src += batch.column(0).to_pylist()
            dst += batch.column(1).to_pylist()
        if src:
            label = strong(src, dst)
            yield pa.RecordBatch.from_arrays([pa.array(list(label), batch.column(0).type), pa.array(list(label.values()), batch.column(0).type)], ["node", "component"])

    while True:
        n = left.count()
        if n <= few:
            if n:
                found.append(left.select("src", "dst").coalesce(1).mapInArrow(finish, f"node {kind}, component {kind}"))
            break
        for _ in range(TRIMS):
            ends = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            left = written(left.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select(*left.columns), "open-edges")
            before, n = n, left.count()
            if n > 0.9 * before:
                break
        if not n:
            break
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        state = changed = written(nodes.select("node", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("root")).alias("colour")), "colours")
        while not changed.isEmpty():
            moved = changed.join(left.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("to"))
            changed = written(moved.join(state, "node").where("to > colour").select("node", F.col("to").alias("colour")), "colours-changed")
            state = written(state.join(changed, "node", "left_anti").unionByName(changed), "colours")
        state = state.select("node", F.col("colour.root").alias("root"))
        inside = left.join(state.withColumnRenamed("node", "src"), "src").join(state.withColumnRenamed("node", "dst"), ["dst", "root"])
        inside = written(inside.select("src", "dst"), "inside-colours")
        back = inside.select(F.col("dst").alias("node"), F.col("src").alias("to"))
        new = known = written(state.where("node = root"), "leading-back")
        while not new.isEmpty():
            moved = new.join(back, "node").select(F.col("to").alias("node"), "root").distinct()
            new = written(moved.join(known, "node", "left_anti"), "leading-back-new")
            known = known.unionByName(new)
        known = written(known, "leading-back")
        least = known.groupBy("root").agg(F.min("node").alias("component"))
        found.append(written(known.join(least, "root").select("node", "component"), "components"))
        gone = known.select(F.col("node").alias("src"))
        left = inside.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti")
        left = written(left.select("src", "dst"), "open-edges")
    if not found:
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}, size long")
    label = found[0]
    for more in found[1:]:
        label = label.unionByName(more)
    label = written(label, "component-labels")
    sizes = label.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return label.join(sizes, "component").select("node", "component", "size")
