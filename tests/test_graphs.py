"""Components, traced searches and entry locks against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from holdfast.operators import graphs
from holdfast.plans import held
from holdfast.sources.sketches import Program


def plain_components(edges):
    """Nodes that reach each other, by a search from each."""
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    reach = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        reach[a] = seen
    groups = {a: frozenset({b for b in reach[a] if a in reach[b]} | {a}) for a in reach}
    return {(a, min(g), len(g)) for a, g in groups.items() if len(g) > 1}


def graph(seed: int) -> list[tuple[int, int]]:
    """Rings of several lengths, hung on each other and on trees, with loops and repeated edges."""
    r = random.Random(seed)
    edges, at = [], 0
    for n in [1, 2, 3, 5, 9, 1, 4]:
        ring = list(range(at, at + n))
        edges += list(zip(ring, ring[1:] + ring[:1]))
        at += n
    edges += [(r.randrange(at), r.randrange(at)) for _ in range(6)] + [(at + i, r.randrange(at + i)) for i in range(12)] + [(r.randrange(at), 90 + i) for i in range(6)]
    return [*edges, edges[4], (2, 2)]


@pytest.mark.parametrize("few", [graphs.FEW_EDGES, 4, 0])
def test_components_of_random_graphs(spark, few):
    for seed in range(3 if few > 4 else 1):
        edges = graph(seed)
        got = {tuple(x) for x in graphs.cycles(spark.createDataFrame(edges, "src long, dst long"), few).collect()}
        assert got == plain_components(edges)


def test_components_of_names_and_of_nothing(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("é", "é")]
    for few in (graphs.FEW_EDGES, 0):
        found = graphs.cycles(spark.createDataFrame(edges, "src string, dst string"), few)
        assert {tuple(x) for x in found.collect()} == {("a", "a", 2), ("b", "a", 2)}
        assert graphs.cycles(spark.createDataFrame([], "src string, dst string"), few).collect() == []


def test_a_ring_of_ten_thousand(spark):
    n = 10_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") * 3 + 1) % n).alias("dst")).unionByName(spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")))
    assert graphs.cycles(ring.where("dst = (src + 1) % 10000")).groupBy("component", "size").count().collect() == [(0, n, n)]
    # The other ring's edges make ways short enough for searches.
    assert graphs.cycles(ring, few=1000).groupBy("component", "size").count().collect() == [(0, n, n)]


def test_traced_ways_are_shortest_and_least(spark):
    r = random.Random(5)
    edges = [(r.randrange(30), r.randrange(30), i) for i in r.sample(range(1000), 70)]
    start = [(r.randrange(30), r.choice(["x", "y", None]), 100 + i, i) for i in range(6)]
    steps = graphs.traced(spark.createDataFrame(edges, "src long, dst long, via long"), spark.createDataFrame(start, "node long, label string, pred long, via long"), 5)
    dist: dict = {}
    for label in ("x", "y"):
        level = {n for n, x, _, _ in start if x == label}
        for d in range(1, 6):
            level = {n for n in level if (n, label) not in dist}
            dist |= {(n, label): d for n in level}
            level = {b for a, b, _ in edges if a in level}
    want = set()
    for (n, label), d in dist.items():
        ways = [(v, p) for m, x, p, v in start if (m, x) == (n, label)] if d == 1 else [(v, a) for a, b, v in edges if b == n and dist.get((a, label)) == d - 1]
        want.add((n, label, d, min(ways)[1]))
    assert {tuple(x) for x in steps.collect()} == want
    back = {(n, label): p for n, label, _, p in want}
    for x in graphs.paths(steps, 5).collect():
        assert len(x.path) == x.dist + 1 and x.path[-1] == x.node
        assert all(back[b, x.label] == a for a, b in zip(x.path, x.path[1:]))
    assert graphs.paths(steps, 5).count() == len(want)


def test_entry_locks_by_differences(spark, monkeypatch):
    """A chain of private methods, one lock deeper at each; where a lock is missing at one site, it ends."""
    p, c = Program(), "a.Chain"
    p.cls(c)
    lock = lambda n: [f"iget 0 3 {c}.m{n}", "enter 0"]
    p.method("first:()V", [*lock(0), f"direct 3 {c}.p0:()V", "exit 0", "return"], lines=1)
    for i in range(4):
        p.method(f"p{i}:()V", [*lock(i + 1), f"direct 3 {c}.p{i + 1}:()V", "exit 0", "return"], access=2, lines=10 + i)
    p.method("p4:()V", ["return"], access=2, lines=20)
    p.method("bare:()V", [*lock(2), f"direct 3 {c}.p3:()V", "exit 0", "return"], lines=30)
    p.method("loose:()V", ["return"], access=2, lines=40)
    _, methods, _ = p.tables(spark)
    walks = Counter()
    walked = held.walked

    def counting(methods, *rest):
        walks["rounds"] += 1
        walks["methods"] += methods.count()
        return walked(methods, *rest)

    monkeypatch.setattr(held, "walked", counting)
    got = {r.key.split(".")[-1].split(":")[0]: r.entry for r in held.entry_locks(methods, held.effects(methods)).collect()}
    m = lambda *n: [f"{c}.m{i}" for i in n]
    # p3 is called with m0 to m3 from p2, and with m2 alone from bare.
    assert got == {"p0": m(0), "p1": m(0, 1), "p2": m(0, 1, 2), "p3": m(2), "p4": m(2, 4)}
    assert walks["rounds"] > 2 and walks["methods"] < methods.count() + 14


def test_closure_makes_a_path_once(spark, monkeypatch):
    rows, kept = [], graphs.written
    monkeypatch.setattr(graphs, "written", lambda df, name: rows.append((out := kept(df, name)).count()) or out)
    monkeypatch.setattr("holdfast.storage.ROWS_EACH", 100)
    chain = spark.createDataFrame([(i, i + 1) for i in range(39)], "src long, dst long")
    got = {(r.src, r.dst): r.steps for r in graphs.closure(chain).collect()}
    assert got == {(a, b): b - a for a in range(40) for b in range(a + 1, 40)}
    # Every pair is made once and kept once.
    assert sum(rows) <= 2 * len(got)


def test_closure_of_random_graphs_and_nulls(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(25), draw.randrange(25)) for _ in range(40)] + [(3, None), (4, 3), (4, None), (4, 3)]
    want, level = {}, set(edges)
    for steps in range(1, 30):
        for e in level:
            want.setdefault(e, steps)
        level = {(a, d) for a, b in level for c, d in edges if b == c and b is not None} - set(want)
    got = graphs.closure(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert Counter((r.src, r.dst, r.steps) for r in got) == Counter((a, b, n) for (a, b), n in want.items())


def test_traced_by_hubs_is_traced_by_all_edges(spark):
    """Hubs in place of all pairs: distances and preds are the same."""
    r = random.Random(8)
    hubs = [(-1 - h, r.randrange(40)) for h in range(4) for _ in range(7)]
    hubs = sorted(set(hubs))
    short = [(r.randrange(40), r.choice([-1, -2, -3, -4, r.randrange(40)]), i) for i in r.sample(range(1000), 50)]
    start = [(r.choice([-1, r.randrange(40)]), r.choice(["x", "y", None]), 100 + i, i) for i in range(6)]
    to = lambda n: [n] if n >= 0 else [m for h, m in hubs if h == n]
    edges, long = spark.createDataFrame(short, "src long, dst long, via long"), "node long, label string, pred long, via long"
    got = graphs.traced(edges, spark.createDataFrame(start, long), 5, spark.createDataFrame(hubs, "hub long, node long"))
    all_edges = spark.createDataFrame([(a, m, v) for a, b, v in short for m in to(b)], edges.schema)
    want = graphs.traced(all_edges, spark.createDataFrame([(m, *rest) for n, *rest in start for m in to(n)], long), 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20


def test_many_components_side_by_side_take_few_rounds(spark, monkeypatch):
    """A thousand small rings that nothing joins, each with a tail: all are found at once, not one in each round."""
    n, tables, kept = 1000, [], graphs.written
    monkeypatch.setattr(graphs, "written", lambda df, name: tables.append(name) or kept(df, name))
    size = 2 + F.col("id") % 3
    rings = spark.range(n).select(F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("i"), "id", size.alias("n"))
    edges = rings.select((F.col("id") * 10 + F.col("i")).alias("src"), (F.col("id") * 10 + (F.col("i") + 1) % F.col("n")).alias("dst"))
    edges = edges.union(spark.range(n).select(F.col("id") * 10, F.col("id") * 10 + 9))
    got = {tuple(r) for r in graphs.cycles(edges, few=20).collect()}
    assert got == {(10 * k + i, 10 * k, 2 + k % 3) for k in range(n) for i in range(2 + k % 3)}
    assert tables.count("components") <= 2
