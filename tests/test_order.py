"""Dependency order against a plain queue walk, one graph per pair."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from fleetdrift.operators import order
from fleetdrift.plans.all_queries import QUERIES


def queue_walk(keys, edges):
    """First-in-first-out walk; None when some node never becomes free."""
    needs = {n: {p for m, p in edges if m == n} for n in keys}
    queue = deque(sorted((n for n in keys if not needs[n]), key=keys.get))
    out = []
    while queue:
        taken = queue.popleft()
        out.append(taken)
        freed = []
        for n in keys:
            if taken in needs[n]:
                needs[n].discard(taken)
                if not needs[n]:
                    freed.append(n)
        queue.extend(sorted(freed, key=keys.get))
    return out if len(out) == len(keys) else None


def graphs(count, cyclic):
    rng = random.Random(11)
    for _ in range(count):
        n = rng.randint(0, 12)
        names = [f"k{i:02d}" for i in range(n)]
        rng.shuffle(names)
        keys = dict(enumerate(names))
        edges = [(a, rng.randrange(a)) for a in range(1, n) for _ in range(rng.randint(0, 3))]
        if cyclic and n > 2 and rng.random() < 0.4:
            a = rng.randrange(n)
            edges.append((rng.randrange(a + 1), a))
        yield keys, edges


def frames(spark, all_graphs):
    nodes = [(g, n, k) for g, (keys, _) in enumerate(all_graphs) for n, k in keys.items()]
    edges = [(g, a, b) for g, (_, es) in enumerate(all_graphs) for a, b in es]
    return (
        spark.createDataFrame(nodes, "pair_id int, node int, node_key string"),
        spark.createDataFrame(edges, "pair_id int, node int, prereq int"),
    )


def on_cycles(edges):
    """Nodes that reach themselves, by following all edges."""
    reached = set(edges)
    while more := {(a, d) for a, b in reached for c, d in edges if b == c} - reached:
        reached |= more
    return {a for a, b in reached if a == b}


# Pairs of more rows than that are walked by joins, the others together.
@pytest.mark.parametrize(("cyclic", "local_rows"), [(False, 10**6), (True, 10**6), (False, 24), (True, 24)])
def test_same_order_as_a_queue_walk(spark, cyclic, local_rows):
    all_graphs = list(graphs(150, cyclic))
    nodes, edges = frames(spark, all_graphs)
    found = {}
    rows = order.topological_order(nodes, edges, local_rows=local_rows).orderBy("pair_id", "position").collect()
    for r in rows:
        found.setdefault(r.pair_id, []).append(r.node)
    expected = {g: queue_walk(*graph) for g, graph in enumerate(all_graphs)}
    assert found == {g: o for g, o in expected.items() if o}
    assert all(a.rank == 1 or (b.level, b.rank) == (a.level, a.rank - 1) for b, a in zip(rows, rows[1:]))
    report = order.cycle_report(nodes, edges, local_rows=local_rows).collect()
    assert {r.pair_id for r in report} == {g for g, o in expected.items() if o is None}
    members = {(g, n) for g, (_, es) in enumerate(all_graphs) for n in on_cycles(es)}
    assert {(r.pair_id, r.node) for r in report if r.in_cycle} == members and bool(members) == cyclic


def best_paths(keys, edges):
    """The longest, then greatest path to every node by trying all prerequisites; null is the greatest key."""
    found = {}
    for n in sorted(keys):  # prerequisites have smaller numbers
        found[n] = max((found[p] for m, p in edges if m == n), key=lambda p: (len(p), [(k is None, k or "") for k in p]), default=[]) + [keys[n]]
    return found


@pytest.mark.parametrize("local_rows", [10**6, 12])
@pytest.mark.parametrize("alphabet", ["", "ab", ["a", "b", None]])
def test_paths_are_the_longest_then_greatest(spark, local_rows, alphabet):
    """Also where keys repeat in a pair or are null."""
    rng = random.Random(5)
    all_graphs = [({n: rng.choice(alphabet) if alphabet else k for n, k in keys.items()}, edges) for keys, edges in graphs(60, False)]
    nodes, edges = frames(spark, all_graphs)
    ordered = order.with_paths(order.topological_order(nodes, edges, local_rows=local_rows))
    assert ordered.columns == ["pair_id", "node", "node_key", "level", "rank", "position", "path"]
    rows = ordered.collect()
    expected = {(g, n): p for g, graph in enumerate(all_graphs) for n, p in best_paths(*graph).items()}
    assert len(rows) == len(expected) and {(r.pair_id, r.node): r.path for r in rows} == expected
    assert all(len(r.path) == r.level for r in rows)


def test_paths_of_a_chain_and_of_no_nodes(spark):
    nodes = spark.range(300).selectExpr("7L AS pair_id", "id AS node", "string(id) AS node_key")
    edges = spark.range(1, 300).selectExpr("7L AS pair_id", "id AS node", "id - 1 AS prereq")
    rows = order.with_paths(order.topological_order(nodes, edges)).collect()
    assert {r.node: r.path for r in rows} == {n: [str(k) for k in range(n + 1)] for n in range(300)}
    # Nodes without a pair are kept, whatever their edges.
    unpaired = [x.withColumn("pair_id", F.lit(None).cast("long")) for x in (nodes.where("node < 9"), edges.where("node < 9"))]
    assert order.with_paths(order.topological_order(*unpaired)).count() == 9
    assert order.with_paths(order.topological_order(nodes.where("false"), edges.where("false"))).isEmpty()


def test_the_registered_order_lists_paths(spark, tmp_path):
    """One customer of six orders, one of a null priority, and orders without a customer."""
    rows = [(1, n, "abcdef"[n]) for n in range(6)] + [(2, 6, None), (None, 7, "y"), (None, 8, "z")]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["topological_order"](spark, str(tmp_path))

    def path(nodes):
        return "/".join(f"{'abcdef'[n]}#{n:010d}" for n in nodes)

    expected = {  # order n needs those of half and a third of its number
        (1, 0, 1, path([0]), 1, 1), (1, 1, 2, path([0, 1]), 2, 1), (1, 2, 2, path([0, 2]), 3, 2),
        (1, 3, 3, path([0, 1, 3]), 4, 1), (1, 4, 3, path([0, 1, 4]), 5, 2), (1, 5, 3, path([0, 2, 5]), 6, 3),
        (2, 6, 1, None, 1, 1), (None, 7, 1, "y#0000000007", 1, 1), (None, 8, 1, "z#0000000008", 2, 2),
    }
    assert found.columns == ["pair_id", "node", "level", "path", "position", "rank"]
    assert {tuple(r) for r in found.collect()} == expected


def test_a_chain_of_5000_nodes(spark):
    """The state of a node does not grow with its level."""
    nodes = spark.range(5000).selectExpr("7L AS pair_id", "id AS node", "lpad(string((id * 7919) % 5000), 5, '0') AS node_key")
    edges = spark.range(1, 5000).selectExpr("7L AS pair_id", "id AS node", "id - 1 AS prereq")
    rows = order.topological_order(nodes, edges).collect()
    assert len(rows) == 5000 and all(r.node == r.position - 1 == r.level - 1 and r.rank == 1 for r in rows)
    closed = edges.unionByName(spark.range(1).selectExpr("7L AS pair_id", "1000L AS node", "3999L AS prereq"))
    report = order.cycle_report(nodes, closed).collect()
    assert {r.node for r in report} == set(range(1000, 5000))
    assert {r.node for r in report if r.in_cycle} == set(range(1000, 4000))


def test_tie_is_broken_by_queue_not_by_key(spark):
    """With A and Z free and B after A the walk gives A, Z, B."""
    nodes, edges = frames(spark, [({0: "A", 1: "Z", 2: "B"}, [(2, 0)])])
    rows = order.topological_order(nodes, edges).orderBy("position").collect()
    assert [r.node for r in rows] == [0, 1, 2]
    undone = order.rollback_order(order.topological_order(nodes, edges)).collect()
    assert [r.node for r in sorted(undone, key=lambda r: r.undo_position)] == [2, 1, 0]


def test_cycle_report_lists_members_and_what_needs_them(spark):
    graph = ({0: "a", 1: "b", 2: "c", 3: "d", 4: "e"}, [(1, 2), (2, 1), (3, 2), (4, 0)])
    nodes, edges = frames(spark, [graph])
    assert sorted(r.node for r in order.cycle_report(nodes, edges).collect()) == [1, 2, 3]
    assert order.topological_order(nodes, edges).isEmpty()


def test_unknown_names_and_repeated_edges(spark):
    graph = ({0: "a", 1: "b"}, [(1, 0), (1, 0), (1, 9), (8, 0)])
    nodes, edges = frames(spark, [graph])
    assert sorted((r.node, r.prereq, r.problem) for r in order.unknown_prerequisites(nodes, edges).collect()) == [
        (1, 9, "unknown prerequisite"), (8, 0, "unknown dependent"),
    ]
    assert order.topological_order(nodes, edges).isEmpty()
    assert order.distinct_prerequisites(edges).count() == 3
    assert [r.node for r in order.root_nodes(nodes, edges).collect()] == [0]
    assert {r.node: r.dependencies for r in order.dependency_count(nodes, edges).collect()} == {0: 0, 1: 2}
