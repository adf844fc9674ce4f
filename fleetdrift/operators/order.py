"""Ordering nodes by their prerequisites, for all pairs at once.

The order is the one a first-in-first-out walk gives: start with all nodes
without prerequisites in key order; whenever a node is taken, the nodes it frees
join the end of the queue in key order.  That order has a closed form.  A node's
level is one more than the greatest level among its prerequisites; within a level
nodes go by the rank of their best prerequisite on the level before, then by
their own key.  So (level, rank) is all a node has to carry.

The path of a node is the best path among its prerequisites, longest first, then
greatest, with the node's own key appended.  A node also carries ``via``, the rank
of the prerequisite its path goes through; ``with_paths`` puts the paths together.

Pairs of up to ``LOCAL_ROWS`` nodes and edges share tasks, many pairs in each, and
their levels are taken one by one on arrays.  Larger pairs spread over all tasks:
every level is a join of its nodes with the edges not used yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetdrift.session import cut_lineage
from fleetdrift.skew import BROADCAST_GROUPS, positions

NODE = ["pair_id", "node"]
#: Nodes and edges of one pair that a single task may hold, and those of all pairs that share one on average.
LOCAL_ROWS = 200_000
TASK_ROWS = 20_000


def distinct_prerequisites(edges: DataFrame) -> DataFrame:
    """Each ``pair_id, node, prereq`` once."""
    return edges.select("pair_id", "node", "prereq").distinct()


def unknown_prerequisites(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges naming a prerequisite, or a dependent, that is not a node."""
    known = nodes.select(*NODE)
    known_prereq = known.withColumnRenamed("node", "prereq")
    distinct = distinct_prerequisites(edges)
    no_prereq = distinct.join(known_prereq, ["pair_id", "prereq"], "left_anti").select(
        *NODE, "prereq", F.lit("unknown prerequisite").alias("problem")
    )
    no_node = distinct.join(known, NODE, "left_anti").select(
        *NODE, "prereq", F.lit("unknown dependent").alias("problem")
    )
    return no_prereq.unionByName(no_node)


# --- pairs that share a task ---


def _levels(
    n: int, dependent: np.ndarray, prereq: np.ndarray, key: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Level (0: never reached), place in the walk, open prerequisites and prerequisite on the path (-1: none).

    Nodes are numbered in key order; ``key`` is equal for equal keys of one pair.
    Places grow from level to level, so the greatest place among a node's
    prerequisites is its best one on the level before.  So do the numbers of
    paths, which nodes of equal paths share.
    """
    by_prereq = np.argsort(prereq, kind="stable")
    dependent, ends = dependent[by_prereq], np.searchsorted(prereq[by_prereq], np.arange(n + 1))
    missing = np.bincount(dependent, minlength=n)
    level, place, best = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    path, best_path, with_path = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    ready, taken, depth = np.flatnonzero(missing == 0), 0, 0
    while len(ready):
        depth += 1
        ready = ready[np.lexsort((ready, best[ready]))]
        level[ready], place[ready] = depth, taken + np.arange(len(ready))
        by_path = ready[np.lexsort((key[ready], best_path[ready]))]
        other = (np.diff(best_path[by_path], prepend=-2) != 0) | (np.diff(key[by_path], prepend=-1) != 0)
        path[by_path] = taken + np.cumsum(other) - 1
        with_path[path[by_path]] = by_path
        taken += len(ready)
        counts = ends[ready + 1] - ends[ready]
        first = np.cumsum(counts) - counts
        freed = dependent[np.arange(counts.sum()) + np.repeat(ends[ready] - first, counts)]
        np.maximum.at(best, freed, np.repeat(place[ready], counts))
        np.maximum.at(best_path, freed, np.repeat(path[ready], counts))
        nodes, times = np.unique(freed, return_counts=True)
        missing[nodes] -= times
        ready = nodes[missing[nodes] == 0]
    return level, place, missing, np.where((level > 0) & (best_path >= 0), with_path[best_path], -1)


def _on_cycles(n: int, dependent: np.ndarray, prereq: np.ndarray) -> np.ndarray:
    """Which nodes reach themselves: members of strongly connected components that hold an edge."""
    out: list[list[int]] = [[] for _ in range(n)]
    cyclic = np.zeros(n, bool)
    for a, b in zip(prereq.tolist(), dependent.tolist(), strict=True):
        out[a].append(b)
        if a == b:
            cyclic[a] = True
    seen, low, open_, stack = [0] * n, [0] * n, [False] * n, []
    clock = 0
    for start in range(n):
        if seen[start]:
            continue
        walk: list[tuple[int, Iterator[int]]] = [(start, iter(out[start]))]
        clock += 1
        seen[start] = low[start] = clock
        stack.append(start)
        open_[start] = True
        while walk:
            node, rest = walk[-1]
            following = next(rest, None)
            if following is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == seen[node]:
                    members = [stack.pop()]
                    while members[-1] != node:
                        members.append(stack.pop())
                    for m in members:
                        open_[m] = False
                    if len(members) > 1:
                        cyclic[members] = True
            elif not seen[following]:
                clock += 1
                seen[following] = low[following] = clock
                stack.append(following)
                open_[following] = True
                walk.append((following, iter(out[following])))
            elif open_[following]:
                low[node] = min(low[node], seen[following])
    return cyclic


def _walk_together(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The walk over all pairs that share a task."""
    nodes = nodes.sort_values(["node_key", "node"]).drop_duplicates(NODE, ignore_index=True)
    edges = edges.drop_duplicates()
    numbers = nodes[NODE].assign(number=np.arange(len(nodes)))

    def number(column: str) -> np.ndarray:
        found = edges[["pair_id", column]].merge(numbers, "left", left_on=["pair_id", column], right_on=NODE)["number"]
        return found.fillna(-1).to_numpy(np.int64)

    dependent, prereq = number("node"), number("prereq")
    known = (dependent >= 0) & (prereq >= 0)
    incomplete = edges["pair_id"][~known].unique()
    dependent, prereq = dependent[known], prereq[known]
    pair, key = (nodes[c].factorize(use_na_sentinel=False)[0] for c in ("pair_id", "node_key"))
    level, place, missing, through = _levels(len(nodes), dependent, prereq, key * len(nodes) + pair)
    stuck = (missing[dependent] > 0) & (missing[prereq] > 0)
    cyclic = _on_cycles(len(nodes), dependent[stuck], prereq[stuck]) if stuck.any() else np.zeros(len(nodes), bool)
    rows = nodes.assign(level=level, place=place, missing=missing, in_cycle=cyclic, through=through)
    rows = rows.sort_values("place")
    rows["rank"] = rows.groupby(["pair_id", "level"], dropna=False).cumcount() + 1
    rows["via"] = np.where(rows["through"] >= 0, rows["rank"].sort_index().to_numpy()[rows["through"]], 0)
    left = rows["pair_id"].isin(rows["pair_id"][rows["missing"] > 0].unique())
    rows["ordered"] = ~left & ~rows["pair_id"].isin(incomplete)
    rows["position"] = rows.groupby("pair_id", dropna=False).cumcount() + 1
    return rows[["pair_id", "node", "node_key", "level", "rank", "via", "position", "missing", "in_cycle", "ordered"]]


# --- pairs larger than a task ---


def _known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    as_prereq = nodes.select("pair_id", F.col("node").alias("prereq"))
    return edges.join(nodes.select(*NODE), NODE, "left_semi").join(as_prereq, ["pair_id", "prereq"], "left_semi")


def _numbered_paths(ready: DataFrame) -> DataFrame:
    """The nodes of a level with ``path``, a number that nodes of equal paths share and that grows with the path."""
    ready = cut_lineage(ready)
    # Null keys come last, as in the other walk.
    placed = positions(
        ready.withColumn("unnamed", F.col("node_key").isNull()), ["pair_id"], ["best_path", "unnamed", "node_key", "node"], "place"
    )
    equal = ["pair_id", "best_path", "node_key"]
    numbers = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in equal]).agg(F.min("place").alias("path"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in equal]
    return ready.join(numbers, same).select(*ready.columns, "path")


def _walk_apart(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The walk by joins, a round per level: level, rank, via and missing (0 level: never reached).

    Only the nodes of the last level meet the edges, and used edges are dropped
    whenever half of them are, so all rounds together read few times the edges.
    """
    nodes = nodes.groupBy(*NODE).agg(F.min("node_key").alias("node_key"))
    edges = cut_lineage(_known_edges(nodes, distinct_prerequisites(edges)))
    degrees = edges.groupBy(*NODE).agg(F.count(F.lit(1)).alias("missing"))
    waiting = cut_lineage(nodes.join(degrees, NODE, "left").select(*NODE, "node_key", F.coalesce("missing", F.lit(0)).alias("missing")))
    none = F.lit(0).cast("long")
    ready = waiting.where("missing = 0").select(*NODE, "node_key", *[none.alias(c) for c in ("best", "best_path", "via")])
    waiting = waiting.where("missing > 0")
    # With keys of their own, nodes go by their paths, whose numbers are the ranks.
    repeated = nodes.groupBy("pair_id", "node_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR node_key IS NULL")
    distinct_keys = repeated.isEmpty()
    levels, kept, used = [], edges.count(), 0
    while True:
        ranked = positions(ready, ["pair_id"], ["best", "node_key", "node"], "rank")
        ranked = ranked.withColumn("path", F.col("rank")) if distinct_keys else _numbered_paths(ranked)
        level = cut_lineage(ranked.select(*NODE, "node_key", F.lit(len(levels) + 1).alias("level"), "rank", "via", "path"))
        if level.isEmpty():
            break
        levels.append(level)
        taken = level.select("pair_id", F.col("node").alias("prereq"), "rank", "path")
        freed = cut_lineage(
            edges.join(taken, ["pair_id", "prereq"]).groupBy(*NODE).agg(
                F.count(F.lit(1)).alias("freed"), F.max("rank").alias("best"), F.max(F.struct("path", "rank")).alias("through")
            )
        )
        used += freed.agg(F.sum("freed")).first()[0] or 0
        state = cut_lineage(
            waiting.join(freed, NODE, "left").select(
                *NODE, "node_key", (F.col("missing") - F.coalesce("freed", F.lit(0))).alias("missing"), "best",
                F.col("through.path").alias("best_path"), F.col("through.rank").alias("via"),
            )
        )
        ready = state.where("missing = 0").drop("missing")
        waiting = state.where("missing > 0").drop("best", "best_path", "via")
        if 2 * used > kept:
            done = waiting.select(*NODE)
            edges = cut_lineage(edges.join(done, NODE, "left_semi"))
            kept, used = edges.count(), 0
    out = waiting.select(*NODE, "node_key", F.lit(0).alias("level"), none.alias("rank"), none.alias("via"), "missing")
    for level in levels:
        out = out.unionByName(level.drop("path").withColumn("missing", none))
    return out


def cycle_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``pair_id, node`` of the nodes that reach themselves, by joins.

    Nodes that nothing left needs are trimmed away first.  Then the greatest
    number reaching a node is its colour; what reaches the colour's own node
    within the colour is one strongly connected component.  Components leave, and
    the rest is coloured again.
    """
    found = edges.where(F.col("node") == F.col("prereq")).select(*NODE).distinct()
    edges = edges.where(F.col("node") != F.col("prereq"))
    numbered = nodes.select(*NODE).distinct().select(*NODE, F.struct(F.xxhash64(*NODE), "node").alias("colour"))
    edges, numbered = cut_lineage(distinct_prerequisites(_known_edges(numbered, edges))), cut_lineage(numbered)

    before = -1
    while (now := edges.count()) != before:
        # A node on a cycle has a prerequisite and a dependent among the rest.
        before = now
        alive = edges.select(*NODE).join(edges.select("pair_id", F.col("prereq").alias("node")), NODE, "left_semi").distinct()
        edges = cut_lineage(_known_edges(cut_lineage(alive), edges))
    while now:
        alive = edges.select(*NODE).distinct()
        colours = cut_lineage(numbered.join(alive, NODE, "left_semi"))
        while True:
            given = edges.join(colours.select("pair_id", F.col("node").alias("prereq"), "colour"), ["pair_id", "prereq"])
            given = given.groupBy(*NODE).agg(F.max("colour").alias("given"))
            later = F.coalesce(F.col("given") > F.col("colour"), F.lit(False))
            spread = cut_lineage(
                colours.join(given, NODE, "left").select(*NODE, F.when(later, F.col("given")).otherwise(F.col("colour")).alias("colour"), later.alias("later"))
            )
            colours = spread.drop("later")
            if spread.where("later").isEmpty():
                break
        marked = cut_lineage(colours.where(F.col("colour.node") == F.col("node")))
        own = colours.select("pair_id", F.col("node").alias("prereq"), F.col("colour").alias("own"))
        last = marked
        while True:
            reach = (
                edges.join(last, NODE).join(own, ["pair_id", "prereq"]).where(F.col("own") == F.col("colour"))
                .select("pair_id", F.col("prereq").alias("node"), "colour").distinct().join(marked.select(*NODE), NODE, "left_anti")
            )
            last = cut_lineage(reach)
            if last.isEmpty():
                break
            marked = cut_lineage(marked.unionByName(last))
        sizes = marked.groupBy("pair_id", "colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = cut_lineage(found.unionByName(marked.join(sizes, ["pair_id", "colour"], "left_semi").select(*NODE)))
        rest = cut_lineage(colours.select(*NODE).join(marked.select(*NODE), NODE, "left_anti"))
        edges = cut_lineage(_known_edges(rest, edges))
        now = edges.count()
    return found.distinct()


# --- both ---


def walk(nodes: DataFrame, edges: DataFrame, *, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Every node with ``level, rank, via, position, missing, in_cycle`` and whether its pair is ``ordered``.

    A pair is ordered if all its nodes are reached and all its edges are between
    nodes; level is 0 and ``missing`` counts the open prerequisites elsewhere.
    ``via`` is 0 on the first level.
    """
    # Edges are often made from the nodes: their columns get identities of their own.
    nodes, edges = nodes.select(*NODE, "node_key"), edges.select(*[F.col(c).alias(c) for c in (*NODE, "prereq")])
    sizes = nodes.select("pair_id").unionByName(edges.select("pair_id")).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    total, large = sizes.agg(F.sum("n"), F.count_if(F.col("n") > local_rows)).first()
    tasks = (total or 0) // TASK_ROWS + 1

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("task", F.pmod(F.xxhash64("pair_id"), F.lit(tasks)))

    if large:
        hot = cut_lineage(sizes.where(F.col("n") > local_rows).select("pair_id"))
        hot = F.broadcast(hot) if large <= BROADCAST_GROUPS else hot
        small_nodes, small_edges = (x.join(hot, "pair_id", "left_anti") for x in (nodes, edges))
    else:
        small_nodes, small_edges = nodes, edges
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    schema = (
        f"pair_id {kinds['pair_id']}, node {kinds['node']}, node_key {kinds['node_key']}, level int, rank long, "
        "via long, position long, missing long, in_cycle boolean, ordered boolean"
    )
    together = dealt(small_nodes).groupBy("task").cogroup(dealt(small_edges).groupBy("task")).applyInPandas(
        lambda n, e: _walk_together(n[[*NODE, "node_key"]], e[[*NODE, "prereq"]]), schema
    )
    if not large:
        return together
    big_nodes, big_edges = (cut_lineage(x.join(hot, "pair_id", "left_semi")) for x in (nodes, edges))
    apart = cut_lineage(_walk_apart(big_nodes, big_edges))
    stuck = apart.where("missing > 0").select(*NODE)
    members = cycle_members(stuck, _known_edges(stuck, big_edges)).withColumn("in_cycle", F.lit(True))
    bad = stuck.select("pair_id").unionByName(unknown_prerequisites(big_nodes, big_edges).select("pair_id")).distinct()
    bad = bad.withColumn("bad", F.lit(True))
    marked = apart.join(members, NODE, "left").join(bad, "pair_id", "left")
    placed = positions(marked, ["pair_id"], ["level", "rank"])
    return together.unionByName(
        placed.select(
            *NODE, "node_key", "level", "rank", "via", "position", "missing", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
            F.col("bad").isNull().alias("ordered"),
        )
    )


def topological_order(nodes: DataFrame, edges: DataFrame, *, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Nodes with ``level``, their ``rank`` in it, ``via`` and 1-based ``position`` within their pair.

    ``nodes``: pair_id, node, node_key; ``edges``: pair_id, node, prereq.  ``via``
    is what ``with_paths`` makes paths from.  Pairs
    with an unknown prerequisite or a cycle have no order and are left out; see
    ``unknown_prerequisites`` and ``cycle_report`` for them.
    """
    walked = walk(nodes, edges, local_rows=local_rows)
    return walked.where("ordered").select(*NODE, "node_key", "level", "rank", "via", "position")


def with_paths(ordered: DataFrame) -> DataFrame:
    """An order with ``path`` instead of ``via``: the keys from a root to the node along its longest, then greatest path.

    Every path takes the path so far of the node it goes on from in front, so paths
    double each round and rounds are the logarithm of the levels.
    """
    paths = cut_lineage(ordered.withColumn("path", F.array("node_key")))
    deepest, reach = paths.agg(F.max("level")).first()[0] or 0, 1
    while reach < deepest:
        # A path that is not whole begins at level - reach + 1.
        heads = paths.where(F.col("level") <= deepest - reach).select(
            *[F.col(c).alias(f"_{c}") for c in ("pair_id", "level", "rank", "path", "via")]
        )
        goes_on = [
            F.col("pair_id").eqNullSafe(F.col("_pair_id")), F.col("level") - reach == F.col("_level"), F.col("via") == F.col("_rank")
        ]
        grown = paths.where("via > 0").join(heads, goes_on).withColumns({"path": F.concat("_path", "path"), "via": F.col("_via")})
        paths = cut_lineage(paths.where("via = 0").unionByName(grown.select(*paths.columns)))
        reach *= 2
    return paths.drop("via")


def cycle_report(nodes: DataFrame, edges: DataFrame, *, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Nodes that never become free, those on cycles told apart from those that only need them."""
    left = walk(nodes, edges, local_rows=local_rows).where("missing > 0")
    return left.select(*NODE, "node_key", F.col("missing").alias("open_prerequisites"), "in_cycle")


def root_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any prerequisite, listed among the edges or not."""
    return nodes.join(edges.select(*NODE), NODE, "left_anti")


def rollback_order(ordered: DataFrame) -> DataFrame:
    """The reverse of an order with its own ``undo_position``: last applied is undone first."""
    last = ordered.groupBy("pair_id").agg(F.max("position").alias("_last"))
    return ordered.join(last, "pair_id").select(
        *ordered.columns, (F.col("_last") - F.col("position") + 1).alias("undo_position")
    )


def dependency_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of distinct prerequisites of every node."""
    counts = distinct_prerequisites(edges).groupBy(*NODE).agg(F.count(F.lit(1)).alias("_n"))
    return (
        nodes.select(*NODE)
        .join(counts, NODE, "left")
        .select(*NODE, F.coalesce("_n", F.lit(0)).alias("dependencies"))
    )
