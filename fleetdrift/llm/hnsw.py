"""Nearest neighbours by inner product: one navigable small-world graph per shard, results merged.

Rows are dealt to shards of about ``SHARD_ROWS`` of like length (within a factor of
two), by a hash of vec_id.  Each
shard's graph is built and stored as rows with flat neighbour arrays.  Queries
are dealt into blocks; each block searches every shard, and the shards' best are
merged.  Inner products become distances by one more coordinate that brings all
vectors of a shard to one length.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither do null vec_ids; only vectors of equal length
are compared; rows repeated with one vec_id count once (the smallest vector);
equal vectors are one node of the graph and all of them are found; ties go to
the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetdrift.llm.storage import stored

SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
DEGREE = 16
EF_BUILD, EF_SEARCH = 96, 160
#: Candidates kept per dimension, where that is more than EF_SEARCH.
WIDER = 1.75
_NONE = np.float32(np.inf)


class Graph:
    """Flat neighbour arrays: ``links[level][node]`` holds neighbours, -1 where there are fewer."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, ef: int = EF_BUILD, seed: int = 5):
        self.points, self.degree, self.ef = np.ascontiguousarray(points, np.float32), degree, ef
        n = len(points)
        draws = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(degree)).astype(np.int64), 6)
        top = int(self.levels.max(initial=0))
        self.links = [np.full((n, 2 * degree if level == 0 else degree), -1, np.int32) for level in range(top + 1)]
        self.entry = 0
        if n:
            self._build()

    @classmethod
    def load(cls, points: np.ndarray, links: list[np.ndarray], entry: int) -> Graph:
        graph = cls(points[:0])
        graph.points, graph.links, graph.entry = np.ascontiguousarray(points, np.float32), links, entry
        return graph

    def _build(self) -> None:
        # Highest levels first, so every batch finds its levels' graphs present.
        order = np.argsort(-self.levels, kind="stable")
        self.entry = int(order[0])
        done = 1
        while done < len(order):
            batch = order[done : done + min(max(done // 2, 1), 256)]
            self._insert(batch, order[:done])
            done += len(batch)

    def _insert(self, batch: np.ndarray, present: np.ndarray) -> None:
        queries = self.points[batch]
        mates = self._square(queries, batch)
        near = np.full((len(batch), 1), self.entry, np.int64)
        for level in range(len(self.links) - 1, -1, -1):
            ids, far = self._beam(queries, near, level, self.ef if (self.levels[batch] >= level).any() else 1)
            near = np.where(ids[:, :8] >= 0, ids[:, :8], ids[:, :1])
            mine = np.flatnonzero(self.levels[batch] >= level)
            if not len(mine):
                continue
            # Rows of one batch see each other too.
            others = np.where((mine[:, None] != mine[None, :]), mates[np.ix_(mine, mine)], _NONE)
            ids = np.hstack([ids[mine], np.broadcast_to(batch[mine], others.shape)])
            far = np.hstack([far[mine], others])
            kept, _ = self._spread(ids, far, self.degree)
            width = self.links[level].shape[1]
            self.links[level][batch[mine], : kept.shape[1]] = kept
            self._link_back(level, np.repeat(batch[mine], kept.shape[1]), kept.ravel(), width)

    def _square(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        points = self.points[ids]
        d = (queries**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * queries @ points.T
        return np.maximum(d, 0).astype(np.float32)

    def _link_back(self, level: int, sources: np.ndarray, targets: np.ndarray, width: int) -> None:
        real = targets >= 0
        sources, targets = sources[real], targets[real].astype(np.int64)
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        nodes, first, counts = np.unique(targets, return_index=True, return_counts=True)
        place = np.arange(len(targets)) - np.repeat(first, counts)
        new = np.full((len(nodes), int(counts.max(initial=0))), -1, np.int64)
        new[np.repeat(np.arange(len(nodes)), counts), place] = sources
        old = self.links[level][nodes]
        ids = np.hstack([old, new])
        ids = np.where(ids == nodes[:, None], -1, ids)
        far = self._far(self.points[nodes], ids)
        full = (ids >= 0).sum(1) > width
        packed = np.argsort(np.where(ids >= 0, far, _NONE), axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(ids, packed, 1)
        if full.any():
            kept, _ = self._spread(ids[full], far[full], width)
            out[full] = -1
            out[full, : kept.shape[1]] = kept
        self.links[level][nodes, : out.shape[1]] = out

    def _far(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        points = self.points[np.maximum(ids, 0)]
        d = ((points - queries[:, None, :]) ** 2).sum(2)
        return np.where(ids >= 0, d, _NONE).astype(np.float32)

    def _spread(self, ids: np.ndarray, far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours in different directions: the nearest, then those nearer to the node than to any kept one.

        Rows left short are filled with the nearest of the rest.
        """
        order = np.argsort(far, axis=1, kind="stable")[:, : max(self.ef, most)]
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        real = np.isfinite(far) & (ids >= 0)
        points = self.points[np.maximum(ids, 0)]
        between = np.einsum("qad,qbd->qab", points, points)
        norms = np.einsum("qad,qad->qa", points, points)
        between = norms[:, :, None] + norms[:, None, :] - 2 * between
        kept = np.zeros(ids.shape, bool)
        nearest_kept = np.full(ids.shape, _NONE)
        for j in range(ids.shape[1]):
            good = real[:, j] & (far[:, j] < nearest_kept[:, j]) & (kept.sum(1) < most)
            kept[good, j] = True
            nearest_kept = np.where(good[:, None], np.minimum(nearest_kept, between[:, j, :]), nearest_kept)
        rank = np.argsort(np.where(kept, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(real, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        return out, np.take_along_axis(far, rank, 1)

    def _beam(self, queries: np.ndarray, start: np.ndarray, level: int, ef: int, at_once: int = 4):
        """The ``ef`` nearest found for all queries in step: ids (-1 padded) and distances, nearest first."""
        q = len(queries)
        rows = np.arange(q)[:, None]
        visited = np.zeros((q, len(self.points) + 1), bool)  # the last column takes the padding
        start = np.sort(start, axis=1)
        start = np.where(np.hstack([np.zeros((q, 1), bool), start[:, 1:] == start[:, :-1]]), -1, start)
        visited[rows, start] = True
        ids = np.full((q, ef), -1, np.int64)
        far = np.full((q, ef), _NONE)
        d = self._far(queries, start)
        keep = np.argsort(d, axis=1)[:, :ef]
        ids[:, : keep.shape[1]], far[:, : keep.shape[1]] = np.take_along_axis(start, keep, 1), np.take_along_axis(d, keep, 1)
        open_ = np.isfinite(far)
        links = self.links[level]
        lengths = (self.points**2).sum(1)
        own = (queries**2).sum(1)
        active = np.arange(q)
        at_once = min(at_once, ef)
        while len(active):
            waiting = np.where(open_[active], far[active], _NONE)
            pick = np.argpartition(waiting, at_once - 1, axis=1)[:, :at_once] if ef > at_once else np.argsort(waiting, axis=1)
            chosen = np.isfinite(np.take_along_axis(waiting, pick, 1))
            open_[active[:, None], pick] = False
            nodes = np.where(chosen, np.take_along_axis(ids[active], pick, 1), -1)
            new = np.where((nodes >= 0)[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(len(active), -1).astype(np.int64)
            new[visited[active[:, None], new]] = -1
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            # Only as many columns as some query has new nodes.
            new = -np.sort(-new, axis=1)[:, : max(int((new >= 0).sum(1).max(initial=0)), 1)]
            visited[active[:, None], new] = True
            dots = np.matmul(self.points[np.maximum(new, 0)], queries[active][:, :, None])[:, :, 0]
            d = np.where(new >= 0, np.maximum(lengths[np.maximum(new, 0)] + own[active][:, None] - 2 * dots, 0), _NONE)
            all_ids = np.hstack([ids[active], new])
            all_far = np.hstack([far[active], d]).astype(np.float32)
            all_open = np.hstack([open_[active], new >= 0])
            keep = np.argpartition(all_far, ef - 1, axis=1)[:, :ef]
            ids[active] = np.take_along_axis(all_ids, keep, 1)
            far[active] = np.take_along_axis(all_far, keep, 1)
            open_[active] = np.take_along_axis(all_open, keep, 1)
            active = active[(open_[active] & np.isfinite(far[active])).any(1)]
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, 1)
        return np.where(np.isfinite(far), np.take_along_axis(ids, order, 1), -1), far

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        near = np.full((len(queries), 1), self.entry, np.int64)
        for level in range(len(self.links) - 1, 0, -1):
            near = self._beam(queries, near, level, 4)[0]
            near = np.where(near >= 0, near, near[:, :1])
        return self._beam(queries, near, 0, ef)[0]


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _lengths(points: np.ndarray) -> np.ndarray:
    """Lengths of vectors of any finite components."""
    most = np.abs(points).max(1, initial=0)
    return most * np.sqrt(((points / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1))


def _lengthened(points: np.ndarray) -> np.ndarray:
    """Vectors scaled to at most length 1, with one more coordinate that brings them all to 1.

    Scaled in double precision first: the lengths of a shard differ by a factor of
    two at most, so single precision is enough for the rest.
    """
    lengths = _lengths(points)
    longest = lengths.max(initial=0) or 1.0
    rest = np.sqrt(np.maximum(1 - (lengths / longest) ** 2, 0))
    return np.hstack([points / longest, rest[:, None]]).astype(np.float32)


def _build(degree: int, ef: int) -> Callable:
    def build(shard: pa.Table) -> pa.Table:
        points = _matrix(shard.column("vector"), len(shard))
        ids = shard.column("vec_id").to_numpy()
        order = np.argsort(ids)
        points, ids = points[order], ids[order]
        nodes, back = np.unique(points, axis=0, return_inverse=True)
        back = back.ravel()
        members = np.split(ids[np.argsort(back, kind="stable")], np.cumsum(np.bincount(back, minlength=len(nodes)))[:-1])
        graph = Graph(_lengthened(nodes), degree, ef)
        flat = np.hstack(graph.links)
        return pa.table(
            {
                "dim": np.full(len(nodes), nodes.shape[1], np.int32),
                "band": np.full(len(nodes), shard.column("band")[0].as_py(), np.int32),
                "shard": np.full(len(nodes), shard.column("shard")[0].as_py(), np.int64),
                "node": np.arange(len(nodes), dtype=np.int32),
                "entry": np.full(len(nodes), graph.entry, np.int32),
                "vector": pa.array(list(nodes), pa.list_(pa.float64())),
                "vec_ids": pa.array([m.tolist() for m in members], pa.list_(pa.int64())),
                "links": pa.array(list(flat), pa.list_(pa.int32())),
            }
        )

    return build


def _search(k: int, degree: int, ef: int) -> Callable:
    def search(queries: pa.Table, shard: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(queries) or not len(shard):
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
        shard = shard.sort_by("node")
        points = _matrix(shard.column("vector"), len(shard))
        flat = _matrix(shard.column("links"), len(shard)).astype(np.int32)
        levels = (flat.shape[1] - 2 * degree) // degree
        links = [flat[:, : 2 * degree]] + [flat[:, (2 + i) * degree : (3 + i) * degree] for i in range(levels)]
        graph = Graph.load(_lengthened(points), links, shard.column("entry")[0].as_py())
        asked = _matrix(queries.column("vector"), len(queries))
        ids = queries.column("vec_id").to_numpy()
        members = shard.column("vec_ids").to_pylist()
        out: list[list] = [[], [], []]
        for a in range(0, len(asked), 256):
            q = asked[a : a + 256]
            unit = q / _lengths(q)[:, None]
            wide = max(ef, k + 1, int(WIDER * q.shape[1]))
            found = graph.search(np.hstack([unit, np.zeros((len(q), 1))]).astype(np.float32), wide)[:, : k + 1]
            for i, nodes in enumerate(found):
                nodes = nodes[nodes >= 0]
                own = int(ids[a + i])
                # Sums in one order for all rows, in double precision.
                scores = (points[nodes] * q[i]).sum(1)
                for node, score in zip(nodes.tolist(), scores.tolist(), strict=True):
                    for m in sorted(members[node])[: k + 1]:
                        if m != own:
                            out[0].append(own)
                            out[1].append(m)
                            out[2].append(score)
        return pa.table({n: pa.array(x, t) for n, x, t in zip(names, out, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return search


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components and with one that is not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _band(vector: Column) -> Column:
    """Power of two of a vector's length: vectors of one band differ by a factor of two at most."""
    most = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x / most) * (x / most))
    return F.floor(F.log2(most) + F.log2(squares) / 2 + 0.5).cast("int")


def nearest(
    rows: DataFrame, queries: Column, k: int = 20, *, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
    degree: int = DEGREE, ef_build: int = EF_BUILD, ef_search: int = EF_SEARCH,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for the rows where ``queries`` holds.

    ``rows`` has vec_id (long) and embedding.  Work is queries x shards searches.
    """
    usable_rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), queries.alias("asked"),
    )
    # Rows of one vec_id are one before they meet in a shard.
    vectors = stored(
        usable_rows.groupBy("vec_id").agg(F.min(F.struct("vector", "asked")).alias("r"))
        .select("vec_id", "r.vector", F.coalesce("r.asked", F.lit(False)).alias("asked"))
        .withColumns({"dim": F.size("vector"), "band": _band(F.col("vector"))})
    )
    sizes = vectors.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    asked = vectors.where("asked").count()
    blocks = max(-(-asked // block_queries), 1)
    shard = F.pmod(F.xxhash64("vec_id"), F.col("shards"))
    dealt = vectors.join(sizes, ["dim", "band"]).select("dim", "band", shard.alias("shard"), "vec_id", "vector")
    graph = stored(
        dealt.groupBy("dim", "band", "shard").applyInArrow(
            _build(degree, ef_build),
            "dim int, band int, shard long, node int, entry int, vector array<double>, vec_ids array<long>, links array<int>",
        )
    )
    every_block = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    listed = graph.select("dim", "band", "shard").distinct()
    every_shard = (
        vectors.where("asked").select("dim", "vec_id", "vector")
        .join(listed.select(*[F.col(c).alias(c) for c in listed.columns]), "dim")
        .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int"))
    )
    keys = ["dim", "band", "shard", "block"]
    found = every_shard.groupBy(*keys).cogroup(every_block.groupBy(*keys)).applyInArrow(
        _search(k, degree, ef_search), "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
