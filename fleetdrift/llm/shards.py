"""Balanced shards by label propagation under capacity quotas.

Equal texts are one node (a group larger than a shard forms the fewest nodes
that fit).  Nodes are linked by equal text, by shared lines and by shared byte
windows of a sketch (the windows of least hash).  Each round
joins every node's links with its neighbours' shards, and nodes move to the
shard most of their neighbours are in.  A shard takes what fits beside what leaves it, nodes
with most to gain first.  A last pass
evens out what the start left uneven, moving weakly linked nodes.

Law: ``bytes``.  Sizes are the text's UTF-8 bytes plus 16 and end near equal:
within the size of the largest node or 1 / TOLERANCE of a shard.

Defined cases: null texts are empty and form one group; documents repeated with
the same id are rows of their own; an empty table gives no rows; ties in gain go
by a hash of the node.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetdrift.llm.numbering import numbered
from fleetdrift.llm.storage import stored
from fleetdrift.llm.textarrays import LOWER, ranges, span_hashes, steps, utf8

SHARDS = 40
#: Rounds end when one moves less than this share of the bytes, or when so many in a row move not a tenth less than the least before.
SETTLED, PATIENCE = 0.01, 2
#: Bytes of a window of texts from so many bytes on, and the windows of a text that link it: those of least hash.
WINDOWS, SKETCH = {48: 24, 16: 8, 0: 2}, 16
#: Bytes of text whose windows are hashed at once; each takes some fifty bytes of a worker's memory.
PIECE = 1 << 17
_BINS = 32
_GRAINS = 16
#: Moves may fill a shard beyond the mean by this part of it; the last pass evens that out.
SLACK = 20


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _window_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """group and link of each text's sketch: its windows of least hash, all of them in short texts."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        groups = batch.column("group").to_numpy()
        lengths = np.diff(offsets)
        widths = np.minimum(np.select([lengths >= least for least in WINDOWS], list(WINDOWS.values())), lengths)
        for first, last in steps(offsets, PIECE):
            part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            found = _sketches(part, own, widths[first:last]) if last > first + 1 else [_sketch(part, int(widths[first]))]
            links = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            owners = np.repeat(groups[first:last], [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(links)], ["group", "link"])


def _sketches(part: np.ndarray, own: np.ndarray, width: np.ndarray) -> list[np.ndarray]:
    lengths = np.diff(own)
    count = np.where(lengths > 0, lengths - width + 1, 0)
    starts = ranges(own[:-1], count)
    hashes = span_hashes(LOWER[part], starts, starts + np.repeat(width, count))
    ends = np.concatenate([[0], np.cumsum(count)])
    return [_least(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _sketch(text: np.ndarray, width: int) -> np.ndarray:
    # A long text goes in pieces that overlap by a window less one byte: memory does not grow with its length.
    found = np.zeros(0, np.uint64)
    for at in range(0, len(text) - width + 1, PIECE):
        piece = text[at : at + PIECE + width - 1]
        found = _least(np.concatenate([found, *_sketches(piece, np.array([0, len(piece)]), np.array([width]))]))
    return found


def _least(hashes: np.ndarray) -> np.ndarray:
    # Equal windows count once: more than the sketch's size are looked at until so many differ.
    n = 4 * SKETCH
    while n < len(hashes):
        found = np.unique(np.partition(hashes, n)[:n])
        if len(found) >= SKETCH:
            return found[:SKETCH]
        n *= 4
    return np.unique(hashes)[:SKETCH]


def _quota_moves(cells: DataFrame, load: DataFrame, shards: int) -> tuple[DataFrame, float]:
    """For each shard the least rank of the cells that may move in, all that fit when all others move too; and the share of bytes that moves.

    Gains are cut into bins and those into hashed grains, so the table counted
    here has a bounded number of rows whatever the number of nodes.  A shard has
    one quota for what comes from all others, so a large node changes places
    with many small ones: all moves are taken, then shards that end above their
    capacity turn away their lowest ranks until none does.
    """
    held, total = np.zeros(shards), 0
    for r in load.collect():
        held[r["shard"]] = r["linked"]
        total += r["bytes"]
    # Nodes without links hold no room: the last pass moves them first.
    full = np.maximum(held, total / shards * (1 + 1 / SLACK))
    table = cells.toPandas()
    table = table.sort_values(["wish", "rank"], ascending=[True, False])
    source, sizes, ranks = (table[c].to_numpy() for c in ("shard", "bytes", "rank"))
    first = np.searchsorted(table["wish"].to_numpy(), np.arange(shards + 1))
    end = first[1:].copy()  # the cells from first to end of each shard move in
    now = held.copy()
    np.add.at(now, table["wish"].to_numpy(), sizes)
    np.subtract.at(now, source, sizes)
    while (over := np.flatnonzero((now > full) & (end > first[:-1]))).size:
        for s in over:
            turned = np.cumsum(sizes[first[s] : end[s]][::-1])
            n = min(int(np.searchsorted(turned, now[s] - full[s])) + 1, len(turned))
            back = slice(end[s] - n, end[s])
            np.add.at(now, source[back], sizes[back])
            now[s] -= turned[n - 1]
            end[s] -= n
    least = [(int(s), int(ranks[end[s] - 1])) for s in range(shards) if end[s] > first[s]]
    moved = sum(int(sizes[a:b].sum()) for a, b in zip(first[:-1], end, strict=True))
    return cells.sparkSession.createDataFrame(least, "wish int, least long"), moved / max(total, 1)


def _grain(node: str = "node") -> Column:
    return F.pmod(F.xxhash64(node, F.lit(7)), F.lit(_GRAINS)).cast("int")


def propagate(nodes: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, bytes, shard after rounds of moves until they settle, or at most ``rounds``.  ``links`` holds (node, link); nodes of a link are neighbours.

    A node has as many votes as ``copies`` (1 where the column is missing).
    """
    state = nodes if "copies" in nodes.columns else nodes.withColumn("copies", F.lit(1))
    shards = (nodes.agg(F.max("shard")).first()[0] or 0) + 1
    lowest, idle = 1.0, 0
    for _ in itertools.count() if rounds is None else range(rounds):
        placed = links.join(state.select("node", "shard", "copies"), "node")
        # A link's nodes are counted by shard first: a link of a third of all nodes costs one row per shard.
        inside = placed.groupBy("link", "shard").agg(F.sum("copies").alias("n"))
        degree = inside.groupBy("link").agg(F.sum("n").alias("degree"))
        # All nodes of a link prefer the same one of equally strong shards, other links other ones.
        pulls = inside.join(degree, "link").select(
            "link", F.col("shard").alias("wish"), (F.col("n") / F.col("degree")).alias("pull"),
            F.xxhash64("link", "shard").alias("prefer"),
        )
        # A link's shards, at most as many as there are, travel to its nodes as one row and are counted there.
        pulls = pulls.groupBy("link").agg(F.collect_list(F.struct("wish", "pull", "prefer")).alias("pulls"))
        drawn = links.join(pulls, "link").select("node", "pulls").repartition("node")
        votes = drawn.select("node", F.inline("pulls")).groupBy("node", "wish").agg(
            F.sum("pull").alias("pull"), F.max("prefer").alias("prefer")
        )
        best = votes.groupBy("node").agg(
            F.max_by("wish", F.struct("pull", "prefer")).alias("wish"), F.max("pull").alias("best")
        )
        wished = state.join(best, "node", "left").select(
            "node", "bytes", "copies", "shard", F.coalesce("wish", "shard").alias("wish"), F.col("best").isNotNull().alias("linked"),
            ((F.least(F.floor(F.coalesce("best", F.lit(0.0)) * 8), F.lit(_BINS - 1)) * _GRAINS + _grain()) * shards
             + F.col("shard")).cast("long").alias("rank"),
        )
        wished = stored(wished)
        load = wished.groupBy("shard").agg(
            F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("linked"), F.col("bytes")).otherwise(0)).alias("linked")
        )
        cells = wished.where("wish <> shard").groupBy("shard", "wish", "rank").agg(F.sum("bytes").alias("bytes"))
        least, moved = _quota_moves(cells, load, shards)
        # Not written: a row per shard decides over the stored wishes, so reading them again costs less than files of their own.
        state = wished.join(F.broadcast(least), "wish", "left").select(
            "node", "bytes", "copies", F.when(F.col("rank") >= F.col("least"), F.col("wish")).otherwise(F.col("shard")).alias("shard")
        )
        idle = 0 if moved < 0.9 * lowest else idle + 1
        lowest = min(lowest, moved)
        if moved < SETTLED or idle >= PATIENCE:
            break
    return state.drop("copies")


def even_out(state: DataFrame, linked: DataFrame, shards: int) -> DataFrame:
    """Move nodes from shards above the mean into those below, unlinked nodes first.

    Two passes over cells of a bounded table: first a shard's cells beyond its
    capacity are marked, then the marked bytes are laid end to end against the
    free room of the other shards.
    """
    rest = [c for c in state.columns if c != "shard"]
    state = stored(
        state.join(linked, "node", "left").select(
            *rest, "shard", F.coalesce("linked", F.lit(0)).alias("linked"),
            F.pmod(F.xxhash64("node", F.lit(11)), F.lit(4096)).cast("int").alias("grain"),
        )
    )
    for _ in range(2):
        cells = state.groupBy("shard", "linked", "grain").agg(F.sum("bytes").alias("bytes")).toPandas()
        if cells.empty:
            break
        target = cells["bytes"].sum() / shards
        # Cells of a large node stay first; only small ones fit into what room is left elsewhere.
        cells["large"] = cells["bytes"] > target / 100
        cells["first"] = cells["bytes"].where(cells["large"], 0)
        cells = cells.sort_values(["shard", "large", "first", "linked", "grain"], ascending=[True, False, False, False, True]).reset_index(drop=True)
        cells["end"] = cells.groupby("shard")["bytes"].cumsum()
        over = cells[cells["end"] > target * (1 + 1e-4)].copy()
        kept = cells[cells["end"] <= target * (1 + 1e-4)].groupby("shard")["bytes"].sum()
        room = np.array([target - kept.get(s, 0) for s in range(shards)])
        # A large cell is laid where the other large ones leave room; the second pass moves the small ones from there.
        clear = target - np.bincount(cells["shard"], cells["first"].where(cells["end"] <= target * (1 + 1e-4), 0), shards)
        over = over.sort_values("bytes", ascending=False, kind="stable")
        goes = []
        for b, s, large in zip(over["bytes"], over["shard"], over["large"], strict=True):
            free = clear if large else room
            best = s if free[s] >= b else int(free.argmax())
            room[best] -= b
            clear[best] -= b if large else 0
            goes.append(best)
        over["goes"] = goes
        over = over[over["goes"] != over["shard"]]
        if over.empty:
            break
        table = state.sparkSession.createDataFrame(over[["shard", "linked", "grain", "goes"]].astype("int32"))
        state = state.join(F.broadcast(table), ["shard", "linked", "grain"], "left").select(
            *rest, F.coalesce("goes", "shard").cast("int").alias("shard"), "linked", "grain"
        )
    return state.select(*rest, "shard")


def cut_share(members: DataFrame) -> float:
    """Share of pairs of equal ``link`` in different shards; ``members`` holds (link, shard)."""
    inside = members.groupBy("link", "shard").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = inside.groupBy("link").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1)).alias("kept"))
    kept, every = pairs.agg(F.sum("kept"), F.sum(F.col("all") * (F.col("all") - 1))).first()
    return 1 - kept / every if every else 0.0


def balanced_shards(docs: DataFrame, keep: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """Columns ``keep`` of every document with size, text_crc32, shard and a gapless slot in it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *keep, _size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"), F.xxhash64(*[F.col(c) for c in keep]).alias("_row"),
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(total / shards, 1.0)
    sizes = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    # A group of copies larger than a shard is cut into as few runs of its rows as fit.
    sizes = sizes.select("group", "copies", F.least(F.ceil(F.col("bytes") / most), "copies").cast("long").alias("cuts"))
    large = stored(sizes.where("cuts > 1"))
    rows = stored(rows.join(large, "group", "left"))
    columns = [*keep, "size", "text_crc32", "group"]
    runs = numbered(rows.where("cuts IS NOT NULL"), ["group"], ["_row"], "place").select(
        *columns, F.col("group").alias("cut_from"),
        F.xxhash64("group", F.floor(F.col("place") * F.col("cuts") / F.col("copies"))).alias("node"),
    )
    rows = stored(
        rows.where("cuts IS NULL")
        .select(*columns, F.lit(None).cast("long").alias("cut_from"), F.col("group").alias("node"))
        .unionByName(runs)
    )
    state = rows.groupBy("node").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies")).withColumn(
        "shard", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(shards)).cast("int")
    )
    lines = F.array_distinct(
        F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))
    )
    texts = docs.select(F.xxhash64(text).alias("group"), text.alias("text"))
    shared = stored(
        docs.select(F.xxhash64(text).alias("group"), F.explode(lines).alias("link"))
        .unionByName(texts.mapInArrow(_window_links, "group long, link long"))
    )
    alone = shared.groupBy("link").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high")
    shared = shared.join(alone.select("link"), "link", "left_semi").distinct()
    pieces = stored(rows.where("cut_from IS NOT NULL").select("node", F.col("cut_from").alias("link")).distinct())
    # All pieces of a cut group keep the group's lines.
    named = pieces.select("node", F.col("link").alias("group"))
    whole = shared.join(named, "group", "left").select(F.coalesce("node", "group").alias("node"), "link")
    links = stored(whole.unionByName(pieces))
    linked = stored(links.select("node").distinct().withColumn("linked", F.lit(1)))
    # Large nodes would leave no room in the shards they start in.
    state = propagate(even_out(state, linked, shards), links)
    state = even_out(state, linked, shards)
    placed = stored(rows.join(state.select("node", "shard"), "node"))
    order = [c for c in (*keep, "text_crc32", "size")]
    return numbered(placed, ["shard"], order, "slot").select(
        *keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
