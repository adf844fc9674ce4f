"""Benchmark decontamination by greedy string tiling.

Runs of ``SEED`` words (all words of an item that has fewer) that a text shares
with a benchmark item are found by their rolling (Karp-Rabin) hashes and joined
on them.  For each text and item
the longest match is marked again and again, never overlapping what is marked,
until none of ``SEED`` words is left.  Tiles may lie in any order, so reordered
passages are caught.  A text is contaminated by an item if its tiles cover at
least ``COVERAGE`` of the item's words.

Defined cases: null and empty texts and items match nothing; an item of fewer than
``SEED`` words is found where all its words stand together; of equally long matches the one that begins first
in the text, then in the item, is marked; equal texts are judged one by one;
repeated benchmark rows of one item id and text count once; extra columns are
kept only where asked for.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetdrift.llm.storage import stored
from fleetdrift.llm.textarrays import NOT_ALNUM, steps, utf8, windows, words

SEED = 5
COVERAGE = 0.6
#: A benchmark of up to so many seeds (8 bytes each) is sent to all tasks as a filter; beyond, seeds are only joined.
MOST_SENT = 4_000_000


def _seeds(fields: list[str], known: bytes | None, sizes: tuple[int, ...] = ()) -> Callable:
    """Seed hashes with their places.

    Benchmark items (no ``sizes``) have seeds of ``SEED`` words, or of all their
    words; texts have the ``known`` seeds of the given sizes, all of them if None.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if known is None else np.frombuffer(known, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in steps(offsets):
                hashes, own = words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], NOT_ALNUM)
                text = np.repeat(np.arange(last - first), np.diff(own))
                for size in sizes or range(1, SEED + 1):
                    runs = windows(hashes, size).view(np.int64)
                    inside = text[: len(runs)] == text[size - 1 :] if len(runs) else np.zeros(0, bool)
                    if not sizes and size < SEED and len(runs):
                        inside &= np.diff(own)[text[: len(runs)]] == size
                    if wanted is not None:
                        if not len(wanted):
                            continue
                        at = np.minimum(np.searchsorted(wanted, runs), len(wanted) - 1)
                        inside &= wanted[at] == runs
                    at = np.flatnonzero(inside)
                    row = pa.array(text[at] + first)
                    kept = [batch.column(c).take(row) for c in fields]
                    made = [pa.array(runs[at]), pa.array(at - own[text[at]]), pa.array(np.diff(own)[text[at]])]
                    yield pa.RecordBatch.from_arrays([*kept, *made], [*fields, "seed", "place", "n_words"])

    return find


def tile(text_at: np.ndarray, item_at: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (text place, item place, length) from the places of shared seeds.

    Matches lie in a heap, longest first.  One that is taken out whole is a tile;
    of one that a tile has met since, the free parts go back.
    """
    if not len(text_at):
        return []
    diagonal = item_at - text_at
    order = np.lexsort((text_at, diagonal))
    text_at, diagonal = text_at[order], diagonal[order]
    fresh = np.ones(len(text_at), bool)
    fresh[1:] = (np.diff(diagonal) != 0) | (np.diff(text_at) > 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(text_at)) - 1
    heap = [(-(int(text_at[b] - text_at[a]) + seed), int(text_at[a]), int(text_at[a] + diagonal[a])) for a, b in zip(first, last, strict=True)]
    heapq.heapify(heap)
    text_free = np.ones(int(text_at.max()) + seed + 1, bool)
    item_free = np.ones(int((text_at + diagonal).max()) + seed + 1, bool)
    tiles = []
    while heap:
        length, t, i = heapq.heappop(heap)
        free = text_free[t : t - length] & item_free[i : i - length]
        if free.all():
            tiles.append((t, i, -length))
            text_free[t : t - length] = item_free[i : i - length] = False
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= seed:
                heapq.heappush(heap, (a - b, t + a, i + a))
    return sorted(tiles)


def _tiles(columns: list[str]) -> Callable:
    def judge(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["item_words"].iloc[0])
        tiles = tile(group["place"].to_numpy(), group["item_place"].to_numpy(), min(SEED, n))
        covered = sum(n for _, _, n in tiles)
        out = group.iloc[:1][columns].copy()
        out["covered"], out["item_words"], out["coverage"] = covered, n, covered / n
        out["n_tiles"] = len(tiles)
        out["reordered"] = any(x[1] > y[1] for x, y in zip(tiles, tiles[1:], strict=False))
        return out

    return judge


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text_hash and item of each contamination, with how it was covered.

    A text with too few distinct seed places of an item to reach the coverage is
    dropped before tiling; n seed places cover at most n x SEED words.
    """
    doc_kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, "item_id")))
    items = stored(
        benchmark.select("item_id", "text")
        .distinct()
        .withColumn("item_hash", F.xxhash64("text"))
        .mapInArrow(
            _seeds(["item_id", "item_hash"], None),
            f"item_id {item_kind}, item_hash long, seed long, place long, n_words long",
        )
        .withColumnsRenamed({"place": "item_place", "n_words": "item_words"})
    )
    sizes = tuple(r[0] for r in items.select(F.least("item_words", F.lit(SEED))).distinct().collect())
    sent = None
    if items.count() <= MOST_SENT:
        seeds = items.select("seed").distinct().toPandas()["seed"].to_numpy(np.int64)
        sent = np.sort(seeds).tobytes()
    texts = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    hits = texts.mapInArrow(
        _seeds(["doc_id", "text_hash"], sent, sizes or (SEED,)), f"doc_id {doc_kind}, text_hash long, seed long, place long, n_words long"
    ).drop("n_words")
    # Equal rows of documents give equal hits; judged once, as their verdict is the same.
    pairs = hits.join(items, "seed").distinct()
    keys = ["doc_id", "text_hash", "item_id", "item_hash"]
    enough = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max("item_words").alias("_words")
    ).where(F.col("_n") * SEED >= F.col("_words") * coverage).select(*keys)
    schema = (
        f"doc_id {doc_kind}, text_hash long, item_id {item_kind}, covered long, item_words long, coverage double, "
        "n_tiles long, reordered boolean"
    )
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    chosen = pairs.alias("p").join(enough.alias("e"), same, "left_semi")
    return (
        chosen.groupBy(*keys)
        .applyInPandas(_tiles(["doc_id", "text_hash", "item_id"]), schema)
        .where(F.col("coverage") >= coverage)
    )
