"""Packing by shortest-pack-first over the length histogram.

A document is its token ids and one id 0.  Whole sequences are cut off its
front; the rest, shorter than a sequence, is placed by a histogram of the rests'
lengths: lengths longest first, each into the pattern with the least room that
still takes it (the "shortest pack" of room), updating pattern counts.  The
patterns are joined back to the rests by rank within their length.

Defined cases: null texts are empty and hold the id 0 alone; equal documents get
pieces of their own; an empty table gives no pieces; special-token strings in a
text are ordinary text.
"""

from __future__ import annotations

import itertools
import json
import os
import sys
import types
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetdrift.llm.numbering import numbered
from fleetdrift.llm.storage import stored
from fleetdrift.llm.textarrays import ranges, span_hashes, steps, utf8

SEQUENCE = 1024
_SLOTS = 1 << 19  # words a worker remembers, by hash; a newer word takes an older one's slot
_MOST_IDS = 6 << 20  # remembered ids; beyond, a worker starts afresh


class Encoder:
    """Token ids of many texts; words that were seen before are not encoded again.

    Texts are cut where white space follows something else: no token crosses such
    a place, so the words' ids joined are the text's ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = _byte_level_words(self.tokenizer)
        if self.words is not None:
            self.tokenizer = None  # one vocabulary in memory is enough
        self._forget()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        if self.words is not None:
            return [self.words(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.codes = np.zeros(_SLOTS, np.uint64)
        self.starts = np.zeros(_SLOTS, np.int64)
        self.lengths = np.zeros(_SLOTS, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _append(self, ids: np.ndarray) -> int:
        first, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[first : self.used] = ids
        return first

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the texts' n + 1 offsets in them."""
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.used > _MOST_IDS:
            self._forget()
        blank = _BLANK[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = blank[1:] & ~blank[:-1] & ~_after_wide_blank(data)
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        codes = span_hashes(data, edges[:-1], edges[1:]) | np.uint64(1)  # 0 marks an empty slot
        slots = (codes >> np.uint64(45)).astype(np.int64)
        starts, lengths = self.starts[slots], self.lengths[slots]
        missed = np.flatnonzero(self.codes[slots] != codes)
        if len(missed):
            new, first, back = np.unique(codes[missed], return_index=True, return_inverse=True)
            at, raw = missed[first], data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[at].tolist(), edges[at + 1].tolist(), strict=True)]
            encoded = self._encode(texts)
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            begin = self._append(np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(sizes.sum())))
            begins = begin + np.cumsum(sizes) - sizes
            slots = slots[at]
            self.codes[slots], self.starts[slots], self.lengths[slots] = new, begins, sizes
            starts[missed], lengths[missed] = begins[back], sizes[back]
        out = self.ids[ranges(starts, lengths)]
        totals = np.concatenate([[0], np.cumsum(lengths)])
        return out, totals[np.searchsorted(edges, offsets)]


# Fixed value: the pre-tokenizer's published pattern for byte-level vocabularies.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_level_words(tokenizer) -> Callable[[str], list[int]] | None:
    """A faster encoder of single words with the tokenizer's own vocabulary and merges.

    Only for plain byte-level vocabularies whose ids follow the order of the
    merges; None for others, whose words the tokenizer encodes itself.
    """
    import tiktoken

    spec = json.loads(tokenizer.to_str())
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if spec.get("normalizer") or not plain or model.get("type") != "BPE" or model.get("ignore_merges"):
        return None
    # Byte-level vocabularies write bytes that don't print as code points from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    vocabulary = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merged = [vocabulary.get(a + b, -1) for a, b in pairs]
    if merged != sorted(merged) or not merged or merged[0] < 256:
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in vocabulary.items() if word not in special}
    if len(ranks) != 256 + len(merged):
        return None
    return tiktoken.Encoding("own", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def worker_encoder(path: str) -> Encoder:
    """The Python worker's encoder, kept from task to task."""
    kept = sys.modules.setdefault("_fleetdrift_encoders", types.ModuleType("_fleetdrift_encoders"))
    if path not in vars(kept):
        vars(kept)[path] = Encoder(path)
    return vars(kept)[path]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 12, 13, 32]] = True


def _after_wide_blank(data: np.ndarray) -> np.ndarray:
    """For each byte but the first: whether the bytes before it may end a white space other than ASCII's usual ones."""
    d = data
    out = ((d >= 28) & (d <= 31)) | (d == 11) | (d == 0)
    if (d >= 0xC2).any():
        two = np.zeros(len(d), bool)
        two[1:] = (d[:-1] == 0xC2) & ((d[1:] == 0x85) | (d[1:] == 0xA0))
        three = np.zeros(len(d), bool)
        three[2:] = (
            ((d[:-2] == 0xE2) & ((d[1:-1] == 0x80) | (d[1:-1] == 0x81)))
            | ((d[:-2] == 0xE1) & ((d[1:-1] == 0x9A) | (d[1:-1] == 0xA0)))
            | ((d[:-2] == 0xE3) & (d[1:-1] == 0x80))
        )
        out |= two | three
    return out[:-1]


def _pieces(path: str, sequence: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in steps(offsets):
                ids, own = encoder.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                row, start, length, crc, total = [], [], [], [], []
                for i in range(last - first):
                    mine = np.append(ids[own[i] : own[i + 1]], 0).astype("<u4")
                    for a in range(0, len(mine), sequence):
                        piece = mine[a : a + sequence]
                        row.append(first + i)
                        start.append(a)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(mine))
                doc = batch.column("doc_id").take(pa.array(row, pa.int64()))
                longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([doc, *longs], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def pack_histogram(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) with how often each occurs.

    Lengths go longest first; those of one length go to the open patterns with the
    least sufficient room, what is left opens new ones.  Work and result depend on
    the number of lengths, not on the number of documents.
    """
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {sequence: []}
    rooms: list[int] = []  # sorted rooms that have patterns
    full: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], count: int, room: int) -> None:
        if room == 0:
            full.append((lengths, count))
            return
        if not open_by_room.setdefault(room, []):
            insort(rooms, room)
        open_by_room[room].append((lengths, count))

    for length in sorted((k for k, c in counts.items() if c > 0), reverse=True):
        left = counts[length]
        at = bisect_left(rooms, length)
        while left and at < len(rooms):
            room = rooms[at]
            lengths, count = open_by_room[room].pop()
            used = min(count, left)
            if count > used:
                open_by_room[room].append((lengths, count - used))
            if not open_by_room[room]:
                rooms.pop(at)
            left -= used
            put((*lengths, length), used, room - length)
            at = bisect_left(rooms, length)
        if left:
            # Short lengths fill new sequences with several of their own.
            each = sequence // length
            if left // each:
                put((length,) * each, left // each, sequence - each * length)
            if left % each:
                put((length,) * (left % each), 1, sequence - (left % each) * length)
    return full + [p for room in rooms for p in open_by_room[room]]


def _placer(patterns: list[tuple[tuple[int, ...], int]], base: int) -> Callable:
    """Ranks within a length to (sequence, offset): each pattern owns a range of ranks of each of its lengths."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, list[list[int]]] = {}
        taken: dict[int, int] = {}
        sequence = base
        for lengths, count in patterns:
            offset = 0
            for n in lengths:
                rank = taken.get(n, 0)
                rows = tables.setdefault(n, [[], [], []])
                for column, value in zip(rows, (rank, sequence, offset), strict=True):
                    column.append(value)
                taken[n] = rank + count
                offset += n
            sequence += count
        arrays = {n: [np.array(x, np.int64) for x in rows] for n, rows in tables.items()}
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            ids, offsets = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            kinds, firsts = np.unique(lengths[order], return_index=True)
            for n, rows in zip(kinds.tolist(), np.split(order, firsts[1:]), strict=True):
                starts, sequences, places = arrays[n]
                at = np.searchsorted(starts, ranks[rows], "right") - 1
                ids[rows] = sequences[at] + ranks[rows] - starts[at]
                offsets[rows] = places[at]
            rest = [batch.column(c) for c in batch.schema.names if c != "rank"]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(ids), pa.array(offsets)], [*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = stored(
        docs.select("doc_id", "text").mapInArrow(
            _pieces(path, sequence), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
        )
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = counts.pop(sequence, 0)
    patterns = pack_histogram(counts, sequence)
    keys = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    # One numbering serves both kinds: whole pieces are sequences by themselves, and come first.
    ranked = numbered(pieces, ["length"], keys, "rank")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pieces.schema.fields)
    if whole:
        patterns = [((sequence,), whole), *patterns]
    return ranked.mapInArrow(_placer(patterns, 0), fields + "sequence_id long, offset long")
