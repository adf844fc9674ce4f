"""Similarity join of word shingles by token-combination prefixes.

Two documents link when the Jaccard similarity of their sets of 5-word shingles
is at least 0.75.  Documents with equal sets are one node.

1. Shingles that only one node has can match nothing.  They are found by an exact
   count; nodes with more of them than the threshold allows take part no further.
2. In one order for all nodes - unshared shingles, then rare, then frequent ones,
   each by hash - a node's prefix is so long that any partner shares part of it:
   single tokens of the rare class, and pairs of neighbouring tokens over an
   extended prefix for the frequent class.
3. Nodes of a signature are first compared with one node of it, and what links is
   joined into components; after that only pairs of different components are
   compared, within classes of like sizes and where the parities of their tokens
   allow a link.  The exact similarity is computed for every pair compared.

The extended prefix: if x and y link and share no rare token, a tokens of x's
frequent prefix are missing from y and b of y's lie between them, at most
2 a + b of x's neighbouring pairs are broken.  As |x - y| + |y - x| is at most
|x| / 3 and all rare and unshared tokens are missing already, a prefix of
t + |x| / 3 - 2 r + 2 tokens keeps one pair (t: tokens x may miss, r: its
unshared and rare ones).

Defined cases: null texts and texts without words have an empty set, link with
nothing and are components of their own; fewer than five words are one shingle;
documents repeated with one id are rows of their own; null ids never name a
component; set sizes count 64-bit hashes, common shingles are found by 48 bits of
them, so a pair of texts of ordinary length is misjudged with a probability below
1e-8.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.llm.components import components
from fleetdrift.llm.storage import stored
from fleetdrift.llm.textarrays import mix, shingle_sets, steps, utf8

WORDS = 5
PERCENT = 75
_RANGE_TOKENS = 400_000
_RUN_BYTES = 4 << 20
_SKETCH = 1 << 18
#: A token is frequent from this count of its sketch cell, and from this many times the mean cell, on.
FREQUENT, FREQUENT_TIMES = 32, 4
#: Rounds that compare a signature's nodes with one of them, before all pairs left are compared.
ROUNDS = 3


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Number, set size and sorted distinct 48-bit shingles of each text."""
    data, offsets = utf8(column)
    for first, last in steps(offsets):
        part = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], WORDS)
        for i, tokens in enumerate(part):
            yield first + i, len(tokens), np.unique(tokens >> np.uint64(16))


def _node(tokens: np.ndarray) -> int:
    """Hash of a whole set."""
    with np.errstate(over="ignore"):
        total = mix(tokens + np.uint64(0x51ED270B)).sum() + np.uint64(len(tokens))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _nodes(fields: list[str]) -> Callable:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, size, tokens in _sets(batch.column("text")):
                n[i], nodes[i] = size, _node(tokens)
            columns = [batch.column(c) for c in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(nodes)], [*fields, "n_shingles", "node"])

    return describe


def _flat(column: pa.Array, seen: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a run's nodes that the task has not seen, and the nodes they belong to."""
    tokens, nodes = [], []
    for _, _, own in _sets(column):
        node = _node(own)
        if len(own) and node not in seen:
            seen.add(node)
            tokens.append(own)
            nodes.append(np.full(len(own), node, np.int64))
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tokens, nodes = np.concatenate(tokens), np.concatenate(nodes)
    order = np.argsort(tokens)
    return tokens[order], nodes[order]


def _pieces(table: pa.RecordBatch, rows: int) -> Iterator[pa.Array]:
    """A batch's texts in runs of about ``rows`` bytes' worth of shingles."""
    column = table.column("text")
    _, offsets = utf8(column)
    for first, last in steps(offsets, rows):
        yield column.slice(first, last - first)


_DEALT = "range int, known boolean, tokens binary, index binary, names binary"


def _by_range(tokens: np.ndarray, nodes: np.ndarray, to: np.ndarray, ranges: int, known: bool) -> pa.RecordBatch:
    """One row per range: its tokens, and of each the place of its node among ``names``."""
    edges = np.searchsorted(to, np.arange(ranges + 1))
    rows: list[list] = [[], [], [], [], []]
    for r in np.flatnonzero(np.diff(edges)):
        a, b = edges[r], edges[r + 1]
        names, at = np.unique(nodes[a:b], return_inverse=True)
        low = (tokens[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
        high = (tokens[a:b] >> np.uint64(32)).astype(np.uint16).tobytes()
        index = at.astype(np.uint16 if len(names) < 65536 else np.uint32)
        for x, v in zip(rows, (int(r), known, low + high, index.tobytes(), names.tobytes()), strict=True):
            x.append(v)
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], [c.split()[0] for c in _DEALT.split(", ")]
    )


def _to_ranges(ranges: int) -> Callable:
    """The tokens of each run of texts.

    A token of one node of the run goes to the range of its hash with that node.
    A token of several goes there without them: it is known to be repeated, so its
    nodes go straight on, dealt by their own hash.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for column in _pieces(batch, _RUN_BYTES):
                tokens, nodes = _flat(column, seen)
                distinct, first, back, counts = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
                to = ((distinct >> np.uint64(16)) * np.uint64(ranges)) >> np.uint64(32)
                yield _by_range(distinct, np.where(counts == 1, nodes[first], 0), to, ranges, False)
                several = counts[back] > 1
                tokens, nodes = tokens[several], nodes[several]
                to = ((mix(nodes.view(np.uint64)) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                order = np.argsort(to, kind="stable")
                yield _by_range(tokens[order], nodes[order], to[order], ranges, True)

    return deal


def _pairs(blob: bytes, index: bytes, names: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 6  # 4 low and 2 high bytes each
    low, high = np.frombuffer(blob, np.uint32, n), np.frombuffer(blob, np.uint16, n, 4 * n)
    names = np.frombuffer(names, np.int64)
    tokens = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
    return tokens, names[np.frombuffer(index, np.uint16 if len(names) < 65536 else np.uint32)]


def _repeated(group: pa.Table) -> pa.Table:
    """A range's (node, token) pairs whose token several nodes have.  Node 0 stands for several nodes at once."""
    dealt = [_pairs(*[group.column(c)[i].as_py() for c in ("tokens", "index", "names")]) for i in range(len(group))]
    known = group.column("known").to_pylist()
    out = [(nodes, tokens) for (tokens, nodes), passed in zip(dealt, known, strict=True) if passed]
    asked = [x for x, passed in zip(dealt, known, strict=True) if not passed]
    del dealt
    if asked:
        tokens, nodes = (np.concatenate(x) for x in zip(*asked, strict=True))
        del asked
        order = np.lexsort((nodes, tokens))
        tokens, nodes = tokens[order], nodes[order]
        del order
        new = np.append(True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1]))
        tokens, nodes = tokens[new], nodes[new]
        group_of = np.cumsum(np.append(True, tokens[1:] != tokens[:-1])) - 1
        several = np.bincount(group_of) > 1
        several[group_of[nodes == 0]] = True
        kept = several[group_of] & (nodes != 0)
        tokens, nodes = tokens[kept], nodes[kept]
        order = np.argsort(nodes, kind="stable")
        out.append((nodes[order], tokens[order]))
    nodes, tokens = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return pa.table({"node": nodes, "value": tokens.view(np.int64)})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's repeated tokens, if there are enough of them for any link.

    Rows come sorted by node, its size (``kind`` 0) before its tokens.
    """
    names, kinds = ("node", "n", "m", "tokens"), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    held, size, parts = None, 0, []

    def done(out: list[list]) -> None:
        if parts:
            tokens = np.unique(np.concatenate(parts))
            if 100 * len(tokens) >= PERCENT * size:
                for x, v in zip(out, (held, size, len(tokens), tokens), strict=True):
                    x.append(v)

    def rows(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    for batch in batches:
        out: list[list] = [[], [], [], []]
        nodes, kind, values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "kind", "value"))
        edges = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1])) if len(nodes) else []
        for a, b in zip(edges, [*edges[1:], len(nodes)], strict=True):
            if nodes[a] != held:
                done(out)
                held, size, parts = int(nodes[a]), 0, []
            own = values[a:b]
            if not kind[a]:
                size = int(own[kind[a:b] == 0].max())
                own = own[kind[a:b] == 1]
            if len(own):
                parts.append(own)
        yield rows(out)
    out = [[], [], [], []]
    done(out)
    yield rows(out)


def matchable(docs: DataFrame, described: DataFrame) -> DataFrame:
    """node, n (size of its set), m and tokens: nodes whose shingles shared with others could reach the threshold."""
    sizes = described.where("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("value"))
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(int(total // _RANGE_TOKENS), 12)
    pairs = docs.select("text").mapInArrow(_to_ranges(ranges), _DEALT).groupBy("range").applyInArrow(_repeated, "node long, value long")
    both = sizes.select("node", F.lit(0).alias("kind"), "value").unionByName(pairs.withColumn("kind", F.lit(1)))
    return stored(
        both.repartition("node").sortWithinPartitions("node", "kind").mapInArrow(_merge, "node long, n long, m long, tokens array<long>")
    )


def missing(n: np.ndarray | int):
    """How many of its n tokens a set may miss of a partner's."""
    return n - -(-n * PERCENT // 100)


def _signatures(frequent: bytes) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(np.frombuffer(frequent, np.uint8)).astype(bool)
        for batch in batches:
            signs, nodes, ns, ms = [], [], [], []
            lists = batch.column("tokens")
            flat, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            for i, (node, n, m) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("node", "n", "m")], strict=True)):
                own = np.sort(mix(flat[ends[i] : ends[i + 1]].astype(np.uint64)))
                often = common[(own >> np.uint64(46)).astype(np.int64)]
                rare, frequent_ones = own[~often], own[often]
                may_miss = missing(n)
                found = [rare[: max(may_miss + 1 - (n - m), 0)]]
                before = n - m + len(rare)
                if before <= may_miss:
                    length = int(may_miss + n // 3 - 2 * before) + 3
                    ones = frequent_ones[: max(length, 2)]
                    with np.errstate(over="ignore"):
                        found.append(mix(ones[:-1] * np.uint64(3) + mix(ones[1:])))
                found = np.unique(np.concatenate(found))
                signs.append(found.view(np.int64))
                for x, v in ((nodes, node), (ns, n), (ms, m)):
                    x.append(np.full(len(found), v, np.int64))
            arrays = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (signs, nodes, ns, ms)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["sign", "node", "n", "m"])

    return sign


def _frequent(sets: DataFrame) -> bytes:
    """One bit per sketch cell: whether its tokens are frequent.  The sketch has a fixed number of cells."""
    counts = np.zeros(_SKETCH, np.int64)
    cells = sets.select(F.explode("tokens").alias("t")).mapInArrow(_cells, "cell int, n long")
    for row in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    return np.packbits(counts >= max(FREQUENT, FREQUENT_TIMES * counts.mean())).tobytes()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_SKETCH, np.int64)
    for batch in batches:
        cells = (mix(batch.column("t").to_numpy().astype(np.uint64)) >> np.uint64(46)).astype(np.int64)
        counts += np.bincount(cells, minlength=_SKETCH)
    kept = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(counts[kept])], ["cell", "n"])


def _possible(a: str, b: str) -> Column:
    """Whether sizes and shared shingles of two nodes allow a link: the overlap must reach p / (100 + p) of both sizes."""
    need = PERCENT * (F.col(f"{a}.n") + F.col(f"{b}.n"))
    return (F.least(F.col(f"{a}.m"), F.col(f"{b}.m"), F.col(f"{a}.n"), F.col(f"{b}.n")) * (100 + PERCENT)) >= need


_PARITY_LONGS = 8


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's tokens as 512 bits: whether their number in a hash cell is odd."""
    for batch in batches:
        lists = batch.column("tokens")
        flat, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        cells = (mix(flat.astype(np.uint64)) >> np.uint64(55)).astype(np.int64)
        bits = np.zeros((len(batch), 64 * _PARITY_LONGS), np.uint8)
        for i in range(len(batch)):
            bits[i] = np.bincount(cells[ends[i] : ends[i + 1]], minlength=64 * _PARITY_LONGS) & 1
        longs = np.packbits(bits, axis=1).view(np.int64)
        columns = [pa.array(np.ascontiguousarray(longs[:, k])) for k in range(_PARITY_LONGS)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), *columns], ["node", *[f"s{k}" for k in range(_PARITY_LONGS)]])


def _near_enough(a: str, b: str) -> Column:
    """False only for pairs that differ too much to link.

    Two sets differ in at least as many tokens as their parities in bits, and in
    all of their unshared ones; linked sets in at most (100 - p) / (100 + p) of their sizes.
    """
    bits = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(_PARITY_LONGS)), F.lit(0))
    unshared = F.col(f"{a}.n") - F.col(f"{a}.m") + F.col(f"{b}.n") - F.col(f"{b}.m")
    return (bits + unshared) * (100 + PERCENT) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - PERCENT)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", shared.alias("i"))
    return joined.where(100 * F.col("i") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("i"))).select("a", "b")


def linked_nodes(sets: DataFrame) -> DataFrame:
    """node and component of the nodes that link with another one."""
    signs = stored(
        sets.select("node", "n", "m", "tokens").mapInArrow(_signatures(_frequent(sets)), "sign long, node long, n long, m long")
    )
    shared = signs.groupBy("sign").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    signs = stored(signs.join(shared.select("sign"), "sign", "left_semi").withColumn("component", F.col("node")))
    links, tried = None, None
    joined = sets.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(ROUNDS + 1):
        if signs.isEmpty():
            break
        if turn < ROUNDS:
            # The node with the largest part of repeated shingles is likeliest the copies' original; later rounds vary it.
            rank = F.struct(-F.col("m") / F.col("n"), F.xxhash64("node")) if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)))
            pivot = signs.groupBy("sign").agg(
                F.min_by(F.struct("node", "n", "m", "component"), rank).alias("p"),
            ).select("sign", "p.*")
            pairs = signs.alias("x").join(pivot.alias("y"), "sign").where(F.col("x.component") != F.col("y.component"))
        else:
            fields = "".join(f", s{k} long" for k in range(_PARITY_LONGS))
            parities = sets.select("node", "tokens").mapInArrow(_parities, f"node long{fields}")
            # Linked sets differ in size by a third at most: a signature's nodes are split into classes of
            # such sizes, and each meets its own class and the next larger one.
            size_class = F.floor(F.log("n") / math.log(100 / PERCENT)).cast("int")
            marked = stored(signs.join(parities, "node").withColumn("class", size_class))
            smaller = marked.withColumn("class", F.explode(F.array("class", F.col("class") + 1)))
            order = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
            pairs = smaller.alias("x").join(marked.alias("y"), ["sign", "class"]).where(
                order & (F.col("x.component") != F.col("y.component")) & _near_enough("x", "y")
            )
        pairs = pairs.where(_possible("x", "y")).select(
            F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
        ).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = stored(_verified(pairs, sets))
        links = found if links is None else links.unionByName(found)
        joined = stored(components(links))
        if turn < ROUNDS:
            # Signatures whose nodes are all in one component are done.
            now = signs.drop("component").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
            now = stored(now)
            mixed = now.groupBy("sign").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
            signs = stored(now.join(mixed.select("sign"), "sign", "left_semi"))
    return joined


def similar_groups(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` (with doc_id) of every document, n_shingles and component_id."""
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    described = stored(docs.select("text", *keep).mapInArrow(_nodes(keep), schema + "n_shingles long, node long"))
    joined = linked_nodes(matchable(docs, described))
    rows = described.join(joined, "node", "left").withColumn("group", F.coalesce("component", "node"))
    rows = stored(rows.select(*keep, "n_shingles", "group"))
    lowest = rows.where("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("lowest"))
    return rows.join(lowest, "group", "left").select(
        *keep, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id")
    )


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same rows by comparing all documents that share a shingle; doc_id must be unique.
JACCARD_SQL = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + {WORDS - 1}], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {WORDS - 1}, 1) + 1)) AS i FROM split WHERE len(words) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {PERCENT} * (x.n + y.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT r.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.other) AS component_id
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id, s.n
"""
