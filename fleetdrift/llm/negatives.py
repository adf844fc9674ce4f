"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions.  For an anchor at
angle s and a row at angle t to one reference, the angle between them lies within
[|s - t|, s + t]; the cosines of these, times both norms and widened by what
rounding may cost, bound their integer inner product.  Rows are sorted by nearest
reference and angle and cut into equal blocks, so a block has narrow angles too:

1. blocks whose bounds miss all windows of an anchor never meet it;
2. inside a block, rows whose bounds miss them get no integer score;
3. the rest is scored exactly.

The same search runs three times: the anchor's own block gives a first bar for
its positives, all blocks above the bar its positives, and windows below the
positives' scores its negatives.

Defined cases: rows with a null vec_id, label or vector, or with any null or
non-finite component (times the scale, too) take no part; rows repeated with one
vec_id count once (least label, then vector); only vectors of one length are
compared; vectors that are empty or zero score 0; a score that no long holds
still ranks, but gives no row; positives below 0 have no window; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetdrift.llm.storage import stored
from fleetdrift.skew import with_places

SCALE = 256
REFERENCES = 8
#: Rows from which the reference directions are chosen.  Any directions give right results.
SAMPLE = 1024
BLOCK_ROWS = 4096
SLICE_ANCHORS = 2048
PART_BLOCKS = 16384
#: Rows longer than this (in integers) are never filtered and are scored with Python's integers.
WIDE = float(1 << 25)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite after scaling."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return F.coalesce(good, F.lit(False))


def quantized(points: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * points)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def references(points: np.ndarray, most: int = REFERENCES) -> np.ndarray:
    """Unit vectors far from one another: each next one has the least cosine to those chosen."""
    norms = np.linalg.norm(points, axis=1)
    units = points[(norms > 0) & (norms < WIDE)] / norms[(norms > 0) & (norms < WIDE), None]
    if not len(units):
        return np.zeros((0, points.shape[1]))
    chosen = [units[0]]
    nearest = units @ chosen[0]
    while len(chosen) < min(most, len(units)):
        chosen.append(units[int(nearest.argmin())])
        nearest = np.maximum(nearest, units @ chosen[-1])
    return np.array(chosen)


_DESCRIBED = "dim int, vec_id long, label long, asked boolean, vector array<double>, norm double, angles array<double>, cell int, near double"


def _describe(directions: dict[int, np.ndarray]) -> Callable:
    names = [c.split()[0] for c in _DESCRIBED.split(", ")]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(pc.list_value_length(batch.column("vector")))
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                points = quantized(_matrix(part.column("vector")))
                to = directions.get(int(dim), np.zeros((0, dim)))
                with np.errstate(over="ignore", invalid="ignore"):
                    norms = np.sqrt((points**2).sum(1))
                    plain = (norms > 0) & (norms < WIDE)
                    cosines = np.zeros((len(part), len(to)))
                    cosines[plain] = (points[plain] @ to.T) / norms[plain, None]
                angles = np.arccos(np.clip(cosines, -1, 1))
                full = np.hstack([angles, np.full((len(part), REFERENCES - len(to)), np.pi / 2)])
                cell = full.argmin(1)
                columns = [
                    pa.array(np.full(len(part), dim, np.int32)), part.column("vec_id"), part.column("label"), part.column("asked"),
                    part.column("vector"), pa.array(norms), pa.array(list(full), pa.list_(pa.float64())),
                    pa.array(cell.astype(np.int32)), pa.array(full[np.arange(len(part)), cell]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return describe


def _slack(dim: int) -> float:
    """What rounding may add to the cosine of a sum or difference of two angles."""
    return 4 * float(np.sqrt(2 * (dim + 8) * np.finfo(float).eps))


def _met(anchors: pa.Table, blocks: pa.Table, same: bool, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of anchors and blocks whose bounds meet a window, as two index arrays."""
    n, slack = len(blocks), _slack(dim)
    least, most = _matrix(blocks.column("least")), _matrix(blocks.column("most"))
    short, long = (blocks.column(c).to_numpy() for c in ("shortest", "longest"))
    labels = [set(x) for x in blocks.column("labels").to_pylist()]
    held: dict[int, np.ndarray] = {}
    left, right = [], []
    for i, (label, norm, angles, lows, highs) in enumerate(
        zip(*[anchors.column(c).to_pylist() for c in ("label", "norm", "angles", "lows", "highs")], strict=True)
    ):
        if label not in held:
            held[label] = np.array([label in x if same else bool(x - {label}) for x in labels])
        at = np.array(angles)
        low, high = at + least, at + most
        down = np.where((low <= np.pi) & (high >= np.pi), -1.0, np.minimum(np.cos(low), np.cos(high))).max(1) - slack
        up = np.cos(np.maximum(np.maximum(least - at, at - most), 0)).min(1) + slack
        with np.errstate(invalid="ignore"):
            top = norm * np.maximum(up * short, up * long) + 1
            bottom = norm * np.minimum(down * short, down * long) - 1
        free = (long >= WIDE) | (norm >= WIDE)
        hit = np.zeros(n, bool)
        for a, b in zip(lows, highs, strict=True):
            hit |= (top >= a) & (bottom <= b)
        found = np.flatnonzero((hit | free) & held[label])
        left.append(np.full(len(found), i))
        right.append(found)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


_ANCHOR = "dim int, vec_id long, label long, vector array<double>, norm double, angles array<double>, lows array<long>, highs array<long>"


def _dealt(same: bool) -> Callable:
    """Copies of the anchors, one for every block they meet."""

    def deal(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        fields = [c.split()[0] for c in _ANCHOR.split(", ")]
        dim = anchors.column("dim")[0].as_py() if len(anchors) else 0
        who, where = _met(anchors, blocks, same, dim) if len(anchors) and len(blocks) else ([], [])
        picked = anchors.select(["slice", *fields]).take(pa.array(who, pa.int64()))
        for i, name in enumerate(("lows", "highs"), len(picked.column_names) - 2):
            picked = picked.set_column(i, name, picked.column(name).cast(pa.list_(pa.int64())))
        return picked.append_column("block", blocks.column("block").take(pa.array(where, pa.int64())).cast(pa.int64()))

    return deal


def _exact(rows: np.ndarray, anchor: np.ndarray, wide: bool) -> list[int] | np.ndarray:
    """Integer inner products: in doubles where every partial sum is an exact integer, else in Python's integers."""
    if not wide:
        return np.rint(rows @ anchor).astype(np.int64)
    own = [int(x) for x in anchor]
    return np.array([sum(map(mul, map(int, row), own)) for row in rows] + [None], object)[:-1]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, in order; earlier places first among equal ones."""
    if len(scores) > 4 * k and scores.dtype != object:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return kept[np.argsort(-scores[kept], kind="stable")[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: -scores[i])[:k], int)


def _approximate(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return float("inf") if score > 0 else float("-inf")


def _scored(same: bool, k: int) -> Callable:
    """Per anchor and window the block's best rows; only rows whose bounds meet a window are scored."""

    def score(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if len(anchors) and len(rows):
            rows = rows.sort_by("vec_id")
            points = quantized(_matrix(rows.column("vector")))
            ids, labels, norms = (rows.column(c).to_numpy() for c in ("vec_id", "label", "norm"))
            angles = _matrix(rows.column("angles"))
            cosines, sines, slack = np.cos(angles), np.sin(angles), _slack(points.shape[1])
            asked = quantized(_matrix(anchors.column("vector")))
            fields = [anchors.column(c).to_pylist() for c in ("vec_id", "label", "norm", "angles", "lows", "highs")]
            for q, (own, label, norm, at, lows, highs) in zip(asked, zip(*fields, strict=True), strict=True):
                a, b = cosines * np.cos(at), sines * np.sin(at)
                with np.errstate(invalid="ignore", over="ignore"):
                    top = norm * norms * ((a + b).min(1) + slack) + 1
                    bottom = norm * norms * ((a - b).max(1) - slack) - 1
                free = (norms >= WIDE) | (norm >= WIDE)
                meets = np.zeros(len(ids), bool)
                for low, high in zip(lows, highs, strict=True):
                    meets |= (top >= low) & (bottom <= high)
                meets = (meets | free) & ((labels == label) if same else (labels != label)) & (ids != own)
                chosen = np.flatnonzero(meets)
                wide = chosen[free[chosen]]
                plain = chosen[~free[chosen]]
                for places, big in ((plain, False), (wide, True)):
                    if not len(places):
                        continue
                    scores = _exact(points[places], q, big)
                    for w, (low, high) in enumerate(zip(lows, highs, strict=True)):
                        # The ends of a long stand for no bound.
                        inside = np.array((scores >= low) | (low == _LEAST), bool) & np.array((scores <= high) | (high == _MOST), bool)
                        inside = np.flatnonzero(inside)
                        for i in inside[_best(scores[inside], k)]:
                            value = int(scores[i])
                            held = value if _LEAST <= value <= _MOST else None
                            for x, v in zip(out, (own, w, int(ids[places[i]]), _approximate(value), held), strict=True):
                                x.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("anchor_id", "w", "vec_id", "about", "score"), out, kinds, strict=True)})

    return score


class Blocks:
    """Rows sorted by nearest reference and angle, cut into blocks, with the angles and norms that each block spans."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS, slice_anchors: int = SLICE_ANCHORS, part_blocks: int = PART_BLOCKS):
        usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
        single = stored(
            usable.select(
                F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "asked",
                F.col("embedding").cast("array<double>").alias("vector"),
            ).groupBy("vec_id").agg(F.min(F.struct("label", "vector", "asked")).alias("r")).select("vec_id", "r.*")
        )
        n, asked = single.agg(F.count(F.lit(1)), F.count(F.when(F.col("asked"), 1))).first()
        self.slices, self.slice_anchors = max(-(-asked // slice_anchors), 1), slice_anchors
        grain = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 20)) < max(SAMPLE * (1 << 20) // max(n, 1), 1)
        sample: dict[int, list] = {}
        for row in single.where(grain).select("vector").limit(4 * SAMPLE).collect():
            sample.setdefault(len(row.vector), []).append(row.vector)
        directions = {d: references(quantized(np.array(v, float).reshape(len(v), d))) for d, v in sample.items()}
        placed = with_places(single.mapInArrow(_describe(directions), _DESCRIBED).orderBy("dim", "cell", "near", "vec_id"))
        self.rows = placed.withColumn("block", F.floor((F.col("place") - 1) / block_rows)).drop("place", "cell", "near")
        self.parts, self.part_blocks = max(-(-n // (block_rows * part_blocks)), 1), part_blocks
        self.spans = stored(
            self.rows.groupBy("dim", "block").agg(
                F.array(*[F.min(F.get("angles", F.lit(i))) for i in range(REFERENCES)]).alias("least"),
                F.array(*[F.max(F.get("angles", F.lit(i))) for i in range(REFERENCES)]).alias("most"),
                F.min("norm").alias("shortest"), F.max("norm").alias("longest"), F.collect_set("label").alias("labels"),
            )
        )

    def anchors(self) -> DataFrame:
        return self.rows.where("asked").drop("asked")

    def best(self, anchors: DataFrame, k: int, *, same: bool, at_home: bool = False) -> DataFrame:
        """anchor_id, w, vec_id, about, score, r: the first ``k`` rows of equal or other label in every window [lows[w], highs[w]]."""
        fields = [c.split()[0] for c in _ANCHOR.split(", ")]
        sliced = anchors.withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(self.slices)))
        if at_home:
            dealt = sliced.select("slice", *fields, "block")
        else:
            part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.parts - 1).cast("long")))
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.slices - 1).cast("long")))
            keys = ["dim", "slice", "part"]
            blocks = self.spans.withColumn("part", F.floor(F.col("block") / self.part_blocks) % self.parts).withColumn("slice", every)
            dealt = sliced.select("slice", *fields).withColumn("part", part).groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(
                _dealt(same), "slice long, " + _ANCHOR + ", block long"
            )
        dealt = stored(dealt)
        keys = ["dim", "block", "slice"]
        wanted = dealt.select(*[F.col(c).alias(c) for c in keys]).distinct()
        rows = self.rows.drop("asked").join(wanted, ["dim", "block"])
        found = dealt.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(
            _scored(same, k), "anchor_id long, w int, vec_id long, about double, score long"
        )
        order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("about"), F.desc("score"), "vec_id")
        return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, **sizes: int
) -> DataFrame:
    """Per anchor and positive the best rows of other labels that score from ``low`` to ``high`` percent of the positive.

    ``rows`` has vec_id, label and embedding.  Returns anchor_id, positive_id,
    rank, negative_id, positive_score and negative_score.
    """
    index = Blocks(rows.select("vec_id", "label", "embedding", F.coalesce(anchors, F.lit(False)).alias("asked")), **sizes)
    asked = index.anchors()
    least, most = F.lit(_LEAST).cast("long"), F.lit(_MOST).cast("long")
    whole = asked.withColumn("lows", F.array(least)).withColumn("highs", F.array(most))
    first = index.best(whole, positives, same=True, at_home=True)
    bar = first.groupBy("anchor_id").agg(F.when(F.count("score") >= positives, F.min("score")).alias("bar"))
    barred = asked.join(bar, F.col("vec_id") == F.col("anchor_id"), "left").withColumn("lows", F.array(F.coalesce("bar", least)))
    chosen = stored(index.best(barred.withColumn("highs", F.array(most)), positives, same=True).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "r"
    ))
    wide = "cast(positive_score as decimal(20,0))"
    windows = chosen.where("positive_score >= 0").groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "r", "positive_id", "positive_score",
            F.expr(f"cast(({wide} * {low} + 99) div 100 as bigint)").alias("low"), F.expr(f"cast(({wide} * {high}) div 100 as bigint)").alias("high"),
        ))).alias("p")
    )
    windowed = asked.join(windows, F.col("vec_id") == F.col("anchor_id")).withColumn("lows", F.col("p.low")).withColumn("highs", F.col("p.high"))
    found = index.best(windowed, negatives, same=False)
    pairs = windows.select("anchor_id", F.posexplode("p").alias("w", "p")).select("anchor_id", "w", "p.positive_id", "p.positive_score")
    return found.join(pairs, ["anchor_id", "w"]).select(
        "anchor_id", "positive_id", F.col("r").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


#: The same rows by scoring all rows for every anchor; vec_id must be unique.
NEGATIVES_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE own = label)
  WHERE r <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own
    AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
