"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other text, whatever its label,
is unlabelled.  A linear classifier over hashed words minimises the
class-prior-corrected risk  p R+(positives) + max(0, R-(unlabelled) - p R-(positives)).

Defined cases: null and empty texts have no words and get the score of the bias
alone; a null label counts as unlabelled; repeated labels of one document count
as toxic if any is; without a single positive every score is 0; rows with null
ids are scored but never learned from.  Repeated words count once, so ties and
very long texts need no special care.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.llm.textarrays import NOT_ALNUM, steps, utf8, words

BUCKETS = 1 << 20
#: The fit uses about so many labelled rows of either kind at most.
POSITIVES, UNLABELLED = 6_000, 24_000
THRESHOLD = 0.7
_LEAST_ROWS = 3  # a word of fewer training texts gets no weight
_GRAIN = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of each text, and the texts' offsets in them."""
    hashes, own = words(data, offsets, NOT_ALNUM)
    texts = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(own))
    keys = np.unique((texts << np.uint64(20)) | (hashes & np.uint64(BUCKETS - 1)))
    own = np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(20))
    return (keys & np.uint64(BUCKETS - 1)).astype(np.int32), own


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        rest = [batch.column(c) for c in ("toxic", "left_out", "weight")]
        for first, last in steps(offsets):
            found, own = word_buckets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            rows = pa.array([found[a:b].tobytes() for a, b in zip(own[:-1], own[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows, *[c.slice(first, last - first) for c in rest]], ["found", "toxic", "left_out", "weight"])


def fit_nnpu(
    rows: list[np.ndarray],
    positive: np.ndarray,
    prior: float,
    epochs: int = 200,
    decay: float = 1e-2,
    stands_for: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """Weights per bucket and bias.  ``rows`` holds each text's buckets; all rows count as unlabelled.

    ``stands_for`` is the number of rows each one stands for (its inverse sampling rate), 1 by default.
    """
    weights = np.zeros(BUCKETS, np.float32)
    if not positive.any():
        return weights, -50.0
    share = np.ones(len(rows)) if stands_for is None else np.asarray(stands_for, float)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    often = np.bincount(flat, minlength=BUCKETS) >= _LEAST_ROWS
    kept = np.flatnonzero(often)
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    text = np.repeat(np.arange(len(rows)), lengths)[often[flat]]
    word = place[flat[often[flat]]]
    # Rare words speak louder: a word's value is its log inverse share of the texts.
    value = np.log(share.sum() / np.bincount(word, share[text], len(kept)))
    w, bias = np.zeros(len(kept)), np.log(prior / (1 - prior))
    step, m, v = 0.05, np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    p, u = positive * share / (positive * share).sum(), share / share.sum()
    for t in range(1, epochs + 1):
        z = np.bincount(text, (w * value)[word], len(rows)) + bias
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        negative = (u * np.logaddexp(0, z)).sum() - prior * (p * np.logaddexp(0, z)).sum()
        if negative >= 0:  # slopes of log(1 + e^-z) and log(1 + e^z) are s - 1 and s
            slope = prior * p * (s - 1) + u * s - prior * p * s
        else:  # the corrected risk of negatives fell below zero: go back up
            slope = prior * p * s - u * s
        g = np.append(value * np.bincount(word, slope[text], len(kept)) + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = step * min(1.0, 2 * (1 - t / epochs)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights[kept] = w * value
    return weights, float(bias)


def calibrate(z: np.ndarray, toxic: np.ndarray, stands_for: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logits of least log loss (Newton's steps); the slope stays positive."""
    slope, shift = 1.0, 0.0
    share = np.ones(len(z)) if stands_for is None else np.asarray(stands_for, float)
    if not toxic.any() or toxic.all():
        return slope, shift
    # Targets stay off 0 and 1, so that separable rows have a finite optimum.
    n = toxic.sum()
    target = np.where(toxic, (n + 1) / (n + 2), 1 / (len(z) - n + 2))
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        off = share * (s - target)
        g = np.array([(off * z).sum(), off.sum()])
        v = share * (s * (1 - s) + 1e-6)
        h = np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, g)
        slope, shift = max(slope - np.clip(move[0], -1, 1), 1e-3), shift - np.clip(move[1], -2, 2)
    return slope, shift


def _trainer(prior: float) -> Callable:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, toxic, left_out, share = [], [], [], []
        for batch in batches:
            rows += [np.frombuffer(x, np.int32) for x in batch.column("found").to_pylist()]
            toxic += batch.column("toxic").to_pylist()
            left_out += batch.column("left_out").to_pylist()
            share += batch.column("weight").to_pylist()
        if rows:
            toxic, left_out, share = np.array(toxic, bool), np.array(left_out, bool), np.array(share, float)
            if not toxic[left_out].any() or not toxic[~left_out].any():
                left_out[:] = False
            fitted = np.flatnonzero(~left_out)
            weights, bias = fit_nnpu([rows[i] for i in fitted], toxic[fitted], prior, stands_for=share[fitted])
            z = np.array([weights[rows[i]].sum() + bias for i in np.flatnonzero(left_out)])
            slope, shift = calibrate(z, toxic[left_out], share[left_out])
            weights, bias = weights * np.float32(slope), bias * slope + shift
            kept = np.flatnonzero(weights)
            out = io.BytesIO()
            np.savez(out, kept=kept.astype(np.int32), weights=weights[kept], bias=bias)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    return train


def train_toxicity(docs: DataFrame, labels: DataFrame) -> bytes:
    """Fit on a bounded sample of the labelled rows that are not held out.

    The sample is chosen by a hash of the id; the class prior is the share of
    toxic rows among all labelled rows that are not held out.  A quarter of the
    sample is left out of the fit and calibrates the score.  Toxic rows may be
    sampled at a higher rate than others; every row counts by its inverse rate.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("toxic"))
    )
    counts = {bool(r["toxic"]): r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives, rows = counts.get(True, 0), sum(counts.values())
    if not positives:
        return b""
    grain = F.pmod(F.xxhash64("doc_id"), F.lit(_GRAIN))
    ordinary = int(_GRAIN * min(1.0, UNLABELLED / rows))
    toxic = int(_GRAIN * min(1.0, POSITIVES / positives))
    # Both shares are alike for small tables.  Each row stands for as many labelled rows as its share leaves out.
    taken = F.when(F.col("toxic"), F.lit(max(toxic, ordinary, 1))).otherwise(F.lit(max(ordinary, 1)))
    sample = known.where(grain < taken).withColumn("weight", F.lit(float(_GRAIN)) / taken)
    prior = min(max(positives / rows, 1e-4), 0.5)
    model = (
        docs.select("doc_id", "text")
        # The sample is bounded by the two parameters, whatever the tables' sizes: the texts stay where they are.
        .join(F.broadcast(sample), "doc_id")
        .select("text", "toxic", "weight", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).alias("left_out"))
        .mapInArrow(_features, "found binary, toxic boolean, left_out boolean, weight double")
        .repartition(1)
        .mapInArrow(_trainer(prior), "model binary")
        .collect()
    )
    return bytes(model[0]["model"]) if model else b""


def _scorer(model: bytes, fields: list[str]) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = np.zeros(BUCKETS), -np.inf
        if model:
            kept = np.load(io.BytesIO(model))
            weights[kept["kept"]], bias = kept["weights"], float(kept["bias"])
        weighty = weights != 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            total = np.zeros(len(offsets) - 1)
            for first, last in steps(offsets):
                hashes, own = words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], NOT_ALNUM)
                found = hashes & np.uint64(BUCKETS - 1)
                texts = np.repeat(np.arange(last - first, dtype=np.uint64), np.diff(own))
                heavy = weighty[found]
                keys = np.unique((texts[heavy] << np.uint64(20)) | found[heavy])
                total[first:last] = np.bincount(
                    (keys >> np.uint64(20)).astype(np.int64), weights[keys & np.uint64(BUCKETS - 1)], last - first
                )
            s = 1 / (1 + np.exp(-np.clip(total + bias, -700, 700))) if model else total
            columns = [batch.column(c) for c in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s, pa.float64())], [*fields, "score"])

    return score


def score_toxicity(docs: DataFrame, model: bytes, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every document with ``score``, and ``predicted`` 1 from the threshold on."""
    rest = [c for c in keep if c != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields] + ["score double"])
    scored = docs.select("text", *rest).mapInArrow(_scorer(model, keep), schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
