"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader with elastic-net
penalties; a temperature fitted on texts left out of the fit calibrates the
probabilities.

Defined cases: null texts and texts without a letter get ``und`` and score 0;
so does every text if nothing could be learned.  Ties go to the language that
sorts first.  Documents with null lang or null id are not learned from.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.llm.textarrays import mix, steps

ORDERS = (1, 2, 3)
BUCKETS = 1 << 17
#: The fit uses about so many labelled rows of each language at most.
ROWS_PER_LANGUAGE = 3_000
_GRAIN = 1_000_000
_SCALE = 30.0  # shares of single n-grams are small; the learner steps in units of about one
UNDETERMINED = "und"


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of the lower-cased texts, grouped by text, and the texts' offsets."""
    # A blank on either side marks the ends of a text.
    lowered = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    found = np.full((len(points), len(ORDERS)), BUCKETS, np.int32)  # the last bucket stands for nothing
    code = np.zeros(len(points), np.uint64)
    for k, n in enumerate(ORDERS):
        if len(points) < n:
            continue
        with np.errstate(over="ignore"):
            code = code[: len(points) - n + 1] * np.uint64(0x110000) + points[n - 1 :] + np.uint64(1)
        inside = text[: len(code)] == text[n - 1 :]
        found[: len(code), k] = np.where(inside, (mix(code + np.uint64(n << 60)) & np.uint64(BUCKETS - 1)).astype(np.int32), BUCKETS)
    return found.ravel(), np.concatenate([[0], ends]) * len(ORDERS)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    texts = ["" if t is None else t for t in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for first, last in steps(offsets, 1 << 20):
        yield first, last, texts[first:last]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        for _, _, texts in _texts(batch.column("text")):
            found, own = ngrams(texts)
            for a, b in zip(own[:-1], own[1:], strict=True):
                once = np.zeros(BUCKETS + 1, bool)
                once[found[a:b]] = True
                seen += once
            seen[BUCKETS] = 0
    kept = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(seen[kept], pa.int64())], ["bucket", "n"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, texts in _texts(batch.column("text")):
            found, own = ngrams(texts)
            buckets, shares = [], []
            for a, b in zip(own[:-1], own[1:], strict=True):
                kept, n = np.unique(found[a:b], return_counts=True)
                inside = kept < BUCKETS
                buckets.append(kept[inside].astype(np.int32).tobytes())
                shares.append((n[inside] / max(n[inside].sum(), 1)).astype(np.float32).tobytes())
            rest = [batch.column(c).slice(first, last - first) for c in ("lang", "left_out")]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.binary()), pa.array(shares, pa.binary()), *rest], ["buckets", "shares", "lang", "left_out"])


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 6,
    batch: int = 64, rate: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 1,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal weights (buckets x classes) and biases for rows of (buckets, values)."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        pull = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -pull / ((beta + np.sqrt(n[at])) / rate + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for chosen in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            buckets = np.concatenate([np.append(rows[i][0], BUCKETS) for i in chosen])  # the bias is one more bucket
            values = np.concatenate([np.append(rows[i][1], 1.0) for i in chosen])
            text = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) + 1 for i in chosen])
            at, back = np.unique(buckets, return_inverse=True)
            w = weights(at)
            logits = np.zeros((len(chosen), classes))
            for k in range(classes):
                logits[:, k] = np.bincount(text, values * w[back, k], len(chosen))
            logits -= logits.max(1, keepdims=True)
            slope = np.exp(logits)
            slope /= slope.sum(1, keepdims=True)
            slope[np.arange(len(chosen)), labels[chosen]] -= 1
            slope /= len(chosen)
            for k in range(classes):
                g = np.bincount(back, values * slope[text, k], len(at))
                grown = (np.sqrt(n[at, k] + g * g) - np.sqrt(n[at, k])) / rate
                z[at, k] += g - grown * w[:, k]
                n[at, k] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by a finer and finer search."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(labels)), labels]).mean())

    low, high = np.log(0.02), np.log(50)
    for _ in range(4):
        grid = np.linspace(low, high, 41)
        best = int(np.argmin([loss(np.exp(x)) for x in grid]))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, 40)]
    return float(np.exp((low + high) / 2))


def _trainer(idf: bytes, languages: list[str]) -> Callable:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.frombuffer(idf, np.float32)
        rows, labels, left_out = [], [], []
        for batch in batches:
            for b, s in zip(batch.column("buckets").to_pylist(), batch.column("shares").to_pylist(), strict=True):
                at = np.frombuffer(b, np.int32)
                rows.append((at, np.frombuffer(s, np.float32) * scale[at]))
            labels += [languages.index(x) for x in batch.column("lang").to_pylist()]
            left_out += batch.column("left_out").to_pylist()
        if not rows:
            return
        labels, left_out = np.array(labels), np.array(left_out, bool)
        if left_out.all():
            left_out[:] = False
        fitted = np.flatnonzero(~left_out)
        w, bias = fit_ftrl([rows[i] for i in fitted], labels[fitted], len(languages))
        logits = np.array([rows[i][1] @ w[rows[i][0]] + bias for i in np.flatnonzero(left_out)]).reshape(-1, len(languages))
        out = io.BytesIO()
        np.savez(out, weights=(w * scale[:, None]).astype(np.float32), bias=bias, temperature=fit_temperature(logits, labels[left_out]))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    return train


def train_language(docs: DataFrame) -> tuple[list[str], bytes]:
    """Fit on a bounded sample of the rows with a lang that are not held out.

    Document frequencies cover all such rows.  A quarter of the sample is left
    out of the fit and sets the temperature.
    """
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], b""
    seen = known.select("text").mapInArrow(_document_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = np.zeros(BUCKETS)
    for row in seen.collect():  # at most one row per bucket
        frequency[row["bucket"]] = row["n"]
    idf = (np.log((1 + sum(counts.values())) / (1 + frequency)) + 1).astype(np.float32) * np.float32(_SCALE)
    grain = F.pmod(F.xxhash64("doc_id"), F.lit(_GRAIN))
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, int(_GRAIN * min(1.0, ROWS_PER_LANGUAGE / counts[k])))])
    sample = known.where(grain < shares[F.col("lang")]).withColumn("left_out", remainder(F.col("doc_id")) == 1)
    model = (
        sample.select("text", "lang", "left_out")
        .mapInArrow(_counts, "buckets binary, shares binary, lang string, left_out boolean")
        .repartition(1)
        .mapInArrow(_trainer(idf.tobytes(), languages), "model binary")
        .collect()
    )
    return (languages, bytes(model[0]["model"])) if model else ([], b"")


def _predictor(languages: list[str], model: bytes) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(languages)
        if k:
            kept = np.load(io.BytesIO(model))
            weights = np.vstack([kept["weights"], np.zeros((1, k), np.float32)])
            by_language = [np.ascontiguousarray(weights[:, j]) for j in range(k)]
            bias, temperature = kept["bias"], float(kept["temperature"])
        for batch in batches:
            languages_out, scores = [], []
            for _, _, texts in _texts(batch.column("text")):
                lettered = np.array([any(c.isalpha() for c in t) for t in texts], bool)
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                if k:
                    found, own = ngrams(texts)
                    n = np.add.reduceat((found < BUCKETS).astype(np.int64), own[:-1])
                    logits = np.stack([np.add.reduceat(w[found], own[:-1], dtype=np.float64) for w in by_language], 1)
                    logits = (logits / np.maximum(n, 1)[:, None] + bias) / temperature
                    logits -= logits.max(1, keepdims=True)
                    shares = np.exp(logits)
                    shares /= shares.sum(1, keepdims=True)
                    best = shares.argmax(1)
                    score = shares[np.arange(len(texts)), best]
                known = lettered & bool(k)
                languages_out += [languages[b] if y else UNDETERMINED for b, y in zip(best, known, strict=True)]
                scores.append(np.where(known, score, 0.0))
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(languages_out, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return predict


def predict_language(docs: DataFrame, languages: list[str], model: bytes) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _predictor(languages, model), f"doc_id {kind}, lang_pred string, score double"
    )
