"""Quality classifier: naive Bayes support vectors.

A text is the set of its byte n-grams, hashed; repeated words share indicators of their own. Each indicator is scaled by its class log-count ratio,
rows are brought to unit length, and a linear model is fitted to the hinge loss by dual coordinate
descent; a logistic curve over the margins makes scores. Fitting reads a bounded sample of labelled
rows (SAMPLE_ROWS and SAMPLE_FEATURES, by the hash of their ids); scoring reads every whole text.

Defined cases: a null text counts as empty, and an empty text has the score of the model's offset; a
null id is never held out and has no label; of an id's several labels the lowest counts; a sample
without both classes gives its class's share (0.5 without any) as every score; repeated rows give
repeated rows, and count in the sample each, within its bounds; empty tables give empty results; other columns are ignored (``keep_good`` keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import free, map_slices, stored

#: Bytes in n-grams, bits of their hashes.
GRAMS, HASH_BITS = (2, 3, 4), 18
#: Numbers, and one in how many word pairs, at which repeated words become indicators.
REPEATS, SHARES = (1, 2, 3, 5, 8), (32, 16, 8, 4, 2)
#: Labelled rows that fitting reads at most, and indicators of all of them together.
SAMPLE_ROWS, SAMPLE_FEATURES = 4000, 24_000_000
#: Added to counts; penalty of the hinge loss; most passes over the sample, and the gradient at which they end; ids of this remainder are held out.
SMOOTHING, PENALTY, PASSES, TOLERANCE, FOLDS = 1.0, 1.0, 100, 0.01, 5
THRESHOLD = 0.3


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def _repeats(words: list[bytes]) -> np.ndarray:
    """Word bigrams and trigrams of one word back off to shared indicators, by number and by share."""
    same = np.fromiter(map(eq, words, words[1:]), bool, max(len(words) - 1, 0))
    two, three = int(same.sum()), int((same[:-1] & same[1:]).sum()) if len(same) > 1 else 0
    held = [two >= n for n in REPEATS] + [three >= n for n in REPEATS] + [two * n >= len(same) > 0 for n in SHARES]
    return np.flatnonzero(held).astype(np.uint32)


def features(text: str | None) -> np.ndarray:
    """The sorted distinct hashed n-grams of a text."""
    raw = (text or "").encode()
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out, gram = [_repeats(raw.split())], b
    for n in range(2, max(GRAMS) + 1):
        gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :] if len(gram) > 1 else gram[:0]
        if n in GRAMS:
            out.append((gram * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B * n & 0xFFFFFFFF)) >> np.uint32(32 - HASH_BITS))
    return np.unique(np.concatenate(out)).astype(np.int32)


@dataclass
class Model:
    """``ratio``: class log-count ratios; ``weight``: of unit-length scaled rows; a logistic curve."""

    ratio: np.ndarray
    weight: np.ndarray
    offset: float
    slope: float
    level: float

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        length = float(np.sqrt(r @ r))
        return self.offset + (float(self.weight[found] @ r) / length if length else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.level, -30, 30))))


def fit(rows: list[np.ndarray], labels: list[int], seed: int = 7) -> Model:
    size = 1 << HASH_BITS
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    share = float((y > 0).mean()) if len(y) else 0.5
    if not 0 < share < 1:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = {c: np.full(size, SMOOTHING) for c in (-1.0, 1.0)}
    for found, c in zip(rows, y, strict=True):
        counts[c][found] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    scaled = [ratio[f] / max(float(np.sqrt(ratio[f] @ ratio[f])), 1e-12) for f in rows]
    # Dual coordinate descent; the constant feature 1 carries the offset. Classes weigh the same.
    cost = np.where(y > 0, PENALTY / (2 * share), PENALTY / (2 * (1 - share)))
    weight, offset, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        worst = 0.0
        for i in rng.permutation(len(y)):
            f, x = rows[i], scaled[i]
            gradient = y[i] * (weight[f] @ x + offset) - 1
            if not (alpha[i] == 0 and gradient > 0 or alpha[i] == cost[i] and gradient < 0):
                worst = max(worst, abs(gradient))
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weight[f] += step * x
                offset += step
                alpha[i] = new
        if worst < TOLERANCE:
            break
    model = Model(ratio, weight, float(offset), 1.0, 0.0)
    margins = np.array([model.margin(f) for f in rows])
    model.slope, model.level = _logistic(margins, (y > 0).astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method on the logistic loss with slightly softened targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents that aren't held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).cast("int").alias("quality_label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(rows)  # so many rows at most, each two numbers
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.toDF("of", "label")), F.col("id") == F.col("of")).select(F.xxhash64("id").alias("place"), F.col("id").cast("string").alias("id"), "label", "text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(t) for t in batch.column(3).to_pylist()]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *found]), pa.int32()))
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets), pa.int32()), lists], names=["place", "id", "label", "n", "found"])

        return work

    # The rows are chosen by their keys, before any text's indicators leave the executors.
    held = stored(docs.sparkSession, map_slices(sample, make, "place long, id string, label int, n int, found array<int>").withColumn("same", F.xxhash64("found")), "sample")
    order = ("place", "id", "n", "same")
    first = held.select(*order).orderBy(*order).limit(rows).collect()  # so many rows at most
    taken, size = 0, 0
    while taken < len(first) and size + first[taken]["n"] <= SAMPLE_FEATURES:
        size, taken = size + first[taken]["n"], taken + 1
    if not taken:
        return fit([], [])
    last = F.struct(*(F.lit(first[taken - 1][c]).cast(held.schema[c].dataType).alias(c) for c in order))
    gathered = held.where(F.struct(*order) <= last).orderBy(*order).limit(taken).select("label", "found").toArrow().combine_chunks()
    flat = gathered.column("found").combine_chunks()
    values, offsets = flat.values.to_numpy(), flat.offsets.to_numpy()
    return fit([values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], gathered.column("label").to_pylist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: str | None = None) -> DataFrame:
    """(id_col, score) for every row; or all columns of ``docs`` and the score as ``extra``."""
    chosen = docs if extra else docs.select(id_col, text_col)
    at = chosen.columns.index(text_col)
    small = Model(model.ratio.astype(np.float32), model.weight.astype(np.float32), model.offset, model.slope, model.level)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = pa.array([small.score(features(t)) for t in batch.column(at).to_pylist()], pa.float64())
            return pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, extra]) if extra else pa.RecordBatch.from_arrays([batch.column(0), scores], names=[id_col, "score"])

        return work

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if extra or f.name == id_col]
    return map_slices(chosen, make, ", ".join([*fields, f"`{extra or 'score'}` double"]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``."""
    model, (extra,) = train(docs, labels, **options), free(docs, "score")
    return score(docs, model, extra=extra).where(F.col(extra) >= threshold).drop(extra)
