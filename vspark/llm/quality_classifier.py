"""Operator 7: quality scores by Bradley-Terry pairwise ranking."""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial, reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import with_computed
from .common import cut, remove, shared_dir, ship
from .language import held_out
from .quality_rules import base_features, char_histogram

RIDGE = 1e-2
STEPS = 25
#: Documents that score this or more are predicted 1.
CUT = 0.7
SEED = 7
#: Steps of the grids of scores over which pairs are summed up: of the loss's gradient (a multiple goes into the other one), and of its curvature.
GRID, COARSE = 1 / 64, 1 / 4
#: Standardised features beyond this count as this.
FAR = 8.0
#: Stretches of scores that are counted at once in the search for the cut.
BINS = 1024
#: A column of features made before, which saves reading the texts again.
FEATURES = "__features"


def features(text: str | None) -> list[float]:
    """What a text is judged by; all of it is shares or logarithms, so that long texts are judged like short ones."""
    n, chars, symbols, dup_lines, repeated = base_features(text)
    classes = char_histogram(text)
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    total = max(1.0, classes.sum())
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    per_word = max(1, n)
    ends = sum(x.rstrip()[-1:] in b".!?:\"'" for x in lines)
    out = list(classes / total)
    out += [np.sqrt(x) for x in classes / total]
    out += [
        np.log1p(n), min(chars / per_word, 30.0), np.log1p(symbols / per_word), np.sqrt(symbols / per_word), dup_lines / max(1, len(lines)),
        repeated / per_word, same / per_word, np.sqrt(same / per_word), sum(len(w) < 4 for w in words) / per_word,
        np.log(len(set(words)) + 1) - 0.75 * np.log(n + 1), ends / max(1, len(lines)), np.log1p(per_word / max(1, len(lines))),
        min(20.0, data.count(b"!") / per_word), float(n == 0), float(n < 20),
    ]
    return [float(x) for x in out]


@dataclass
class Ranking:
    """Weights of standardised features; `cut` and `scale` put scores on 0..1 so that the quantile cut lies at CUT."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -FAR, FAR)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.log(CUT / (1 - CUT)) + (self.raw(x) - self.cut) / self.scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Features [document, feature] and labels (1: good, 0: bad), some documents at a time.
Chunks = Iterable[tuple[np.ndarray, np.ndarray]]
#: Calls a function with the chunks of each part of the documents and returns what the parts give.
Run = Callable[[Callable[[Chunks], Any]], list]
#: From a model without weights, a function from weights to the gradient and the curvature of the loss, both without the ridge.
Loss = Callable[[Ranking], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]


def _merged(a: tuple, b: tuple) -> tuple:
    """Number, mean and sum of squared distances to it, of two sets together."""
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + d**2 * (a[0] * b[0] / n)


def _moments(chunks: Chunks) -> tuple[np.ndarray, tuple]:
    """Documents by label; number, mean and sum of squared distances of their features."""
    made = [(np.bincount(y, minlength=2), (len(x), m := x.mean(axis=0), ((x - m) ** 2).sum(axis=0))) for x, y in chunks]
    return sum(m[0] for m in made), reduce(_merged, (m[1] for m in made))


def _half(weights: np.ndarray, step: float) -> int:
    """Grid points on each side of 0 that no score lies beyond; the grid has one more at its end."""
    return math.ceil(FAR * np.abs(weights).sum() / step) + 1


def _places(u: np.ndarray, weights: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The grid point below each score, and how far it is from there to the next."""
    at = u / step + _half(weights, step)
    below = np.floor(at).astype(np.int64)
    return below, at - below


def _histogram(model: Ranking, chunks: Chunks) -> tuple[int, np.ndarray]:
    """Documents by label and grid point from the first one used, each dealt to the two points next to its score."""
    size = 2 * _half(model.weights, GRID) + 2
    out = np.zeros((2, size))
    for x, y in chunks:
        below, rest = _places(model.raw(x), model.weights, GRID)
        for k in (0, 1):
            out[k] += np.bincount(below[y == k], 1 - rest[y == k], size) + np.bincount(below[y == k] + 1, rest[y == k], size)
    used = np.flatnonzero(out.any(axis=0))
    return used[0], out[:, used[0] : used[-1] + 1]


def _against(counts: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray], step: float) -> np.ndarray:
    """By grid point, the sum of kernel(its score - another's) over counts of others."""
    used = np.flatnonzero(counts.any(axis=0))
    first, last = used[0], used[-1] + 1
    by_distance = kernel(step * np.arange(first - last + 1, last - first))
    out = np.zeros_like(counts)
    # A good document is held against bad ones, with the difference good - bad; a bad one against good ones.
    out[1, first:last] = np.convolve(counts[0, first:last], by_distance, "valid")
    out[0, first:last] = np.convolve(counts[1, first:last], by_distance[::-1], "valid")
    return out


def _lost(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(d, -30, 30)))


def _bent(d: np.ndarray) -> np.ndarray:
    return _lost(d) * _lost(-d)


def _sums(model: Ranking, lost: np.ndarray, bent: np.ndarray, chunks: Chunks) -> tuple:
    """By the tables of _against: the weighted sums of features and of their products, and by label and coarse grid point the sums of features."""
    width = len(model.weights)
    first, second, moved = np.zeros((2, width)), np.zeros((2, width, width)), np.zeros((2, 2 * _half(model.weights, COARSE) + 2, width))
    for x, y in chunks:
        x = model.standard(x)
        u = x @ model.weights
        for k in (0, 1):
            z = x[y == k]
            below, rest = _places(u[y == k], model.weights, GRID)
            value = lambda table: table[k][below] * (1 - rest) + table[k][below + 1] * rest  # noqa: B023, E731
            first[k] += value(lost) @ z
            below, rest = _places(u[y == k], model.weights, COARSE)
            second[k] += (z * value(bent)[:, None]).T @ z
            order = np.argsort(below, kind="stable")
            starts = np.flatnonzero(np.diff(below[order], prepend=-1))
            for shift, share in ((0, 1 - rest), (1, rest)):
                if len(z):
                    moved[k][below[order][starts] + shift] += np.add.reduceat((z * share[:, None])[order], starts)
    used = np.flatnonzero(moved.any(axis=(0, 2)))
    low, high = (used[0], used[-1] + 1) if len(used) else (0, 0)
    return first, second, low, moved[:, low:high]


def all_pairs(run: Run, counts: np.ndarray) -> Loss:
    """The mean loss over all pairs of a good and a bad document.

    A document's sum over its opponents depends on its score alone, so that it is read from a table made of the counts of
    opponents by score. Scores are dealt to the points of a grid, in a way that leaves their mean: the gradient is that of
    all pairs but for about 1e-6. The curvature, on which the minimum does not depend, is that of all pairs on a wider grid.
    """

    def of(model: Ranking) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        def evaluate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = replace(model, weights=w)
            half, wide = _half(w, GRID), _half(w, COARSE)
            fine = np.zeros((2, 2 * half + 2))
            for low, part in run(partial(_histogram, at)):
                fine[:, low : low + part.shape[1]] += part
            fine /= counts[:, None]
            points, knots = GRID * (np.arange(fine.shape[1]) - half), np.zeros((2, 2 * wide + 2))
            below, rest = _places(points, w, COARSE)
            for k in (0, 1):
                inside = fine[k] > 0
                knots[k] = np.bincount(below[inside], ((1 - rest) * fine[k])[inside], knots.shape[1]) + np.bincount(below[inside] + 1, (rest * fine[k])[inside], knots.shape[1])
            first, second, moved = np.zeros((2, len(w))), np.zeros((2, len(w), len(w))), np.zeros((2, knots.shape[1], len(w)))
            for one, two, low, part in run(partial(_sums, at, _against(fine, _lost, GRID), _against(knots, _bent, COARSE))):
                first += one
                second += two
                moved[:, low : low + part.shape[1]] += part
            moved /= counts[:, None, None]
            used = np.flatnonzero(moved.any(axis=(0, 2)))
            cross = moved[1, used].T @ _bent(COARSE * (used[:, None] - used[None])) @ moved[0, used]
            return first[1] / counts[1] - first[0] / counts[0], (second / counts[:, None, None]).sum(axis=0) - cross - cross.T

        return evaluate

    return of


def drawn_pairs(good: np.ndarray, bad: np.ndarray, pairs: int) -> Loss:
    """The mean loss over that many drawn pairs."""

    def of(model: Ranking) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        rng = np.random.default_rng(SEED)
        d = model.standard(good)[rng.integers(0, len(good), pairs)] - model.standard(bad)[rng.integers(0, len(bad), pairs)]

        def evaluate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return d.T @ _lost(d @ w) / pairs, (d * _bent(d @ w)[:, None]).T @ d / pairs

        return evaluate

    return of


def _ends(model: Ranking, chunks: Chunks) -> tuple[float, float, np.ndarray]:
    """Least and largest score; sums of scores by label."""
    made = [(u.min(), u.max(), np.bincount(y, u, 2)) for u, y in ((model.raw(x), y) for x, y in chunks)]
    return min(m[0] for m in made), max(m[1] for m in made), sum(m[2] for m in made)


def _stretches(model: Ranking, low: float, high: float, chunks: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the scores from low to high, by stretch: counts by label, the least and the largest."""
    count, least, most = np.zeros((2, BINS + 1), np.int64), np.full(BINS + 1, np.inf), np.full(BINS + 1, -np.inf)
    for x, y in chunks:
        u = model.raw(x)
        inside = (u >= low) & (u <= high)
        u, y = u[inside], y[inside]
        at = ((u - low) / (high - low or 1.0) * BINS).astype(np.int64)
        for k in (0, 1):
            count[k] += np.bincount(at[y == k], minlength=BINS + 1)
        np.minimum.at(least, at, u)
        np.maximum.at(most, at, u)
    return count, least, most


def _next(model: Ranking, score: float, chunks: Chunks) -> float:
    """The least score above `score`; infinite if there is none."""
    return min(float(u[u > score].min(initial=np.inf)) for u in (model.raw(x) for x, _ in chunks))


def quantile(run: Run, model: Ranking, low: float, high: float, weight: np.ndarray, share: float) -> float:
    """Halfway between the first score at which the weights (by label) of scores up to it reach `share`, and the score after it.

    Exact: the stretch that holds it is counted again until it holds a single score.
    """
    before = np.zeros(2, np.int64)
    share -= 1e-12
    while True:
        parts = run(partial(_stretches, model, low, high))
        count, least, most = sum(p[0] for p in parts), np.min([p[1] for p in parts], axis=0), np.max([p[2] for p in parts], axis=0)
        up_to = weight @ (before[:, None] + np.cumsum(count, axis=1))
        at = min(int(np.searchsorted(up_to, share)), int(np.flatnonzero(count.any(axis=0))[-1]))
        before = before + count[:, :at].sum(axis=1)
        low, high = float(least[at]), float(most[at])
        if low == high:
            break
    # Of equal scores bad documents come last.
    same = count[:, at]
    if same.sum() > 1 and weight @ (before + same) - weight[0 if same[0] else 1] >= share:
        return low
    after = min(run(partial(_next, model, low)))
    return (low + after) / 2 if np.isfinite(after) else low


def fit(run: Run, share_bad: float | None = None, loss: Loss | None = None) -> Ranking | None:
    """Fit by Newton steps the loss mean(log(1 + exp(-(u_good - u_bad)))) over pairs of a good and a bad document, u being linear in the features.

    All documents and all pairs count, unless another loss is given. The cut is the quantile of the scores that leaves share_bad below, each label weighing
    by it, or as many as there are bad documents: halfway to the next score. Weights are rounded, so that the dealing of documents to parts doesn't show. None if a label does not occur.
    """
    parts = run(_moments)
    counts = sum((p[0] for p in parts), np.zeros(2, np.int64))
    if not counts.all():
        return None
    n, mean, squares = reduce(_merged, (p[1] for p in parts))
    model = Ranking(mean.round(12), (np.sqrt(squares / n) + 1e-6).round(12), np.zeros(len(mean)), 0.0, 1.0)
    evaluate = (loss or all_pairs(run, counts))(model)
    w = model.weights
    for _ in range(STEPS):
        gradient, curve = evaluate(w)
        step = np.linalg.solve(curve + RIDGE * np.eye(len(w)), gradient - RIDGE * w)
        w = w + step * min(1.0, 5 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w.round(9)
    ends = run(partial(_ends, model))
    of_bad, of_good = (math.fsum(e[2][k] for e in ends) / counts[k] for k in (0, 1))
    share = counts[0] / counts.sum() if share_bad is None else share_bad
    model.cut = quantile(run, model, min(e[0] for e in ends), max(e[1] for e in ends), np.array([share, 1 - share]) / counts, share)
    model.scale = round(max(1e-6, float(of_good - of_bad) / 8), 9)
    return model


def rank(good: np.ndarray, bad: np.ndarray, share_bad: float, pairs: int | None = None) -> Ranking:
    """fit() for documents in memory; with `pairs`, over that many drawn pairs instead of all."""
    x, y = np.concatenate([good, bad]), np.repeat([1, 0], [len(good), len(bad)])
    return fit(lambda part: [part([(x, y)])], share_bad, None if pairs is None else drawn_pairs(good, bad, pairs))


def featured(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with FEATURES, the features of text as bytes; fit_quality and score_quality take it in place of text."""
    added = T.StructType([T.StructField(FEATURES, T.BinaryType())])
    return with_computed(docs, ["text"], keep, added, lambda: lambda text: (np.array(features(text)).tobytes(),))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The labels and features of a batch as one row."""
    for batch in batches:
        if batch.num_rows:
            y, x = np.array(batch.column(0).to_pylist(), np.int8).tobytes(), b"".join(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.binary()), pa.array([x], pa.binary())], names=["y", "x"])


def _over(packed: DataFrame) -> Run:
    """Runs over packed rows in the executors, a part a task. What comes to the driver grows with the number of parts only."""

    def run(part: Callable[[Chunks], Any]) -> list:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((y.as_py(), x.as_py()) for b in batches for y, x in zip(b.column(0), b.column(1), strict=True))
            labelled = ((np.frombuffer(x).reshape(len(y), -1), np.frombuffer(y, np.int8)) for y, x in rows)
            first = next(labelled, None)
            if first is not None:
                made = part(c for some in ([first], labelled) for c in some)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["made"])

        return [pickle.loads(r["made"]) for r in packed.mapInArrow(task, "made binary").collect()]

    return run


def fit_quality(docs: DataFrame, labels: DataFrame) -> Ranking | None:
    """A ranking learned from labels.quality of all documents that are not held out; None if a label does not occur.

    Every labelled document and every pair of a good and a bad one counts, one row of each doc_id and label: of several texts of
    one doc_id that of the least features (as bytes) counts. doc_id: of any type that can be cast to text; null is not learned from. Features
    are dealt out by doc_id and lie in the shared folder while they are learned from; each Newton step reads them twice, and only sums of each part come to
    the driver. Empty tables: None.
    """
    spark = docs.sparkSession
    ship(spark)
    learned = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    known = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & learned).distinct()
    rows = docs.filter(learned)
    rows = rows.select("doc_id", FEATURES) if FEATURES in docs.columns else featured(rows)
    # Repeated ids are joined once; what is dealt out are features, not texts.
    one = rows.groupBy("doc_id").agg(F.min(FEATURES).alias(FEATURES))
    path = f"{shared_dir(spark)}/quality-{uuid.uuid4().hex}"
    try:
        one.join(known, "doc_id").select(F.col("quality").cast("int"), FEATURES).mapInArrow(_packed, "y binary, x binary").write.parquet(path)
        return fit(_over(spark.read.schema("y binary, x binary").parquet(path)))
    finally:
        remove(spark, path)


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score_quality(docs: DataFrame, model: Ranking | None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with score (0 to 1) and predicted (1 from CUT on).

    Null text: as empty; empty texts are scored by their features. Without a model (no labels of one kind) every
    score is 0.5. Equal texts have equal scores; repeated rows each by itself. Texts of any length are read whole. Empty
    tables: no rows. No shuffle; scores are computed a batch at a time.
    """
    made = FEATURES in docs.columns

    def batch(values: list) -> list[tuple]:
        if model is None or not values:
            return [(0.5, 0)] * len(values)
        x = np.frombuffer(b"".join(values)).reshape(len(values), -1) if made else np.array([features(t) for t in values])
        return [(v, int(v >= CUT)) for v in model.score(x).tolist()]

    return with_computed(docs, [FEATURES if made else "text"], keep, SCORED, lambda: batch, by_batch=True)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    # Texts are read once: their features are learned from and then scored.
    made = cut(featured(docs, ("doc_id", "held_out")))
    model = fit_quality(made, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(made, model, ("doc_id", "held_out"))
