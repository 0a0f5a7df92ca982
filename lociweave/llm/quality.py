"""Quality by positive-unlabelled learning with the non-negative unbiased risk estimator (after Kiryo et al., 2017).

Positives are rows marked good, the unlabelled set is all documents; rows marked bad are not used. A text gives bounded
surface features and hashed counts of its words and of its stretches of four bytes. The loss is the squared one, so that
the risk of a linear scorer, prior * risk(positives as good) + max(0, risk(unlabelled as bad) - prior * risk(positives
as bad)), is a function of the sums of features' products: these are taken over all rows by one aggregation, and nothing
is sampled. The unbiased risk has its least point in closed form; where its inner part is negative there, steps follow
that undo this. How far hashed counts are held back is chosen among HOLDS by the risk of each half of the documents
under the other's scorer. The class prior is estimated from scores that tell positives from unlabelled rows (best-bin
estimate, after Garg et al., 2021), counted over all rows: of all thresholds, the one with the least bound on the ratio
of the shares above it.

Null and empty texts have all features zero and get the score of that point; with no positives every score is 0.5.
Labels other than 0 and 1 are none; of several labels of a doc_id the largest holds. Repeated rows each give a row; an
empty table gives an empty result; columns beyond those named are ignored. Very long texts take memory in proportion to
their length in the task that reads them. Features are written once, 4 * WIDTH bytes a row at most, and texts read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.bytetext import Rolling, bytes_of, words_of
from lociweave.llm.common import fold, materialize, slices
from lociweave.llm.neardup import GAP

STEPS, RATE = 1500, 0.01
#: Ridge of surface features; those of hashed counts that are tried.
RIDGE, HOLDS = 1e-4, (1e-3, 1e-1, 1e1, 1e3)
#: Buckets of hashed words, and of hashed stretches of GRAM bytes; stretches hashed at once.
BUCKETS, GRAM, AT_ONCE = 64, 4, 1 << 20
#: Scores are counted in so many bins of equal width.
BINS = 1 << 12
TEXT_SLICE = 3 << 20


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


UPPER, LOWER, DIGIT, WIDE = _class((65, 90)), _class((97, 122)), _class((48, 57)), _class((128, 255))
#: Signs that prose ends words with, and other ASCII signs.
STOPS = _class((33, 33), (39, 39), (44, 46), (58, 59), (63, 63))
SIGNS = _class((33, 47), (58, 64), (91, 96), (123, 126)) & ~STOPS


def _hashed(owner: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Signed counts by row and bucket."""
    spread = hashes * np.uint64(0x9E3779B97F4A7C15)
    bucket = (spread >> np.uint64(32)).astype(np.int64) % BUCKETS
    sign = np.where((spread >> np.uint64(31)) & np.uint64(1), 1.0, -1.0)
    return np.bincount(owner * BUCKETS + bucket, weights=sign, minlength=rows * BUCKETS).reshape(rows, BUCKETS)


def features(column: pa.Array) -> np.ndarray:
    """A row of bounded features for each text: SURFACE of its look, then hashed words and stretches of bytes, each of length one at most."""
    data, offsets = bytes_of(column)
    rows = len(offsets) - 1
    starts, stops, counts = words_of(data, offsets, GAP)
    if not len(starts):
        return np.zeros((rows, WIDTH))
    owner = np.repeat(np.arange(rows), counts)
    total = lambda of: np.bincount(owner, weights=of, minlength=rows)
    inside = lambda table: np.append(0, np.cumsum(table[data]))
    upper, lower, sign, stop, digit, wide = ((s[stops] - s[starts]) for s in map(inside, (UPPER, LOWER, SIGNS, STOPS, DIGIT, WIDE)))
    size = stops - starts
    rolling = Rolling(data, fold_case=True)
    hashed = rolling(starts, stops)
    again = np.append(False, (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1]))
    order = np.lexsort((hashed, owner))
    fresh = np.append(True, (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
    distinct = np.bincount(owner[order][fresh], minlength=rows)
    letters = upper + lower + wide
    bare = letters == 0
    shout = (upper > 1) & (lower == 0)
    doubled = np.append(False, data[1:] == data[:-1]) & (SIGNS | STOPS)[data]
    double = np.append(0, np.cumsum(doubled))
    double = double[stops] - double[np.minimum(starts + 1, stops)] > 0
    ends = STOPS[data[stops - 1]]
    n = np.maximum(counts, 1)
    share = lambda of: total(of) / n
    base = [
        share(shout), share(sign > 0), share(bare), share(double), share(again), share(ends), share(digit > 0),
        share(size > 24), 1 - distinct / n, np.minimum(share(size) / 20, 1), share((stop > 1) | (sign > 1)),
    ]
    rough = [np.sqrt(np.clip(x, 0, 1)) for x in (base[0], base[1], base[2], base[3], base[4], base[6], base[8], base[10])]
    some = [(x > least).astype(float) for x, least in ((base[0], 0.02), (base[1], 0.02), (base[2], 0.02), (base[3], 0.02), (base[4], 0.02))]
    length = [np.log1p(counts) / 10, np.exp(-counts / 10.0)]
    words, stretches = _hashed(owner, hashed, rows), np.zeros((rows, BUCKETS))
    for a in range(0, len(data) - GRAM + 1, AT_ONCE):
        at = np.arange(a, min(a + AT_ONCE, len(data) - GRAM + 1))
        row = np.searchsorted(offsets, at, side="right") - 1
        within = at + GRAM <= offsets[row + 1]
        stretches += _hashed(row[within], rolling(at[within], at[within] + GRAM), rows)
    grams = [x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1) for x in (words, stretches)]
    out = np.concatenate([np.stack([*base, *rough, *some, *length], axis=1), *grams], axis=1)
    out[counts == 0] = 0
    return out


SURFACE = 11 + 8 + 5 + 2
WIDTH = SURFACE + 2 * BUCKETS


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(2 * z, -30, 30)))


def products(x: np.ndarray) -> np.ndarray:
    """Sums over rows of all products of two features, the first of which is always one: rows are counted at [0, 0]."""
    x = np.column_stack([np.ones(len(x)), x])
    return x.T @ x


def _means(sums: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Means of products of the scaled features."""
    to = np.diag(np.append(1, 1 / scale))
    to[1:, 0] = -mean / scale
    return to @ (sums / sums[0, 0]) @ to.T


def _risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """Risk of positives as good, weighted; and of the rest as bad, which may be estimated below zero."""
    at = lambda m, sign: (1 + 2 * sign * (m[0] @ w) + w @ m @ w) / 4
    return prior * at(p, -1), at(u, 1) - prior * at(p, 1)


def fit_products(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hold: float = RIDGE, steps: int = STEPS, rate: float = RATE) -> QualityModel:
    """The scorer of least non-negative risk from sums of products; hold: ridge of features beyond the surface ones."""
    n = unlabelled[0, 0]
    mean = unlabelled[0, 1:] / n
    scale = np.maximum(np.sqrt(np.maximum(np.diag(unlabelled)[1:] / n - mean**2, 0)), 1e-3)
    p, u = _means(positive, mean, scale), _means(unlabelled, mean, scale)
    ridge = np.where(np.arange(len(p)) > SURFACE, hold, RIDGE)
    ridge[0] = 0
    w = np.linalg.solve(u + np.diag(ridge + 1e-9), 2 * prior * p[0] - u[0])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        inner = _risk(w, p, u, prior)[1]
        if k == 1 and inner >= 0:
            break  # of least non-negative risk too, as that is nowhere below the unbiased one
        slope = (u[0] + u @ w) / 2 - prior * (p[0] + p @ w) / 2
        gradient = (prior * (p @ w - p[0]) / 2 + slope if inner >= 0 else -slope) + ridge * w / 2
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w = w - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return QualityModel(mean, scale, w)


def fit_nonnegative(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> QualityModel:
    """fit_products of rows of features."""
    return fit_products(products(positive), products(unlabelled), prior)


def chosen_hold(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> float:
    """Of HOLDS, that with the least risk of each half's sums under the scorer of the other half."""

    def risk(hold: float) -> float:
        found = 0.0
        for own, other in ((0, 1), (1, 0)):
            model = fit_products(positive[other], unlabelled[other], prior, hold)
            parts = _risk(model.weights, *(_means(x[own], model.mean, model.scale) for x in (positive, unlabelled)), prior)
            found += parts[0] + max(0.0, parts[1])
        return found

    return min(HOLDS, key=risk)


def prior_of_bins(positive: np.ndarray, unlabelled: np.ndarray, slack: float = 0.01, risk: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from both sides' counts by bins of the score."""
    sizes = positive.sum(), unlabelled.sum()
    above_p, above_u = (np.cumsum(x[::-1])[::-1] / n for x, n in zip((positive, unlabelled), sizes, strict=True))
    doubt = (1 + slack) * sum(np.sqrt(np.log(4 / risk) / (2 * n)) for n in sizes)
    some = np.flatnonzero(above_p > 0)
    best = some[np.argmin((above_u[some] + doubt) / above_p[some])]
    return float(above_u[best] / above_p[best])


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.minimum((scores * BINS).astype(np.int64), BINS - 1)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows; each half is compared by scores fit on the other, the mean counts."""
    halves = lambda x: (x[::2], x[1::2]) if len(x) > 1 else (x, x)
    p, u = halves(positive), halves(unlabelled)
    found = []
    for fit, held in ((0, 1), (1, 0)):
        model = fit_nonnegative(p[fit], u[fit], 0.5)
        found.append(prior_of_bins(*(np.bincount(_bins(model.scores(x[held])), minlength=BINS) for x in (p, u))))
    return float(np.clip(np.mean(found), 0.001, 0.999))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.float32).reshape(batch.num_rows, WIDTH).astype(np.float64)


def _summed(rows: DataFrame) -> list[np.ndarray]:
    """products() of the rows (half, x) of each half: summed within partitions first, then by row of the matrix."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, WIDTH + 1, WIDTH + 1))
        for batch in batches:
            x, half = _rows(batch), np.asarray(batch.column("half"))
            for k in (0, 1):
                sums[k] += products(x[half == k])
        half, i, j = np.nonzero(sums)
        upper = i <= j
        half, i, j = half[upper], i[upper], j[upper]
        yield pa.RecordBatch.from_arrays([pa.array((half * (WIDTH + 1) + i) * (WIDTH + 1) + j), pa.array(sums[half, i, j])], ["cell", "v"])

    found = rows.select("half", "x").mapInArrow(add, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()  # (WIDTH + 1) ** 2 rows at most
    sums = np.zeros(2 * (WIDTH + 1) ** 2)
    sums[np.asarray(found.column("cell"), dtype=np.int64)] = np.asarray(found.column("v"))
    sums = sums.reshape(2, WIDTH + 1, WIDTH + 1)
    return [m + np.triu(m, 1).T for m in sums]


def _counted(rows: DataFrame, models: list[QualityModel]) -> np.ndarray:
    """By half and bin, the rows (half, x) by their score under the other half's model."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * BINS, dtype=np.int64)
        for batch in batches:
            x, half = _rows(batch), np.asarray(batch.column("half"))
            for k in (0, 1):
                counts[k * BINS : (k + 1) * BINS] += np.bincount(_bins(models[1 - k].scores(x[half == k])), minlength=BINS)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell])], ["cell", "n"])

    found = rows.select("half", "x").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * BINS)
    counts[np.asarray(found.column("cell"), dtype=np.int64)] = np.asarray(found.column("n"))
    return counts.reshape(2, BINS)


def fit_quality(unlabelled: DataFrame, positive: DataFrame) -> QualityModel | None:
    """Both hold half and x, the features of a row; equal texts are in one half."""
    p, u = _summed(positive), _summed(unlabelled)
    if not sum(m[0, 0] for m in p):
        return None
    split = all(m[0, 0] for m in (*p, *u))
    all_p, all_u = sum(p), sum(u)
    if not split:  # one half alone: it is compared with itself
        p, u = [all_p, all_p], [all_u, all_u]
    hold = chosen_hold(p, u, 0.5)
    models = [fit_products(p[k], u[k], 0.5, hold) for k in (0, 1)]
    in_p, in_u = _counted(positive, models), _counted(unlabelled, models)
    found = [prior_of_bins(in_p[k], in_u[k]) for k in (0, 1)] if split else [prior_of_bins(in_p.sum(axis=0), in_u.sum(axis=0))]
    prior = float(np.clip(np.mean(found), 0.001, 0.999))
    return fit_products(all_p, all_u, prior, chosen_hold(p, u, prior))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; labels of held-out rows are not looked at."""
    out = fold("doc_id", folds) == held_out

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_SLICE):
            x = features(batch.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("half"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "held_out", "half", "x"])

    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").select("doc_id", out.alias("held_out"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), "text")
    rows = materialize(docs.mapInArrow(look, "doc_id long, held_out boolean, half int, x binary"), "features")
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    learned = rows.where(~F.col("held_out")).join(known.where("label = 1"), "doc_id", "left_semi")
    model = fit_quality(rows, learned)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5) if shared.value is None else shared.value.scores(_rows(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "x").mapInArrow(step, "doc_id long, held_out boolean, score double, predicted int")
