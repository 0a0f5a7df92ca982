"""Chroma fingerprints of recordings, and their alignment.

A recording's frames are folded onto twelve pitch classes. Sixteen rectangle filters, each the log ratio of two areas
summed in constant time from an integral image of the frames, are cut at three thresholds into two bits (Gray code);
together they are one 32-bit code for each frame. Recordings with the same codes collapse to one. Queries meet all
others in blocks of bounded size: each equal half of a code votes for an offset, the offset with most votes is where
a pair is aligned and compared bit by bit. Whole codes as votes found 0.41 of the noisy pairs up to the allowed error.

Null, empty and short recordings have no codes and match nothing; repeated rows each give a row and are copies of each
other; null ids take part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import materialize

RATE, FRAME, HOP = 4000, 1024, 400
SPAN = 16
THRESHOLDS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
#: Equal half codes at one offset that make a pair worth aligning; share of differing bits up to which it is a match.
LEAST_VOTES, MOST_ERROR = 2, 0.25
#: Codes that must stand against each other, or all of the shorter recording.
LEAST_OVERLAP = 16
#: Codes of a block of recordings and of a block of queries, about; votes counted and codes compared at once.
BLOCK_CODES, AT_ONCE = 1 << 18, 1 << 20


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen filters by rule: kind, first pitch class, height, width in frames."""
    return [(k % 4, (5 * k) % 9, 2 + k % 3 if k % 4 != 1 else 4, (4, 8, 12, 16)[k // 4]) for k in range(16)]


@lru_cache(maxsize=4)
def pitch_classes(rate: int, frame: int) -> np.ndarray:
    """A 0/1 matrix from spectrum bins to pitch classes, for tones from 100 Hz on."""
    f = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(f), 12))
    heard = np.flatnonzero(f >= 100)
    out[heard, np.round(12 * np.log2(f[heard] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Frames x 12, each frame of length one (silent frames are zero)."""
    if len(samples) < frame:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(frame), axis=1)) ** 2
    out = power @ pitch_classes(rate, frame)
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-9, out / np.maximum(size, 1e-9), 0)


def codes(frames: np.ndarray) -> np.ndarray:
    """A 32-bit code for each stretch of SPAN frames."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[at + t1, y1] - image[at + t0, y1] - image[at + t1, y0] + image[at + t0, y0]

    out = np.zeros(n, dtype=np.uint32)
    for k, (kind, y, height, width) in enumerate(filters()):
        y = min(y, 12 - height)
        half, middle = width // 2, y + height // 2
        if kind == 0:  # the whole rectangle against the rest of its classes
            a, b = area(0, width, y, y + height), area(0, SPAN, 0, 12) * (height * width / (12 * SPAN))
        elif kind == 1:  # lower against upper classes
            a, b = area(0, width, y, middle), area(0, width, middle, y + height)
        elif kind == 2:  # earlier against later frames
            a, b = area(0, half, y, y + height), area(half, width, y, y + height)
        else:  # one diagonal against the other
            a = area(0, half, y, middle) + area(half, width, middle, y + height)
            b = area(0, half, middle, y + height) + area(half, width, y, middle)
        value = np.log((1 + a) / (1 + b))
        out |= GRAY[np.searchsorted(THRESHOLDS, value)] << np.uint32(2 * k)
    return out


def fingerprints(recordings: DataFrame, rate: int = RATE) -> DataFrame:
    """id and codes of each row of recordings (id, samples: array of floats)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codes(chroma(np.asarray(s.values, dtype=np.float64), rate)) if s.is_valid else np.zeros(0, np.uint32) for s in batch.column("samples")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.astype(np.int64).tolist() for c in found], pa.list_(pa.int64()))], ["id", "codes"])

    return recordings.select("id", "samples").mapInArrow(step, "id long, codes array<long>")


def melody(values: np.ndarray, rate: int = RATE, hop: int = HOP) -> np.ndarray:
    """A recording of one tone for each value: the larger the value among the others' usual spread, the higher."""
    pitch = np.clip(np.round(12 + 6 * values / (np.abs(values).mean() + 1e-9)), 0, 24)
    tone = 220 * 2 ** (np.repeat(pitch, hop) / 12)
    return np.sin(np.cumsum(2 * np.pi * tone / rate))


def sung(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Recordings (id, codes) of a table of vectors, each sung as a melody; nothing is written in between."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for v in batch.column(column):
                values = np.nan_to_num(np.asarray(v.values.fill_null(0), dtype=np.float64)) if v.is_valid else np.zeros(0)
                found.append(codes(chroma(melody(values))) if len(values) else np.zeros(0, np.uint32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.astype(np.int64).tolist() for c in found], pa.list_(pa.int64()))], ["id", "codes"])

    return vectors.select(F.col(key).cast("long").alias("id"), column).mapInArrow(step, "id long, codes array<long>")


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a table, and where each row's begin (one more entry than rows)."""
    codes = table.column("codes").combine_chunks()
    starts = np.asarray(codes.offsets, dtype=np.int64)
    return np.asarray(codes.values)[starts[0] : starts[-1]].astype(np.uint32), starts - starts[0]


def _halves(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([codes & np.uint32(0xFFFF), (codes >> np.uint32(16)) | np.uint32(1 << 16)])


def meet(asked: pa.Table, rows: pa.Table, least_votes: int, most_error: float) -> pa.Table:
    """mark, query_id, offset, error of the rows (mark, codes) that match a query (mark, query_id, codes)."""
    x, x_start = _flat(asked)
    y, y_start = _flat(rows)
    x_size, y_size = np.diff(x_start), np.diff(y_start)
    numbers = {m: k for k, m in enumerate(asked.column("mark").to_pylist())}
    own = np.array([numbers.get(m, -1) for m in rows.column("mark").to_pylist()], dtype=np.int64)
    x_owner, y_owner = np.repeat(np.arange(len(x_size)), x_size), np.repeat(np.arange(len(y_size)), y_size)
    x_at, y_at = np.arange(len(x)) - x_start[x_owner], np.arange(len(y)) - y_start[y_owner]
    keys = _halves(x)
    order = np.argsort(keys, kind="stable")
    keys, spot = keys[order], order % max(len(x), 1)
    shift = int(x_size.max(initial=1))
    span = shift + int(y_size.max(initial=1)) + 1

    def settle(votes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        pair, offset = votes // span, votes % span - shift
        row, query = pair // len(x_size), pair % len(x_size)
        low, high = np.maximum(0, -offset), np.minimum(x_size[query], y_size[row] - offset)
        least = np.minimum(LEAST_OVERLAP, np.minimum(x_size[query], y_size[row]))
        keep = np.flatnonzero((counts >= least_votes) & (high - low >= least) & (query != own[row]))
        keep = keep[np.lexsort((-offset[keep], np.abs(offset[keep]), -counts[keep], pair[keep]))]
        keep = keep[np.append(True, pair[keep][1:] != pair[keep][:-1])] if len(keep) else keep
        out, length = [], (high - low)[keep]
        cuts = np.searchsorted(np.cumsum(length), np.arange(AT_ONCE, int(length.sum()) + AT_ONCE, AT_ONCE), side="right")
        for part in np.split(np.arange(len(keep)), np.unique(cuts)):
            if not len(part):
                continue
            k, n = keep[part], length[part]
            first = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(first, n)
            p = x[np.repeat(x_start[query[k]] + low[k], n) + step]
            q = y[np.repeat(y_start[row[k]] + low[k] + offset[k], n) + step]
            error = np.add.reduceat(np.bitwise_count(p ^ q).astype(np.int64), first) / (32.0 * n)
            fine = error <= most_error
            out.append((row[k][fine], query[k][fine], offset[k][fine], error[fine]))
        return out

    found = []
    left, left_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lows = [np.searchsorted(keys, h, side="left") for h in np.split(_halves(y), 2)]
    highs = [np.searchsorted(keys, h, side="right") for h in np.split(_halves(y), 2)]
    total = np.cumsum(sum(b - a for a, b in zip(lows, highs, strict=True)))
    start = 0
    while start < len(y):
        # As many codes as give AT_ONCE votes; a row that goes on keeps its votes for the next turn.
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + AT_ONCE, side="right")))
        votes = [left]
        for a, b in zip(lows, highs, strict=True):
            n = (b - a)[start:stop]
            at = np.repeat(np.arange(start, stop), n)
            s = spot[np.repeat(a[start:stop] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            votes.append((y_owner[at] * len(x_size) + x_owner[s]) * span + y_at[at] - x_at[s] + shift)
        fresh, inverse = np.unique(np.concatenate(votes), return_inverse=True)
        weight = np.concatenate([left_counts, np.ones(len(inverse) - len(left), np.int64)])
        counts = np.bincount(inverse, weights=weight, minlength=len(fresh)).astype(np.int64)
        ended = len(fresh) if stop == len(y) else int(np.searchsorted(fresh, int(y_owner[stop]) * len(x_size) * span))
        found += settle(fresh[:ended], counts[:ended])
        left, left_counts = fresh[ended:], counts[ended:]
        start = stop
    row, query, offset, error = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(4))
    return pa.table({"mark": rows.column("mark").take(pa.array(row.astype(np.int64))), "query_id": asked.column("query_id").take(pa.array(query.astype(np.int64))), "offset": pa.array(offset.astype(np.int64)), "error": pa.array(error.astype(np.float64))})


def _matches(classes: DataFrame, least_votes: int, most_error: float) -> DataFrame:
    """mark, query_id, offset, error of each match: every block of queries meets every block of recordings."""
    all_codes, ask_codes = classes.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0)), F.coalesce(F.sum(F.col("asked") * F.size("codes")), F.lit(0))).first()
    parts, blocks = 1 + all_codes // BLOCK_CODES, 1 + ask_codes // BLOCK_CODES
    bucket = lambda seed, n: F.pmod(F.xxhash64("mark", F.lit(seed)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = classes.select("mark", "codes", bucket(1, parts).alias("part"), each(blocks).alias("block"))
    asks = classes.where("asked = 1").select("mark", F.col("copy_of").alias("query_id"), "codes", each(parts).alias("part"), bucket(2, blocks).alias("block"))
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = [df.repartition(tasks, "part", "block").groupBy("part", "block") for df in (asks, rows)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(lambda q, r: meet(q, r, least_votes, most_error), "mark string, query_id long, offset long, error double")


def aligned(prints: DataFrame, every: int = 100, least_votes: int = LEAST_VOTES, most_error: float = MOST_ERROR) -> DataFrame:
    """id, n_codes, copy_of, n_matches, best_query, best_offset, best_error for each row of prints.

    Queries are the recordings whose id `every` divides, one for each class of equal codes. copy_of is the least id
    with the same codes; the other columns are those of the class, and leave out the class itself.
    """
    prints = materialize(prints.withColumn("mark", F.sha2(F.array_join("codes", ","), 256)), "prints")
    some = prints.where(F.size("codes") > 0)
    classes = some.groupBy("mark").agg(F.min("id").alias("copy_of"), F.max((F.coalesce("id", F.lit(1)) % every == 0).cast("int")).alias("asked"), F.first("codes").alias("codes"))
    classes = materialize(classes, "classes")
    scored = _matches(classes, least_votes, most_error)
    found = scored.groupBy("mark").agg(F.count("*").alias("n_matches"), F.min(F.struct("error", "query_id", "offset")).alias("m"))
    out = prints.join(classes.select("mark", "copy_of"), "mark", "left").join(found, "mark", "left")
    return out.select("id", F.size("codes").cast("long").alias("n_codes"), "copy_of", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.col("m.query_id").alias("best_query"), F.col("m.offset").cast("long").alias("best_offset"), F.col("m.error").alias("best_error"))
