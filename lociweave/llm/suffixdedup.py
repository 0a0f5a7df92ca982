"""Removal of long repeated strings by sparse, distributed prefix doubling.

Every 400-byte string of a text (length is a parameter) holds one anchor: the start of its least k-gram by hash. Equal
strings have their anchors at the same place, so only anchors whose k-gram occurs again need to be looked at, and
neighbouring strings with the same anchor form one segment. Segments that are equal as a whole collapse: their
strings repeat. The others are ranked by prefix doubling, in both directions from the anchor: position-rank pairs at
offsets of 25, 50, 100 and 200 bytes are grouped and named anew, until a context is unique or past the length. What
the ranks leave open, strings whose left and right contexts both occur elsewhere, is compared string by string.
Strings and segments count as equal if two 64-bit hashes are: that of the k-gram at their anchor, and that of the
whole; no bytes are compared after that.

Texts are UTF-8 bytes; null is empty. Matches never cross documents. Rows that repeat count as two documents, and
both are given; rows with a null doc_id take part like others; an empty table gives an empty result; columns beyond
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.bytetext import Rolling, bytes_of
from lociweave.llm.common import Scratch, mix64, slices

LENGTH, GRAM = 400, 32
#: Context lengths, in doubling steps: at the last one a context is past the length.
STEPS = (25, 50, 100, 200, 400)
TEXT_SLICE = 1 << 20
#: Starts of strings that are looked at together.
BLOCK = 1 << 18
NO = np.iinfo(np.uint64).max
#: Columns that tell a document's rows apart.
KEY = ["id", "mark"]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbouring values."""
    padded = np.full(-(-len(values) // width) * width, NO, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - width + 1], ahead[width - 1 : len(values)])


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, block: int = BLOCK, rolling: type[Rolling] = Rolling) -> tuple[np.ndarray, ...]:
    """Row, first string, number of strings, anchor's distance from the first string, anchor hash, content hash.

    Strings are looked at in blocks by where they start, so that a long text costs little more memory than its sums. A
    segment ends with its block; the two parts of one are segments with the same anchor, whose strings are compared.
    rolling: what hashes stretches of data.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashed, strings = rolling(data), len(data) - length + 1
    found = [_segments_from(hashed, offsets, low, min(low + block, strings), length, gram) for low in range(0, strings, block)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _segments_from(hashed: Rolling, offsets: np.ndarray, low: int, high: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The segments of the strings that start at low up to high."""
    at = np.arange(low, high + length - gram)
    grams = hashed(at, at + gram)
    least = sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Strings that would cross into the next document are none.
    rows = slice(np.searchsorted(offsets, low, side="right") - 1, np.searchsorted(offsets, high))
    opens, closes = offsets[:-1][rows], offsets[1:][rows]
    valid = at[: high - low] + length <= np.repeat(closes, np.minimum(closes, high) - np.maximum(opens, low))
    cut = np.append(True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]))
    cut[opens[(opens >= low) & (opens < high)] - low] = True
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(anchor)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    anchor, first = anchor[first], first + low
    content = hashed(first, first + count - 1 + length)
    content = mix64(content ^ mix64((anchor - first).astype(np.uint64) * np.uint64(1 << 32) + count.astype(np.uint64)))
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, first - offsets[row], count, anchor - first, grams[anchor - low], content


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_SLICE):
            row, first, count, ahead, anchor, content = segments_of(*bytes_of(batch.column("text")), length, gram)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), batch.column("mark").take(pa.array(row)), pa.array(first), pa.array(count.astype(np.int32)), pa.array(ahead.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                ["id", "mark", "first", "count", "ahead", "anchor", "content"],
            )

    return docs.mapInArrow(step, "id long, mark long, first long, count int, ahead int, anchor long, content long")


def representatives(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """For each asked segment its bytes, and hashes of the blocks between the doubling steps to either side of the anchor."""
    by_document = asked.groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "content", "times", "first", "count", "ahead")).alias("own"))
    joined = docs.join(by_document.hint("shuffle_hash"), KEY)
    edges = np.array([0, *STEPS])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_SLICE):
            data, offsets = bytes_of(batch.column("text"))
            hashed = Rolling(data)
            own = batch.column("own")
            rows = own.flatten()
            anchor, content, times, first, count, ahead = (rows.field(k) for k in range(6))
            start = np.repeat(offsets[:-1], np.asarray(own.value_lengths())) + np.asarray(first)
            size = np.asarray(count, dtype=np.int64) - 1 + length
            at = start + np.asarray(ahead)
            right, left = [], []
            for k in range(len(STEPS)):
                fits = at + edges[k + 1] <= start + size
                right.append(np.where(fits, hashed(np.where(fits, at + edges[k], 0), np.where(fits, at + edges[k + 1], 0)), 0))
                fits = at - edges[k + 1] >= start
                left.append(np.where(fits, hashed(np.where(fits, at - edges[k + 1], 0), np.where(fits, at - edges[k], 0)), 0))
            width = pa.array(np.arange(0, len(STEPS) * len(start) + 1, len(STEPS)), pa.int32())
            blocks = [pa.ListArray.from_arrays(width, pa.array(np.stack(x, axis=1).astype(np.uint64).view(np.int64).ravel())) for x in (right, left)]
            raw = data.tobytes()
            text = pa.array([raw[s : s + n] for s, n in zip(start, size, strict=True)], pa.binary())
            ids = pa.array(np.repeat(np.arange(batch.num_rows), np.asarray(own.value_lengths())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(ids), batch.column("mark").take(ids), anchor, content, times, first, count, ahead, *blocks, text],
                ["id", "mark", "anchor", "content", "times", "first", "count", "ahead", "right", "left", "bytes"],
            )

    schema = "id long, mark long, anchor long, content long, times long, first long, count int, ahead int, right array<long>, left array<long>, bytes binary"
    return joined.select("id", "mark", "own", "text").mapInArrow(step, schema)


def unique_from(segments_: DataFrame, scratch: Scratch) -> DataFrame:
    """Prefix doubling: anchor, content, and the context lengths from which either side is unique (null: it never is).

    A rank names a context of one step's length. Each round pairs it with what follows at that offset, groups equal
    pairs, and names them anew; contexts that are alone, or that end, leave.
    """
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("blocks")) for s in ("right", "left"))))
    alive = segments_.select("anchor", "content", sides.alias("s")).select("anchor", "content", "s.side", "s.blocks", F.lit(0).cast("long").alias("rank"))
    found, rounds = [], []
    for k, size in enumerate(STEPS):
        pairs = alive.where(F.col("blocks")[k] != 0).withColumn("rank", F.xxhash64("side", "rank", F.col("blocks")[k]))
        pairs = scratch.put(pairs, "ranks") if k else pairs
        # Written first, so that the join with a rank that very many share can be split.
        shared = scratch.put(pairs.groupBy("anchor", "rank").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
        ranked = scratch.put(pairs.join(shared.withColumn("again", F.lit(True)), ["anchor", "rank"], "left"), "ranked")
        scratch.drop(*([pairs, shared] if k else [shared]))
        rounds.append(ranked)
        found.append(ranked.where("again is null").select("anchor", "content", "side", F.lit(size).alias("size")))
        alive = ranked.where("again").drop("again")
    limits = found[0]
    for more in found[1:]:
        limits = limits.unionByName(more)
    one = lambda side: F.min(F.when(F.col("side") == side, F.col("size"))).alias(f"{side}_unique")
    limits = scratch.put(limits.groupBy("anchor", "content").agg(one("right"), one("left")), "limits")
    scratch.drop(*rounds)
    return limits


def open_strings(segments_: DataFrame, limits: DataFrame, length: int) -> DataFrame:
    """The strings that the ranks leave open: their segment, place in it, and hash."""
    joined = segments_.select("anchor", "content", "count", "ahead", "bytes").join(limits, ["anchor", "content"], "left")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", TEXT_SLICE):
            count, ahead = (np.asarray(batch.column(c), dtype=np.int64) for c in ("count", "ahead"))
            right, left = (np.asarray(batch.column(c).fill_null(1 << 30), dtype=np.int64) for c in ("right_unique", "left_unique"))
            # A string with the anchor o bytes in has o bytes to its left and length - o from it on; x = ahead - o.
            low = np.maximum(0, ahead - (left - 1))
            high = np.minimum(count - 1, ahead + (right - 1) - length)
            some = np.flatnonzero(high >= low)
            n = (high - low + 1)[some]
            x = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
            column = batch.column("bytes")
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
            at = np.repeat((offsets[:-1] - offsets[0])[some], n) + x
            owner = pa.array(np.repeat(some, n))
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(owner), batch.column("content").take(owner), pa.array(x.astype(np.int32)), pa.array(Rolling(data)(at, at + length).view(np.int64))], ["anchor", "content", "x", "string"])

    return joined.select("anchor", "content", "count", "ahead", "right_unique", "left_unique", "bytes").mapInArrow(step, "anchor long, content long, x int, string long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, mark and the spans (start, stop), not yet merged, that strings of length bytes that occur again cover.

    docs has the columns id, mark and text.
    """
    scratch = Scratch()
    all_ = scratch.put(segments(docs, length, gram), "segments")
    one = F.min(F.struct("id", "mark", "first", "count", "ahead")).alias("one")
    kinds = scratch.put(all_.groupBy("anchor", "content").agg(F.count("*").alias("times"), one).select("anchor", "content", "times", "one.*"), "kinds")
    mixed = scratch.put(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "mixed")
    asked = kinds.join(mixed, "anchor")
    chosen = scratch.put(representatives(docs, asked, length), "chosen")
    limits = unique_from(chosen, scratch)
    strings = scratch.put(open_strings(chosen, limits, length), "strings")
    scratch.drop(chosen, mixed)
    again = scratch.put(strings.groupBy("anchor", "string").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    places = strings.join(again, ["anchor", "string"], "left_semi").groupBy("anchor", "content").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"), F.sort_array(F.collect_list("x")).alias("xs"))
    spots = F.when(F.col("n") == F.col("high") - F.col("low") + 1, F.array(F.struct(F.col("low"), F.col("high")))).otherwise(F.transform("xs", lambda x: F.struct(x.alias("low"), x.alias("high"))))
    places = scratch.put(places.select("anchor", "content", spots.alias("spots")), "places")
    scratch.drop(limits, strings, again)
    alone = kinds.where("times = 1").select("anchor", "content", "id", "mark", "first")
    partly = alone.join(places, ["anchor", "content"]).select("id", "mark", "first", F.explode("spots").alias("s"))
    partly = partly.select("id", "mark", (F.col("first") + F.col("s.low")).alias("start"), (F.col("first") + F.col("s.high") + length).alias("stop"))
    wholly = all_.join(kinds.where("times > 1").select("anchor", "content"), ["anchor", "content"], "left_semi").select("id", "mark", F.col("first").alias("start"), (F.col("first") + F.col("count") - 1 + length).alias("stop"))
    out = scratch.put(wholly.unionByName(partly), "spans")
    scratch.drop_all_but(out)
    return out


def with_spans(docs: DataFrame, length: int, more: Callable[[DataFrame], DataFrame] | None = None, apart: bool = False) -> DataFrame:
    """docs (columns id, mark, text and others) with a column spans of sorted starts and stops, not yet merged.

    more gives further spans (id, mark, start, stop) from the columns id, mark and text; apart: those have a column more
    of their own.
    """
    texts = docs.select("id", "mark", "text")
    spans = repeated_spans(texts, length).withColumn("apart", F.lit(False))
    spans = spans.unionByName(more(texts).withColumn("apart", F.lit(apart))) if more else spans
    # A set: rows that are repeated as a whole bring the same spans once each.
    one = lambda own: F.sort_array(F.collect_set(F.when(own, F.struct("start", "stop"))))
    columns = [one(~F.col("apart")).alias("spans"), *([one(F.col("apart")).alias("more")] if apart else [])]
    by_document = spans.groupBy("id", "mark").agg(*columns)
    return docs.join(by_document.hint("shuffle_hash"), KEY, "left")


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that are sorted by start."""
    if not len(starts):
        return starts, stops
    far = np.maximum.accumulate(stops)
    new = np.append(True, starts[1:] > far[:-1])
    return starts[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)]


def _runs(spans: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and stops of the maximal runs of each row's spans."""
    none = np.zeros(0, dtype=np.int64)
    for own in spans:
        yield merged(*(np.asarray(own.values.field(k), dtype=np.int64) for k in (0, 1))) if own.is_valid else (none, none)


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int, int]]:
    """Kept bytes, all bytes, removed bytes and spans of each row."""
    for text, (starts, stops) in zip(batch.column("text"), _runs(batch.column("spans")), strict=True):
        raw = (text.as_py() or "").encode()
        parts, at = [], 0
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            parts.append(raw[at:a])
            at = b
        yield b"".join([*parts, raw[at:]]), len(raw), int((stops - starts).sum()), len(starts)


def _keyed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("mark"), *columns)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs.

    With more, as for with_spans, two columns follow: n_passages and n_passage_bytes, the maximal runs of those spans and
    their bytes. They are told, not removed: the other columns are the same as without.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_passages", "n_passage_bytes"] if more else [])]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_SLICE):
            rows = [(n, gone, spans, hashlib.sha256(kept).hexdigest()) for kept, n, gone, spans in _cut(batch)]
            told = [(len(starts), int((stops - starts).sum())) for starts, stops in _runs(batch.column("more"))] if more else [()] * len(rows)
            columns = zip(*(r + t for r, t in zip(rows, told, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names, columns, strict=True))], ["doc_id", *names])

    keyed = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = with_spans(keyed, length, more, apart=more is not None).select("doc_id", "spans", *(["more"] if more else []), "text")
    return out.mapInArrow(step, ", ".join(["doc_id long", *(f"{n} {'string' if n == 'kept_sha256' else 'long'}" for n in names)]))


def without_repeats(docs: DataFrame, length: int = LENGTH, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with the repeated bytes cut out of text; what a cut leaves of a split character goes too.

    Null texts stay null, a text that repeats as a whole becomes empty, repeated rows lose their texts alike; n_chars is
    set anew where docs has it, other columns stay as they are, whatever their names. more: as for with_spans.
    """
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]  # so that no column of docs clashes with those made on the way
    kinds = ", ".join(f"{i} {docs.schema[c].dataType.simpleString()}" for i, c in zip(inner, names, strict=True))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_SLICE):
            texts = [None if not t.is_valid else kept.decode("utf-8", "ignore") for t, (kept, *_) in zip(batch.column("text"), _cut(batch), strict=True)]
            columns = {c: batch.column(i) if c != "text" else pa.array(texts, pa.string()) for i, c in zip(inner, names, strict=True)}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], inner)

    rest = [F.col(f"`{c}`").alias(i) for i, c in zip(inner, names, strict=True) if c != "text"]
    out = with_spans(_keyed(docs, "text", *rest), length, more)
    out = out.select(*(F.col("text").alias(i) if c == "text" else F.col(i) for i, c in zip(inner, names, strict=True)), "text", "spans")
    return out.mapInArrow(step, kinds).toDF(*names)
