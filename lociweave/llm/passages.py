"""Passages of words that occur in several documents.

Words are what stands between white space (space and the controls from tab to carriage return); case counts, the white
space between words does not. A passage is a window of consecutive words; it is shared if it occurs in two rows or more.
Repeats within one row alone are none. Windows are found as strings are in suffixdedup: each has an anchor, its least
gram of half as many words; neighbours with the same anchor form a segment; segments that are equal as a whole and lie in
several rows are shared wholly. Where an anchor has several segments, their windows are compared one by one, at each
place where a segment that only one row holds stands in it. Windows
count as equal if the hashes of their words are, 64 bits each for the anchor and the window.

Null and empty texts, and texts of fewer words, have no windows. Rows that repeat count as two documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.bytetext import Rolling, RollingValues, bytes_of, words_of
from lociweave.llm.common import Scratch, mix64, slices
from lociweave.llm.neardup import GAP
from lociweave.llm.suffixdedup import segments_of

TEXT_SLICE = 1 << 20


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of rows, starts and stops of all words, word offsets of rows, hashes of words."""
    data, offsets = bytes_of(column)
    starts, stops, counts = words_of(data, offsets, GAP)
    return offsets, starts, stops, np.append(0, np.cumsum(counts)), Rolling(data)(starts, stops)


def _firsts(row: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """For each item the first of its row with these hashes."""
    key = mix64(row.astype(np.uint64) + np.uint64(1))
    for h in hashes:
        key = mix64(key ^ h)
    _, index, kind = np.unique(key, return_index=True, return_inverse=True)
    return index[kind]


def word_segments(docs: DataFrame, words: int) -> DataFrame:
    """The segments of all rows: first word, number of windows, bytes that they cover, anchor and content.

    fresh: the first such of its row; more: where the others of its row start, if there are any.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_SLICE):
            offsets, starts, stops, places, hashes = _words(batch.column("text"))
            row, first, count, _, anchor, content = segments_of(hashes, places, words, words // 2, rolling=RollingValues)
            at = places[:-1][row] + first
            start, stop = (starts[at], stops[at + count + words - 2]) if len(at) else (first, first)
            leader = _firsts(row, anchor, content)
            fresh = leader == np.arange(len(row))
            others = np.flatnonzero(~fresh)
            others = others[np.argsort(leader[others], kind="stable")]
            n = np.bincount(leader[others], minlength=len(row))
            more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32), mask=np.append(n == 0, False)), pa.array(first[others]))
            columns = [pa.array(first), pa.array(count.astype(np.int32)), pa.array(start - offsets[row]), pa.array(stop - offsets[row]), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(fresh), more]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("mark").take(pa.array(row)), *columns], ["id", "mark", "first", "count", "start", "stop", "anchor", "content", "fresh", "more"])

    return docs.mapInArrow(step, "id long, mark long, first long, count int, start long, stop long, anchor long, content long, fresh boolean, more array<long>")


def windows_of(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """The windows of the asked segments: place x in the segment that starts at first, hash, bytes, and how many rows they speak for."""
    by_document = asked.groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "times", "first", "count")).alias("own"))
    joined = docs.join(by_document.hint("shuffle_hash"), ["id", "mark"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_SLICE):
            offsets, starts, stops, places, hashes = _words(batch.column("text"))
            own = batch.column("own")
            fields = own.flatten()
            anchor, times, first, count = (np.asarray(fields.field(k)) for k in range(4))
            row = np.repeat(np.arange(batch.num_rows), np.asarray(own.value_lengths()))
            n = count.astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            x = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = (places[:-1][row] + first)[owner] + x
            row, anchor, times, first = row[owner], anchor[owner], times[owner], first[owner]
            string = RollingValues(hashes)(at, at + words)
            # Windows of a segment of several rows are shared; others count once a row.
            speaks = np.where(times > 1, times, _firsts(row, anchor.view(np.uint64), string) == np.arange(len(row)))
            ids = pa.array(row)
            columns = [anchor, times, first, x, string.view(np.int64), starts[at] - offsets[row], stops[at + words - 1] - offsets[row], speaks]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(ids), batch.column("mark").take(ids), *(pa.array(c.astype(np.int64)) for c in columns)], ["id", "mark", "anchor", "times", "first", "x", "string", "start", "stop", "speaks"])

    return joined.select("id", "mark", "own", "text").mapInArrow(step, "id long, mark long, anchor long, times long, first long, x long, string long, start long, stop long, speaks long")


def shared_spans(docs: DataFrame, words: int) -> DataFrame:
    """id, mark and the spans of bytes (start, stop), not yet merged, that windows of so many words that other rows hold too cover.

    docs has the columns id, mark and text.
    """
    scratch = Scratch()
    all_ = scratch.put(word_segments(docs, words), "word-segments")
    one = F.min(F.struct("id", "mark", "first", "count", "more")).alias("one")
    kinds = scratch.put(all_.where("fresh").groupBy("anchor", "content").agg(F.count("*").alias("times"), one).select("anchor", "content", "times", "one.*"), "word-kinds")
    # Written first, as in suffixdedup, so that the joins with what very many share can be split.
    mixed = scratch.put(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "word-mixed")
    # A segment of several rows is shared wherever it stands; one of a single row is asked for at each place.
    places = F.when(F.expr("times = 1 and more is not null"), F.concat(F.array("first"), "more")).otherwise(F.array("first"))
    asked = kinds.join(mixed, "anchor").select("id", "mark", "anchor", "times", "count", F.explode(places).alias("first"))
    windows = scratch.put(windows_of(docs, asked, words), "windows")
    scratch.drop(mixed)
    again = scratch.put(windows.groupBy("anchor", "string").agg(F.sum("speaks").alias("n")).where("n > 1").drop("n"), "windows-again")
    partly = windows.where("times = 1").join(again, ["anchor", "string"], "left_semi").groupBy("id", "mark", "first")
    partly = partly.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_list(F.struct("start", "stop")).alias("each"))
    partly = partly.select("id", "mark", F.explode(F.when(F.col("n") == F.col("high") - F.col("low") + 1, F.array(F.struct("start", "stop"))).otherwise(F.col("each"))).alias("s")).select("id", "mark", "s.*")
    # Merged, not broadcast after the shuffle: the many segments of a very common passage can be split then.
    wholly = all_.join(kinds.where("times > 1").select("anchor", "content").hint("merge"), ["anchor", "content"], "left_semi").select("id", "mark", "start", "stop")
    out = scratch.put(wholly.unionByName(partly), "word-spans")
    scratch.drop_all_but(out)
    return out
