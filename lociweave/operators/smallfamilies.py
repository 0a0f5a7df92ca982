"""Right-maximal words and islands of families that are small enough for a task, many families in one array.

Spark deals families out and sorts their pieces; a task lays whole families side by side, up to BATCH symbols, and sorts
all their starts at once by windows of 21 symbols, three bits each. Only starts that share a whole window are sorted by
the next one, so that rounds are bounded by RUN. Words are the depths at which neighbours part; a word's occurrences, and
those of each of its extensions, are stretches of the sorted starts. Islands are found from the pairs of starts at which
they begin, and no other pairs are made. Larger families, longer stretches without an N, other symbols and repeated
(family_id, seq_idx) go the way of operators.repeats, by shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions import bytetables
from lociweave.operators.storage import settled

#: Symbols of a family, and of a stretch without an N, up to which a family is small; symbols of a batch of families.
FAMILY, RUN, BATCH = 1 << 20, 1 << 10, 1 << 18
#: Symbols of a piece, and rows that are given out at once.
PIECE, ROWS = 1 << 14, 1 << 17
WINDOW = 21
SYMBOLS = "ACGTN#$"
CODES = np.zeros(256, dtype=np.uint8)
CODES[np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)] = np.arange(1, len(SYMBOLS) + 1)
NO = SYMBOLS.index("N") + 1


def large_families(texts: DataFrame) -> DataFrame:
    """family_id of the families that are not small."""
    longest = bytetables.longest_stretch(F.col("bases"), SYMBOLS, "N")
    rows = texts.select("family_id", "seq_idx", F.length("bases").alias("n"), longest.alias("longest"))
    odd = (F.col("longest") < 0) | (F.col("longest") > RUN)
    sums = rows.groupBy("family_id").agg(F.sum("n").alias("n"), F.max(odd.cast("int")).alias("odd"), F.count(F.lit(1)).alias("rows"), F.count_distinct("seq_idx").alias("different"))
    return settled(sums.where(f"n > {FAMILY} or odd > 0 or rows <> different").select("family_id"))


def divided(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """texts of small families, and those of large ones; None if there are none."""
    large = large_families(texts).withColumnRenamed("family_id", "_large")
    if large.isEmpty():
        return texts, None
    same = F.col("family_id").eqNullSafe(F.col("_large"))
    return texts.join(large, same, "left_anti"), texts.join(large, same, "left_semi")


def _room(data: np.ndarray) -> np.ndarray:
    """Symbols from each place to the next N or end."""
    stops = np.flatnonzero((data == 0) | (data == NO))
    return np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(len(data))


def _agreed(differ: np.ndarray) -> np.ndarray:
    """How many symbols two windows share, from the bits in which they differ."""
    for n in (1, 2, 4, 8, 16, 32):
        differ = differ | (differ >> np.uint64(n))
    return WINDOW - (np.bitwise_count(differ).astype(np.int32) + 2) // 3


class Sorted:
    """The starts of k symbols without an N of a batch of families, in the order of what follows them, and the words at which they part."""

    def __init__(self, data: np.ndarray, family: np.ndarray, k: int) -> None:
        """data: codes, a 0 before, between and behind sequences; family: a number for each symbol, ascending."""
        self.data = data
        room, windows = _room(data), self._windows(data)
        at = np.flatnonzero(room >= k)
        self.at, self.lcp = self._ordered(at, room, windows, family)
        self.room = room[self.at]
        prev = data[self.at - 1]
        # How many of the starts before each place in the order have each symbol before them; a sequence's first start has a mark of its own.
        self.before = [np.concatenate([[0], np.cumsum(prev == c, dtype=np.int32)]) for c in range(len(SYMBOLS) + 1)]
        self._words(k)

    @staticmethod
    def _windows(data: np.ndarray) -> np.ndarray:
        """WINDOW = 16 + 4 + 1 symbols from each place on, the first in the highest bits."""
        ahead = lambda x, n: np.concatenate([x[n:], np.zeros(min(n, len(x)), dtype=x.dtype)])
        by = {1: data.astype(np.uint64)}
        for n in (1, 2, 4, 8):
            by[2 * n] = (by[n] << np.uint64(3 * n)) | ahead(by[n], n)
        return (by[16] << np.uint64(15)) | (ahead(by[4], 16) << np.uint64(3)) | ahead(by[1], 20)

    @staticmethod
    def _ordered(at: np.ndarray, room: np.ndarray, windows: np.ndarray, group: np.ndarray, enough: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The starts in order, and how many symbols each shares with the one before; an N that both have counts, an end does not.

        enough: symbols after which the order may be left open.
        """
        order, lcp = at.copy(), np.zeros(len(at), dtype=np.int32)
        places, groups, depth = np.arange(len(at)), group[at], 0
        while len(places) and (enough is None or depth < enough):
            own = order[places]
            left = room[own] - depth
            cut = np.maximum(WINDOW - 1 - left, 0).astype(np.uint64) * np.uint64(3)
            key = (windows[own + depth] >> cut) << cut
            by = np.lexsort((key, groups))
            own, key, left = own[by], key[by], left[by]
            order[places] = own
            same = groups[1:] == groups[:-1]
            differ = key[1:] ^ key[:-1]
            shared = _agreed(differ)
            # Equal windows end together: at an N, which counts, or at ends, which are no one else's.
            ended = (differ == 0) & (left[1:] < WINDOW)
            shared[ended] = left[1:][ended] + (((key[1:][ended] >> (np.uint64(3) * (WINDOW - 1 - left[1:][ended]).astype(np.uint64))) & np.uint64(7)) == NO)
            lcp[places[1:][same]] = depth + shared[same]
            # Starts that share a whole window go on, those of one window as a group.
            more = same & (differ == 0) & (left[1:] >= WINDOW)
            kept = np.concatenate([[False], more]) | np.concatenate([more, [False]])
            groups = np.cumsum(np.concatenate([[True], ~more]))[kept]
            places, depth = places[kept], depth + WINDOW
        return order, lcp

    def _words(self, k: int) -> None:
        """depth, first and last (places in the order), n (different symbols before) and most (of those, before one extension) of each word."""
        depths, firsts, lasts, mosts = [], [], [], []
        live = np.flatnonzero(self.lcp >= k)
        while len(live):
            own = self.lcp[live]
            depth = int(own.min())
            head = np.flatnonzero(np.diff(live, prepend=-2) != 1)
            tail = np.append(head[1:], len(live)) - 1
            parts = own == depth
            word = np.logical_or.reduceat(parts, head)
            first, last = live[head] - 1, live[tail]
            # An extension begins with a word's first start and wherever neighbours part at its depth.
            begin = np.concatenate([first[word], live[parts]])
            begin.sort()
            mine = np.searchsorted(begin, first[word])
            end = np.append(begin[1:], 0) - 1
            end[np.append(mine[1:], len(begin)) - 1] = last[word]
            depths.append(np.full(len(mine), depth, dtype=np.int32))
            firsts.append(first[word])
            lasts.append(last[word])
            mosts.append(np.maximum.reduceat(self._different(begin, end), mine))
            live = live[~parts]
        whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        depth, first, last, most = whole(depths), whole(firsts), whole(lasts), whole(mosts)
        clear = self.room[first] >= depth if len(first) else np.zeros(0, dtype=bool)
        self.depth, self.first, self.last, self.most = depth[clear], first[clear], last[clear], most[clear]
        self.n = self._different(self.first, self.last)

    def _different(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        counts = [c[last + 1] - c[first] for c in self.before]
        return counts[0] + sum((c > 0).astype(np.int32) for c in counts[1:])


LETTERS = np.frombuffer(("^" + SYMBOLS).encode(), dtype=np.uint8)


def _strings(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)])
    values = LETTERS[data[np.repeat(at - offsets[:-1], size) + np.arange(offsets[-1])]]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values))


def _marked(codes: np.ndarray, mark: str, seq: pa.Array) -> pa.Array:
    """Symbols as text; for a 0 the mark and the sequence's number."""
    plain = pa.array([mark, *SYMBOLS]).take(pa.array(codes))
    none = np.flatnonzero(codes == 0)
    if not len(none):
        return plain
    own = pa.array([f"{mark}{s}" for s in seq.take(pa.array(none)).to_pylist()], type=pa.string())
    return pc.replace_with_mask(plain, pa.array(codes == 0), own)


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole families, up to BATCH symbols and one family more, and which of their rows start a family."""
    held, symbols, last = [], 0, None
    for batch in rows:
        lead = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("piece")).to_numpy(zero_copy_only=False))])
        family = batch.column("family_id")
        starts = np.ones(batch.num_rows, dtype=bool)
        if batch.num_rows > 1:
            starts[1:] = pc.invert(pc.fill_null(pc.equal(family[1:], family[:-1]), False)).to_numpy(zero_copy_only=False)
        starts[0] = last is None or family[0].as_py() != last
        begin = 0
        for k in np.flatnonzero(starts):
            if symbols + lead[k] - lead[begin] >= BATCH:
                held.append((batch.slice(begin, k - begin), starts[begin:k]))
                yield pa.Table.from_batches([b for b, _ in held]), np.concatenate([s for _, s in held])
                held, symbols, begin = [], 0, int(k)
        held.append((batch.slice(begin), starts[begin:]))
        symbols += lead[-1] - lead[begin]
        last = family[batch.num_rows - 1].as_py()
    if held:
        yield pa.Table.from_batches([b for b, _ in held]), np.concatenate([s for _, s in held])


def _laid(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
    """Codes and a family's number for each symbol of a batch, the row of each symbol, where the sequence of each row begins, and the rows."""
    for table, starts in _batches(rows):
        text = table.column("piece").to_pylist()
        opens = table.column("c").to_numpy() == 0
        joined = "".join("\0" + x if o else x for x, o in zip(text, opens)) + "\0"
        data = CODES[np.frombuffer(joined.encode("ascii"), dtype=np.uint8)]
        sizes = np.array([len(x) for x in text]) + opens
        sizes[-1] += 1
        row = np.repeat(np.arange(len(text)), sizes)
        edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        begins = edges[np.maximum.accumulate(np.where(opens, np.arange(len(text)), 0))]
        yield data, np.cumsum(starts)[row], row, begins, table


def _families(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[Sorted, np.ndarray, np.ndarray, pa.Table]]:
    """Sorted batches, the row of each symbol, where the sequence of each row begins, and the rows."""
    for data, family, row, begins, table in _laid(rows):
        yield Sorted(data, family, k), row, begins, table


def _islands(data: np.ndarray, family: np.ndarray, begins: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Where islands begin in the earlier and in the later sequence, and their size; begins: where sequences begin, ascending."""
    room, windows = _room(data), Sorted._windows(data)
    at, lcp = Sorted._ordered(np.flatnonzero(room >= k), room, windows, family, k)
    kmer = np.cumsum(lcp < k)
    several = np.bincount(kmer)[kmer] > 1
    at, kmer = at[several], kmer[several]
    # Starts by K-mer, the symbol before them and their place: those of later sequences are the end of each stretch.
    symbols, width = len(SYMBOLS) + 1, len(data) + 1
    key = (kmer * symbols + data[at - 1]) * width + at
    key.sort()
    at, (kmer, prev) = key % width, np.divmod(key // width, symbols)
    later = np.append(begins[1:], len(data))[np.searchsorted(begins, at, side="right") - 1]
    owns, firsts, sizes = [], [], []
    for c in np.unique(prev).tolist():
        # A common symbol before two starts is part of their island; an N, and the edge of a sequence, is not.
        own = np.arange(len(at)) if c in (0, NO) else np.flatnonzero(prev != c)
        stretch = kmer[own] * symbols + c
        first = np.searchsorted(key, stretch * width + later[own])
        size = np.searchsorted(key, (stretch + 1) * width) - first
        some = size > 0
        owns.append(own[some])
        firsts.append(first[some])
        sizes.append(size[some])
    if not owns:
        return
    own, first, ends = np.concatenate(owns), np.concatenate(firsts), np.cumsum(np.concatenate(sizes))
    for lo in range(0, int(ends[-1]) if len(ends) else 0, ROWS):
        ordinal = np.arange(lo, min(lo + ROWS, int(ends[-1])))
        pair = np.searchsorted(ends, ordinal, side="right")
        a, b = at[own[pair]], at[first[pair] + ordinal - np.where(pair, ends[pair - 1], 0)]
        most, size, live, depth = np.minimum(room[a], room[b]), np.zeros(len(a), dtype=np.int64), np.arange(len(a)), 0
        while len(live):
            shared = _agreed(windows[a[live] + depth] ^ windows[b[live] + depth])
            size[live] += shared
            depth += WINDOW
            live = live[(shared == WINDOW) & (most[live] > depth)]
        yield a, b, np.minimum(size, most)


def _dealt(texts: DataFrame) -> DataFrame:
    """family_id, seq_idx, c and piece: families by partition, in order."""
    # Empty texts have no pieces. A filter on them would be pushed below the folding of letters, and fold all texts a second time.
    size = F.length("bases")
    pieces = F.when(size > PIECE, F.regexp_extract_all("bases", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).when(size > 0, F.array("bases"))
    rows = texts.select("family_id", "seq_idx", F.posexplode(pieces).alias("c", "piece"))
    return rows.repartition("family_id").sortWithinPartitions("family_id", "seq_idx", "c")


def words(texts: DataFrame, k: int) -> DataFrame:
    """family_id, kmer, word, len: the different right-maximal words."""
    dealt = _dealt(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, row, _, table in _families(batches, k):
            family = table.column("family_id").combine_chunks()
            for lo in range(0, len(found.first), ROWS):
                own = slice(lo, lo + ROWS)
                at, size = found.at[found.first[own]], found.depth[own]
                columns = [family.take(pa.array(row[at])), _strings(found.data, at, np.full(len(at), k)), _strings(found.data, at, size), pa.array(size, type=pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["family_id", "kmer", "word", "len"])

    return dealt.mapInArrow(run, f"family_id {dealt.schema['family_id'].dataType.simpleString()}, kmer string, word string, len int")


def occurrences(texts: DataFrame, k: int, kept: str = "all") -> DataFrame:
    """family_id, word, len, seq_idx, pos, prev, next: where the right-maximal words occur.

    kept: all; diverse, those with two different symbols before; or maximal, those of which no extension has as many.
    prev and next are there for all words only.
    """
    dealt = _dealt(texts.where("family_id is not null"))
    kind = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    names = ["family_id", "word", "len", "seq_idx", "pos"] + (["prev", "next"] if kept == "all" else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, row, begins, table in _families(batches, k):
            family, seq = table.column("family_id").combine_chunks(), table.column("seq_idx").combine_chunks()
            chosen = np.arange(len(found.n)) if kept == "all" else np.flatnonzero((found.n >= 2) & ((found.most < found.n) | (kept == "diverse")))
            first, depth = found.first[chosen], found.depth[chosen]
            ends = np.cumsum(found.last[chosen] - first + 1)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, ROWS):
                ordinal = np.arange(lo, min(lo + ROWS, int(ends[-1])))
                word = np.searchsorted(ends, ordinal, side="right")
                at = found.at[first[word] + ordinal - np.where(word, ends[word - 1], 0)]
                size = depth[word]
                pick = pa.array(row[at])
                own = seq.take(pick)
                columns = [family.take(pick), _strings(found.data, at, size), pa.array(size, type=pa.int32()), own, pa.array((at - begins[row[at]]).astype(np.int32))]
                if kept == "all":
                    columns += [_marked(found.data[at - 1], "^", own), _marked(found.data[at + size], "#", own)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.mapInArrow(run, f"family_id {kind['family_id']}, word string, len int, seq_idx {kind['seq_idx']}, pos int" + (", prev string, next string" if kept == "all" else ""))


def islands(texts: DataFrame, k: int) -> DataFrame:
    """family_id, seq_a, seq_b, pos_a, pos_b, len: stretches of at least k symbols without an N that two sequences share, as long as they go."""
    dealt = _dealt(texts.where("family_id is not null and seq_idx is not null"))
    kind = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    names = ["family_id", "seq_a", "seq_b", "pos_a", "pos_b", "len"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, number, row, begins, table in _laid(batches):
            family, seq = table.column("family_id").combine_chunks(), table.column("seq_idx").combine_chunks()
            for a, b, size in _islands(data, number, np.unique(begins), k):
                pick, other = pa.array(row[a]), pa.array(row[b])
                columns = [family.take(pick), seq.take(pick), seq.take(other), *(pa.array(x, type=pa.int64()) for x in (a - begins[row[a]], b - begins[row[b]], size))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.mapInArrow(run, f"family_id {kind['family_id']}, seq_a {kind['seq_idx']}, seq_b {kind['seq_idx']}, pos_a bigint, pos_b bigint, len bigint")
