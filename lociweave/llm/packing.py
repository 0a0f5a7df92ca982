"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in random groups of documents.

A document's ids (and a closing id) are cut into pieces of the capacity; the rest of each document goes, with its
ids, to one of many groups by a hash of its id and text, of the input partition, and of how many rows with such a hash
that partition has had before, in batches of a sixteenth of a group: repeated rows are dealt over the groups like others.
Within a group, rests are packed first-fit decreasing; what stays free in the bins is then filled with cuts from the
emptiest bins, and the one bin that is left over is cut at powers of two, where sequences need no padding. Groups hold
about GROUP_DOCS documents at every input size, so no task grows with the input. Input partitions must come in the same
order when a task is run again, as those of a scan do.

A null text is an empty one: its only id is the closing id. Repeated rows are packed one by one, a null doc_id stays
null, an empty table gives an empty result, columns beyond doc_id and text are ignored. Ties in size are packed in
the order of doc_id, then text hash.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import mix64, slices, text_of

#: Documents of a group, about; free places of a bin below which no further document is cut to fill it.
GROUP_DOCS, LEAST_CUT = 4096, 8
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Longest run of white space for the fast encoder, whose pattern takes a place on a stack of 1,000,000 for each sign of it.
SAFE_RUN = 100_000
SPACES = re.compile(r"\s+")
#: All documents' sequence ids: the group's number times this, and a number within the group.
GROUP_IDS = 1 << 32


@lru_cache(maxsize=1)
def encoding(path: str, pattern: str):
    """The byte-level BPE at path (a file of ranks), which the table of the .json file matches id by id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def library(path: str):
    """The tokenizer of the .json file beside the file of ranks at path."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{path.removesuffix('.tiktoken')}.json")


def encode(text: str, path: str, pattern: str) -> list[int]:
    """Ids of a whole text; a special string inside it is its one id.

    What the fast encoder cannot take, however long, goes whole to the library that defines the ids.
    """
    if len(text) <= SAFE_RUN or all(m.end() - m.start() <= SAFE_RUN for m in SPACES.finditer(text)):
        enc = encoding(path, pattern)
        try:
            ids: list[int] = []
            for k, part in enumerate(text.split(SPECIAL)):
                ids += ([SPECIAL_ID] if k else []) + enc.encode_ordinary(part)
            return ids
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # its panics are no Exceptions
            pass
    return library(path).encode(text, add_special_tokens=False).ids


class Dealer:
    """Groups for rows by their hashes: rows that share one go to another group after every so many."""

    def __init__(self, partition: int, groups: int, together: int):
        self.partition, self.groups, self.together = np.uint64(partition), np.uint64(groups), together
        self.seen = np.zeros(1 << 20, dtype=np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bucket = (hashes % np.uint64(len(self.seen))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, first, count = np.unique(bucket[order], return_index=True, return_counts=True)
        before = np.empty(len(bucket), dtype=np.int64)
        before[order] = np.arange(len(bucket)) - np.repeat(first, count)
        turn = (self.seen[bucket] + before) // self.together
        self.seen[own] += count
        with np.errstate(over="ignore"):
            return (mix64(hashes + mix64(turn.astype(np.uint64) + (self.partition << np.uint64(32)))) % self.groups).astype(np.int64)


class Bins:
    """First-fit bins: a tournament tree whose inner nodes hold the largest capacity below them."""

    def __init__(self, count: int, capacity: int):
        self.leaves = 1 << max(0, count - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin that has size places free; they are taken."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        tree[k] -= size
        found = k - self.leaves
        while k > 1:
            k //= 2
            tree[k] = max(tree[2 * k], tree[2 * k + 1])
        return found


def pack(sizes: list[int], capacity: int, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) pieces for items of 1 to capacity places."""
    bins = Bins(len(sizes), capacity)
    filled: dict[int, list[tuple[int, int, int]]] = {}
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        filled.setdefault(bins.place(sizes[item]), []).append((item, 0, sizes[item]))
    free = lambda pieces: capacity - sum(n for _, _, n in pieces)
    order = sorted(filled.values(), key=free)
    low, high = 0, len(order) - 1
    while low < high:
        gap = free(order[low])
        if gap < least_cut:
            low += 1
            continue
        item, start, n = order[high].pop()
        taken = min(gap, n)
        if n > taken:
            order[high].append((item, start, n - taken))
        order[low].append((item, start + n - taken, taken))
        if not order[high]:
            order.pop()
            high -= 1
    if order and free(order[-1]) >= least_cut:
        order += at_powers(order.pop())
    return order


def at_powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same pieces as sequences whose lengths are powers of two."""
    left, out = list(reversed(pieces)), []
    total = sum(n for _, _, n in pieces)
    while total:
        room, own = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            item, start, n = left.pop()
            taken = min(room, n)
            own.append((item, start, taken))
            if n > taken:
                left.append((item, start + taken, n - taken))
            room -= taken
        out.append(own)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, closing_id: int = 0, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: its place in the document, its ids' crc32, and its place in a sequence."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    groups = max(1, -(-docs.count() // group_docs))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("hash"), "text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        deal = Dealer(TaskContext.get().partitionId(), groups, max(1, group_docs // 16))
        for batch in slices(batches, limit=4 << 20):
            full, rest, totals = [], [], []
            for text in text_of(batch):
                ids = np.array([*encode(text, path, pattern), closing_id], dtype="<u4")
                whole = len(ids) - len(ids) % capacity
                full.append([zlib.crc32(ids[k : k + capacity]) for k in range(0, whole, capacity)])
                rest.append(ids[whole:].astype("<u2").tobytes())
                totals.append(len(ids))
            hashes = batch.column("hash")
            yield pa.RecordBatch.from_arrays(
                [pa.array(deal(np.asarray(hashes).view(np.uint64))), batch.column("doc_id"), hashes, pa.array(totals, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.binary())],
                ["part", "doc_id", "hash", "total", "full", "rest"],
            )

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("hash", "ascending")])
        group, ids, totals, full, rest = (rows.column(c).to_pylist() for c in ("part", "doc_id", "total", "full", "rest"))
        out: list[tuple] = []
        sequence = group[0] * GROUP_IDS
        for doc, total, crcs in zip(ids, totals, full, strict=True):
            for k, crc in enumerate(crcs):
                out.append((doc, k * capacity, capacity, crc, total, sequence, 0))
                sequence += 1
        own = [i for i, x in enumerate(rest) if x]
        for pieces in pack([len(rest[i]) // 2 for i in own], capacity):
            offset = 0
            for item, start, n in pieces:
                i = own[item]
                crc = zlib.crc32(np.frombuffer(rest[i], dtype="<u2")[start : start + n].astype("<u4"))
                out.append((ids[i], totals[i] - len(rest[i]) // 2 + start, n, crc, totals[i], sequence, offset))
                offset += n
            sequence += 1
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    parts = docs.mapInArrow(tokens, "part long, doc_id long, hash long, total long, full array<long>, rest binary")
    return parts.groupBy("part").applyInArrow(place, PIECES)
