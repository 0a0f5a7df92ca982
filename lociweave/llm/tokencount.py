"""Token counts of piece-BPE vocabularies by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens where no vocabulary piece can cross. The distinct pre-tokens of a batch that the
worker has not seen lie in one flat symbol array; in each round every sequence applies its lowest-ranked pair, all
sequences at once, until no pair is left, and the surviving symbols are counted. Documents never shuffle.

Null texts count as empty (0 bytes, 0 tokens); repeated rows each give a row; columns beyond doc_id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lociweave.llm.common import slices, text_of

SPACE = "▁"
NONE = np.int64(1 << 40)
#: Entries of the worker's table of counted pre-tokens; it is emptied when full.
CACHE_ENTRIES = 700_000
#: Pre-tokens of more symbols are merged one by one with a heap.
LONG = 4096


class PieceCounter:
    """Counts the tokens that a piece-BPE model with byte fallback gives."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        self.unknown = size
        order = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        rank = {p: order[model.get_score(i)] for p, i in pieces.items()}
        keys, merged, ranks, unsafe = [], [], [], set()
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                for part in (left, right):
                    if rank.get(part, -1) >= rank[piece]:
                        unsafe.add(rank[part])
                if left in pieces and right in pieces:
                    keys.append((pieces[left] << 20) | pieces[right])
                    merged.append(i)
                    ranks.append(rank[piece])
        by_key = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.append(np.array(keys, dtype=np.int64)[by_key], NONE)
        self.merged = np.append(np.array(merged, dtype=np.int64)[by_key], -1)
        self.ranks = np.append(np.array(ranks, dtype=np.int64)[by_key], NONE)
        shared: dict[int, int] = {}
        for p in pieces:
            shared[rank[p]] = shared.get(rank[p], 0) + 1
        #: Ranks whose pairs must be applied one at a time: a merge may give a pair of a lower or the same rank.
        self.one_by_one = np.array(sorted(unsafe | {r for r, n in shared.items() if n > 1}), dtype=np.int64)
        self.symbol = np.full(0x110000, self.unknown, dtype=np.int64)
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        # Cuts are exact only where no piece goes on: before a space, and around a character that no piece holds.
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or any("\n" in p for p in pieces):
            raise ValueError("this vocabulary has pieces across word or line ends")
        self.cache: dict[str, int] = {}
        self.cut = re.compile(r"\n[^ \n]*| +[^ \n]*")

    def pre_tokens(self, text: str) -> list[str]:
        """Keys of the pre-tokens: the one leading space is left out; a key that starts with a line end has none."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " " or " \n" in text:
            return [x[1:] if x[0] == " " else x for x in self.cut.findall(" " + text)]
        keys = text.replace("\n", " \n").split(" ")
        return keys if keys[0] else ["", *keys[1:]]

    def texts(self, texts: list[str]) -> np.ndarray:
        cut = [self.pre_tokens(t) for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        fresh = set()
        for keys in cut:
            fresh.update(keys)
        fresh = [k for k in fresh if k not in self.cache]
        if fresh:
            self.cache.update(zip(fresh, self.keys_counted(fresh).tolist(), strict=True))
        get = self.cache.__getitem__
        return np.array([sum(map(get, keys)) for keys in cut], dtype=np.int64)

    def keys_counted(self, keys: list[str]) -> np.ndarray:
        whole = [k if k[:1] == "\n" else SPACE + k.replace(" ", SPACE) for k in keys]
        counts = np.zeros(len(whole), dtype=np.int64)
        short = np.array([len(w) <= LONG for w in whole])
        for i in np.flatnonzero(~short):
            counts[i] = self._by_heap(whole[i])
        if short.any():
            at = np.flatnonzero(short)
            counts[at] = self._by_arrays([whole[i] for i in at])
        return counts

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.symbol[points]
        # An unknown character becomes the bytes of its UTF-8 form.
        extra = np.where(symbols == self.unknown, (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000), 0)
        return symbols, extra

    def _pairs(self, symbols: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pair that starts at each symbol; none at the last of a sequence."""
        following = np.append(symbols[1:], self.unknown)
        key = (symbols << 20) | following
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & ~last
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def _by_arrays(self, words: list[str]) -> np.ndarray:
        symbols, extra = self._symbols("".join(words))
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        counts = np.add.reduceat(extra, np.cumsum(lengths) - lengths)
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            first = np.append(True, owner[1:] != owner[:-1])
            last = np.append(first[1:], True)
            rank, merged = self._pairs(symbols, last)
            starts = np.flatnonzero(first)
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            done = lowest == NONE
            counts[owner[starts[done]]] += sizes[done]
            if done.all():
                break
            at = (rank == np.repeat(lowest, sizes)) & (rank < NONE)
            # Of overlapping pairs every second one counts, from the left.
            hits = np.flatnonzero(at)
            run = np.append(True, (hits[1:] != hits[:-1] + 1) | (owner[hits[1:]] != owner[hits[:-1]]))
            in_run = np.arange(len(hits)) - np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
            keep = in_run % 2 == 0
            leading = np.append(True, owner[hits[1:]] != owner[hits[:-1]])
            keep &= leading | ~np.isin(rank[hits], self.one_by_one)
            hits = hits[keep]
            symbols[hits] = merged[hits]
            stay = np.repeat(~done, sizes)
            stay[hits + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return counts

    def _by_heap(self, word: str) -> int:
        """The same merges for one very long pre-token."""
        symbols, extra = self._symbols(word)
        n = len(symbols)
        rank, merged = self._pairs(symbols, np.arange(n) == n - 1)
        symbols = symbols.tolist()
        heap = [(int(rank[i]), i, symbols[i], symbols[i + 1], int(merged[i])) for i in np.flatnonzero(rank < NONE)]
        heapq.heapify(heap)
        after, before, left = [*range(1, n), -1], list(range(-1, n - 1)), n
        while heap:
            _, i, a, b, result = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j] = result, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            left -= 1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    key = (symbols[x] << 20) | symbols[y]
                    at = int(np.searchsorted(self.keys, key))
                    if self.keys[at] == key:
                        heapq.heappush(heap, (int(self.ranks[at]), x, symbols[x], symbols[y], int(self.merged[at])))
        return left + int(extra.sum())


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the count passes limit, for each row of docs."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = text_of(batch)
            tokens = counter(model_path).texts(texts)
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return docs.mapInArrow(step, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
