"""Fill-in-middle: texts cut at token boundaries into prefix, middle and suffix, by a learned index of the boundaries.

A text's tokens are its runs of A-Za-z and each other sign by itself. Boundary k is where token k starts, boundary n the
end of the text. All boundary offsets of a slice of texts are fitted by straight segments, each off by at most ERROR
bytes; a cut is predicted from its segment and then corrected by the residual stored for its rank, so that cuts are exact.

Null texts count as empty; empty texts, and texts that hold one of the marks, stay plain (prefix and middle are null).
A null doc_id draws its numbers as the empty string. Repeated rows each give a row; columns beyond doc_id and text are
ignored, of whatever name; an empty table gives none. A text is held in memory as a whole, with some 20 bytes for each
of its own, in a slice of its own if it is longer than 8 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.bytetext import bytes_of
from lociweave.llm.common import slices

#: Residuals take a byte.
ERROR = 127
#: The marks before each part.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges, one range behind the other, and where each range starts among them."""
    sizes = stops - starts
    at = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - at, sizes), at


class RankIndex:
    """Rising values of several groups by rank: straight segments within groups, and the residual of each rank."""

    def __init__(self, values: np.ndarray, firsts: np.ndarray, error: int = ERROR):
        """firsts: where each group starts in values; no group is empty."""
        self.residual = np.zeros(len(values), dtype=np.int8 if error <= ERROR else np.int64)
        low, high = firsts, np.append(firsts[1:], len(values)) - 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(low):
            rank, at = ranges(low, high + 1)
            miss = values[rank] - self._line(rank, *(np.repeat(x, high - low + 1) for x in (low, values[low], values[high] - values[low], np.maximum(high - low, 1))))
            fits = np.maximum.reduceat(np.abs(miss), at) <= error
            kept = np.repeat(fits, high - low + 1)
            self.residual[rank[kept]] = miss[kept]
            done.append((low[fits], high[fits]))
            low, high = low[~fits], high[~fits]
            middle = (low + high) // 2
            low, high = np.concatenate([low, middle + 1]), np.concatenate([middle, high])
        low, high = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(low)
        self.low, high = low[order], high[order]
        self.base, self.rise, self.run = values[self.low], values[high] - values[self.low], np.maximum(high - self.low, 1)

    @staticmethod
    def _line(rank: np.ndarray, low: np.ndarray, base: np.ndarray, rise: np.ndarray, run: np.ndarray) -> np.ndarray:
        return base + (rank - low) * rise // run

    def __call__(self, rank: np.ndarray) -> np.ndarray:
        """The exact values at ranks: predicted by a segment, corrected by the residual."""
        k = np.searchsorted(self.low, rank, side="right") - 1
        return self._line(rank, self.low[k], self.base[k], self.rise[k], self.run[k]) + self.residual[rank]


def _letters() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[65:91] = table[97:123] = True
    return table


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of all token boundaries, where each text's start among them, and which bytes start a sign."""
    lead, letter = (data & 0xC0) != 0x80, _letters()[data]
    start = lead.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(start)
    # A text's end has the offset of the next one's start, and stands before it.
    values = np.sort(np.concatenate([starts, offsets[1:]]), kind="stable")
    return values, np.searchsorted(starts, offsets[:-1]) + np.arange(len(offsets) - 1), lead


def fill_in_middle(docs: DataFrame, plain_from: int = 90, spm_below: int = 20, salt: str = "1:") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output for each row of docs.

    Four numbers come from the hash of salt and doc_id: two cuts, whether the text stays plain, and the order of parts.
    """
    seed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.substring(seed, 1, 32)).alias("seed"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for batch in slices(batches):
            data, offsets = bytes_of(batch.column("text"))
            values, firsts, lead = boundaries(data, offsets)
            n = np.diff(np.append(firsts, len(values))) - 1
            h = np.frombuffer(b"".join(batch.column("seed").to_pylist()), dtype=">u4").astype(np.int64).reshape(-1, 4)
            one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            index = RankIndex(values, firsts)
            a, b = index(firsts + np.minimum(one, two)), index(firsts + np.maximum(one, two))
            signs = np.concatenate([[0], np.cumsum(lead)])
            raw, form, out = data.tobytes(), [], []
            for k in range(len(n)):
                s, e = offsets[k], offsets[k + 1]
                text = raw[s:e]
                if not text or h[k, 2] % 100 >= plain_from or any(m in text for m in marks):
                    form.append("plain")
                    out.append(text)
                    continue
                prefix, middle, suffix = raw[s : a[k]], raw[a[k] : b[k]], raw[b[k] : e]
                form.append("spm" if h[k, 3] % 100 < spm_below else "psm")
                parts = (SUFFIX.encode(), suffix, PREFIX.encode(), prefix) if form[-1] == "spm" else (PREFIX.encode(), prefix, SUFFIX.encode(), suffix)
                out.append(b"".join((*parts, MIDDLE.encode(), middle)))
            plain = np.array([f == "plain" for f in form], dtype=bool)
            long = lambda x: pa.array(x.astype(np.int64), pa.int64(), mask=plain)
            columns = [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(form, pa.string()), long(signs[a] - signs[offsets[:-1]]), long(signs[b] - signs[a]), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(cut, OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks stand in no part, and none can arise where two parts meet: each mark starts with its only "<"."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(4)), F.try_element_at(parts, F.lit(3)))
    spm = F.concat(F.try_element_at(parts, F.lit(3)), F.try_element_at(parts, F.lit(4)), F.try_element_at(parts, F.lit(2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle with hashes of its output and of the text restored from that, in place of the output."""
    rows = fill_in_middle(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
