"""Letters mapped by tables of bytes over whole batches of strings, where Catalyst would look up each letter by itself."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of texts that are worked on at once; arrays of numbers about them take many times as much.
SLICE = 1 << 22


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bytes, offsets into them, and which texts are null."""
    plain = pa.concat_arrays([texts.cast(pa.string())])
    offsets = np.frombuffer(plain.buffers()[1], dtype=np.int32)[plain.offset : plain.offset + len(plain) + 1]
    data = plain.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0], plain.is_null()


def _texts(data: np.ndarray, offsets: np.ndarray, null: pa.Array) -> pa.Array:
    out = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.compute.if_else(null, pa.scalar(None, pa.string()), out) if null.true_count else out


def _in_slices(run: Callable[..., pa.Array], texts: pa.Array, *more: pa.Array) -> pa.Array:
    """run over some texts after others, SLICE bytes and one text more; more: further columns of the same rows."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1).tolist(), len(texts)]
    return pa.concat_arrays([run(*(x.slice(a, b - a) for x in (texts, *more))) for a, b in zip(edges, edges[1:])])


def _table(letters: str, by: str, other: str | None = None) -> np.ndarray:
    """The byte for each byte: that of by for a letter's, and other, or the byte itself, for all the rest."""
    table = np.arange(256, dtype=np.uint8) if other is None else np.full(256, ord(other), dtype=np.uint8)
    table[np.frombuffer(letters.encode("ascii"), dtype=np.uint8)] = np.frombuffer(by.encode("ascii"), dtype=np.uint8)
    return table


def _mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    data, offsets, null = _parts(texts)
    # A character is its first byte; those that follow it within UTF-8 go.
    first = (data & 0xC0) != 0x80
    if not first.all():
        offsets = np.concatenate([[0], np.cumsum(first)])[offsets]
        data = data[first]
    return _texts(table[data], offsets, null)


def _reversed(texts: pa.Array, table: np.ndarray) -> pa.Array:
    data, offsets, null = _parts(texts)
    # Read from the end, the last text comes first.
    turned = _texts(table[data[::-1]], offsets[-1] - offsets[::-1], pa.array(np.zeros(len(null), dtype=bool)))
    turned = turned.take(pa.array(np.arange(len(null))[::-1]))
    return pa.compute.if_else(null, pa.scalar(None, pa.string()), turned)


def mapped(text: Column, letters: str, by: str, other: str) -> Column:
    """text with each of the letters (ASCII) replaced by the one at its place in by, and every other character by other."""
    table = _table(letters, by, other)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return _in_slices(lambda own: _mapped(own, table), texts)

    return run(text)


def reversed_by(text: Column, letters: str, by: str) -> Column:
    """ASCII text from its end to its start, each of the letters replaced by the one at its place in by."""
    table = _table(letters, by)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return _in_slices(lambda own: _reversed(own, table), texts)

    return run(text)


def mapped_or_reversed(text: Column, back: Column, letters: str, by: str, other: str, symbols: str, opposite: str) -> Column:
    """mapped(), and reversed_by() of it where back (never null) holds: a batch of texts goes to Python and comes back once."""
    forth, turn = _table(letters, by, other), _table(symbols, opposite)

    def part(texts: pa.Array, back: pa.Array) -> pa.Array:
        plain = _mapped(texts, forth)
        return pa.compute.replace_with_mask(plain, back, _reversed(plain.filter(back), turn))

    @F.arrow_udf("string")
    def run(texts: pa.Array, back: pa.Array) -> pa.Array:
        return _in_slices(part, texts, back)

    return run(text, back)


def longest_stretch(text: Column, letters: str, without: str) -> Column:
    """Length of the longest stretch without a given letter; -1 if a text has any character but the letters. A null stays null."""
    known = np.zeros(256, dtype=bool)
    known[np.frombuffer(letters.encode("ascii"), dtype=np.uint8)] = True

    def part(texts: pa.Array) -> pa.Array:
        data, offsets, null = _parts(texts)
        out = np.zeros(len(null), dtype=np.int32)
        # Stretches lie between places of the letter and edges of texts.
        stops = np.flatnonzero(data == ord(without))
        edges = np.sort(np.concatenate([stops, stops + 1, offsets[:-1], offsets[1:]]))
        begin, size = edges[:-1], np.diff(edges)
        real = size > 0
        begin, size = begin[real], size[real]
        clear = data[begin] != ord(without)
        np.maximum.at(out, np.searchsorted(offsets, begin[clear], side="right") - 1, size[clear].astype(np.int32))
        odd = np.flatnonzero(~known[data])
        out[np.searchsorted(offsets, odd, side="right") - 1] = -1
        return pa.array(out, mask=null.to_numpy(zero_copy_only=False))

    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        return _in_slices(part, texts)

    return run(text)
