"""Families that fit in one task: rows of whole families as they stream by, and numpy arrays of all that have the same size.

A family costs no call of its own: recurrences run over the anchors of one size, for all families of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of anchors, or chains, that are held as arrays at a time.
CELLS = 1 << 20


class Same:
    """Families of one size: family (f), row and length (f, n), pos (f, n, d), known (f, n): no position is null, short (f, n): the length is."""

    def __init__(self, table: pa.Table, at: np.ndarray, values: np.ndarray, whole: np.ndarray, places: np.ndarray):
        pick = lambda c: pc.fill_null(table.column(c), 0).to_numpy()[at]
        self.family = table.column("family_id").take(pa.array(at[:, 0])).combine_chunks()
        self.row, self.length, self.pos = pick("row_id"), pick("len"), values[places]
        self.known = whole[places].all(axis=2) & self.family.is_valid().to_numpy(zero_copy_only=False)[:, None]
        self.short = table.column("len").is_null().to_numpy()[at]

    def before(self, k: int, use_length: bool = True) -> np.ndarray:
        """(f, k): which of the first k anchors precede the one at k in all sequences."""
        end = self.pos[:, :k] + (self.length[:, :k, None] if use_length else 0)
        return (end < self.pos[:, k, None]).all(axis=2) & self.known[:, :k] & self.known[:, k, None]


def same_sizes(table: pa.Table, most: Callable[[int], int]) -> Iterator[Same]:
    """The families of a table in arrays; of those with n anchors at most most(n) together. pos arrays of a family are equally long."""
    start = np.flatnonzero(table.column("turn").to_numpy() == 1)
    sizes = np.diff(np.append(start, table.num_rows))
    dims = pc.fill_null(pc.list_value_length(table.column("pos")), 0).to_numpy().astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(dims)])
    flat = pc.list_flatten(table.column("pos"))
    values, whole = pc.fill_null(flat, 0).to_numpy(), flat.is_valid().to_numpy()
    for n, d in np.unique(np.stack([sizes, dims[start]]), axis=1).T.tolist():
        which = start[(sizes == n) & (dims[start] == d)]
        for k in range(0, len(which), most(n)):
            at = which[k : k + most(n), None] + np.arange(n)
            yield Same(table, at, values, whole, offsets[at][..., None] + np.arange(d))


def by_family(anchors: DataFrame, each: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """each, over tables of whole families; a family's rows are in the order of first position and row_id, numbered by turn."""
    kept = anchors.select("family_id", F.col("row_id").cast("long").alias("row_id"), F.col("len").cast("long").alias("len"), F.col("pos").cast("array<bigint>").alias("pos"))
    turned = kept.withColumn("turn", F.row_number().over(Window.partitionBy("family_id").orderBy(F.get("pos", F.lit(0)), "row_id")))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last family of a batch may go on in the next one.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            first = np.flatnonzero(batch.column("turn").to_numpy() == 1)
            if len(first):
                held.append(batch.slice(0, first[-1]))
                table = pa.Table.from_batches(held).combine_chunks()
                if table.num_rows:
                    yield from each(table)
                held = []
            held.append(batch.slice(first[-1] if len(first) else 0))
        if held:
            yield from each(pa.Table.from_batches(held).combine_chunks())

    return turned.mapInArrow(stream, schema)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow list for each entry of sizes, of so many of the values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def direct(own: Same, use_length: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order (f, n, n), and the edges of it that skip no anchor in between."""
    n = own.row.shape[1]
    order = np.zeros((len(own.row), n, n), dtype=bool)
    for k in range(1, n):
        order[:, :k, k] = own.before(k, use_length)
    paths = order.astype(np.float32)
    return order, order & (np.matmul(paths, paths) == 0)


def chain_counts(own: Same, use_length: bool) -> pa.RecordBatch:
    """family_id, n_chains and longest of the chains that nothing extends."""
    order, edge = direct(own, use_length)
    n = (~order.any(axis=1)).astype(np.int64)
    for k in range(1, n.shape[1]):
        n[:, k] += np.where(edge[:, :k, k], n[:, :k], 0).sum(axis=1)
    last = ~order.any(axis=2)
    return pa.RecordBatch.from_arrays([own.family, pa.array((n * last).sum(axis=1)), pa.array(longest(edge))], names=["family_id", "n_chains", "longest"])


def longest(edge: np.ndarray) -> np.ndarray:
    """The anchors of each family's longest chain."""
    size = np.ones(edge.shape[:2], dtype=np.int32)
    for k in range(1, size.shape[1]):
        size[:, k] = np.where(edge[:, :k, k], size[:, :k] + 1, 1).max(axis=1)
    return size.max(axis=1)


def all_chains(own: Same, use_length: bool, only_longest: bool = False) -> Iterator[pa.RecordBatch]:
    """family_id, path, size and weight of the chains that nothing extends, by their size."""
    order, edge = direct(own, use_length)
    asked = longest(edge) if only_longest else None
    family, last = np.nonzero(~order.any(axis=1))
    path = last[:, None]
    while len(family):
        ends = ~order[family, path[:, -1]].any(axis=1)
        if asked is not None:
            ends &= asked[family] == path.shape[1]
        f, p = family[ends], path[ends]
        if len(f):
            rows, short = own.row[f[:, None], p], own.short[f[:, None], p].any(axis=1)
            size = np.full(len(f), p.shape[1], dtype=np.int32)
            weight = pa.array(own.length[f[:, None], p].sum(axis=1), mask=short)
            yield pa.RecordBatch.from_arrays([own.family.take(pa.array(f)), lists(rows.reshape(-1), size), pa.array(size), weight], names=["family_id", "path", "size", "weight"])
        grown, dst = np.nonzero(edge[family, path[:, -1]])
        family, path = family[grown], np.concatenate([path[grown], dst[:, None]], axis=1)
