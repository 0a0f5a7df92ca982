"""Chaining: the heaviest order-consistent chain of a family's anchors, and the order graph itself."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions.sequences import gap_inconsistency, precedes, spread
from lociweave.operators import blocks, families
from lociweave.operators.blocks import edges
from lociweave.operators.storage import released, settled

__all__ = ["all_chains", "best_chains", "chain_counts", "chain_large", "degrees", "edges", "heaviest_chain", "longest_chains", "scores"]

#: Families of more anchors are chained in blocks.
LARGE = 3000


def degrees(anchors: DataFrame, graph: DataFrame) -> DataFrame:
    out = graph.groupBy("family_id", F.col("src").alias("row_id")).agg(F.count("*").alias("out_degree"))
    into = graph.groupBy("family_id", F.col("dst").alias("row_id")).agg(F.count("*").alias("in_degree"))
    keys = ["family_id", "row_id"]
    return anchors.select(*keys).join(out, keys, "left").join(into, keys, "left").select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")))


def _gathered(anchors: DataFrame) -> DataFrame:
    """family_id and its anchors in topological order; every edge raises the first position."""
    one = F.struct(F.col("pos")[0].alias("first"), "row_id", "len", "pos")
    return anchors.groupBy("family_id").agg(F.sort_array(F.collect_list(one)).alias("rows"))


def _scored(rows: Column) -> Column:
    """rows with the best weight of a chain that ends at each."""
    empty = F.expr("cast(array() as array<struct<row_id:bigint,len:bigint,pos:array<bigint>,best:bigint>>)")

    def add(done: Column, x: Column) -> Column:
        ends = F.filter(done, lambda d: precedes(d["pos"], d["len"], x["pos"]))
        best = F.coalesce(F.array_max(F.transform(ends, lambda d: d["best"])), F.lit(0).cast("bigint"))
        one = F.struct(x["row_id"].cast("bigint").alias("row_id"), x["len"].cast("bigint").alias("len"), x["pos"].cast("array<bigint>").alias("pos"), (best + x["len"]).cast("bigint").alias("best"))
        return F.array_append(done, one)

    return F.aggregate(rows, empty, add)


def scores(anchors: DataFrame) -> DataFrame:
    """family_id and the weight of its heaviest chain."""
    return _gathered(anchors).select("family_id", F.array_max(F.transform(_scored(F.col("rows")), lambda x: x["best"])).alias("score"))


def heaviest_chain(anchors: DataFrame) -> DataFrame:
    """family_id, step, row_id, len, pos, score: the heaviest chain, its last anchor at step 1.

    Ties: the last anchor has the least spread, each one before it the least gap inconsistency; then the lowest row_id.
    """
    scored = _gathered(anchors).select("family_id", _scored(F.col("rows")).alias("rows"))
    scored = scored.select("family_id", "rows", F.array_max(F.transform("rows", lambda x: x["best"])).alias("score"))
    rows, top = F.col("rows"), F.col("score")
    choice = lambda x, cost: F.struct(cost.alias("cost"), x["row_id"].alias("row_id"), x["len"].alias("len"), x["pos"].alias("pos"), x["best"].alias("best"))
    start = F.array_min(F.transform(F.filter(rows, lambda x: x["best"] == top), lambda x: choice(x, spread(x["pos"]))))
    seed = F.struct(F.array(start).alias("path"), F.lit(True).alias("open"))

    def back(state: Column, _: Column) -> Column:
        at = F.element_at(state["path"], -1)
        before = F.filter(rows, lambda x: precedes(x["pos"], x["len"], at["pos"]) & (x["best"] == at["best"] - at["len"]))
        best = F.array_min(F.transform(before, lambda x: choice(x, gap_inconsistency(at["pos"], x["pos"]))))
        more = state["open"] & best.isNotNull()
        return F.struct(F.when(more, F.array_append(state["path"], best)).otherwise(state["path"]).alias("path"), more.alias("open"))

    path = F.aggregate(rows, seed, lambda s, x: F.when(s["open"], back(s, x)).otherwise(s), lambda s: s["path"])
    return scored.select("family_id", "score", F.posexplode(path).alias("step", "x")).select("family_id", (F.col("step") + 1).alias("step"), "x.row_id", "x.len", "x.pos", "score")


CHAIN = "family_id long, step int, row_id long, len long, pos array<long>, score long"


def chain_large(anchors: DataFrame) -> DataFrame:
    """The same chain by vectorised rows of the same recurrence, a family a task; families of one size are one array."""
    def least(among: np.ndarray, cost: np.ndarray, row: np.ndarray) -> np.ndarray:
        """For each family the place of the least cost, then the lowest row, of those among."""
        most = np.iinfo(np.int64).max
        cost = np.where(among, cost, most)
        among = among & (cost == cost.min(axis=1, keepdims=True))
        return np.where(among, row, most).argmin(axis=1)

    def uneven(x: np.ndarray) -> np.ndarray:
        pairs = [(i, j) for i in range(x.shape[2]) for j in range(i + 1, x.shape[2])]
        return sum(np.abs(x[..., i] - x[..., j]) for i, j in pairs) + np.zeros(x.shape[:2], dtype=np.int64)

    def chains(own: families.Same) -> pa.RecordBatch:
        n, each = own.row.shape[1], np.arange(len(own.row))
        best = own.length.copy()
        for k in range(1, n):
            best[:, k] += np.where(own.before(k), best[:, :k], 0).max(axis=1)
        score = best.max(axis=1)
        at = least(best == score[:, None], uneven(own.pos), own.row)
        steps = [(each, at)]
        while True:
            more = best[each, at] > own.length[each, at]
            each, at = each[more], at[more]
            if not len(each):
                break
            before = (own.pos[each] + own.length[each, :, None] < own.pos[each, at][:, None]).all(axis=2) & own.known[each]
            before &= best[each] == (best[each, at] - own.length[each, at])[:, None]
            at = least(before, uneven(own.pos[each, at][:, None] - own.pos[each]), own.row[each])
            steps.append((each, at))
        each, at = (np.concatenate(x) for x in zip(*steps))
        step = np.repeat(np.arange(1, len(steps) + 1, dtype=np.int32), [len(x[0]) for x in steps])
        pos = own.pos[each, at]
        columns = [own.family.take(pa.array(each)), pa.array(step), pa.array(own.row[each, at]), pa.array(own.length[each, at]), families.lists(pos.reshape(-1), np.full(len(pos), pos.shape[1])), pa.array(score[each])]
        return pa.RecordBatch.from_arrays(columns, names=["family_id", "step", "row_id", "len", "pos", "score"])

    return families.by_family(anchors, lambda table: map(chains, families.same_sizes(table, lambda n: max(1, families.CELLS // n))), CHAIN)


def best_chains(anchors: DataFrame, large: int = LARGE) -> DataFrame:
    """heaviest_chain for families of up to `large` anchors; those of more are chained block by block, with the same result."""
    sizes = anchors.groupBy("family_id").agg(F.count("*").alias("n"))
    wide = sizes.where(F.col("n") > large).select("family_id")
    small = heaviest_chain(anchors.join(wide, "family_id", "left_anti"))
    if wide.isEmpty():
        return small
    kind = [F.col(f.name).cast(f.dataType) for f in small.schema.fields]
    return small.unionByName(blocks.chain(anchors.join(wide, "family_id", "left_semi")).select(*kind))


def direct_edges(graph: DataFrame) -> DataFrame:
    """The edges that skip no anchor in between."""
    a = graph.select("family_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    b = graph.select("family_id", F.col("src").alias("b"), F.col("dst").alias("c"))
    skipping = a.join(b, ["family_id", "b"]).select("family_id", F.col("a").alias("src"), F.col("c").alias("dst")).distinct()
    return graph.join(skipping, ["family_id", "src", "dst"], "left_anti")


class Order:
    """A family's order graph for walks: its direct edges, the anchors that nothing precedes, and those that nothing follows."""

    def __init__(self, anchors: DataFrame, use_length: bool):
        self.graph = settled(edges(anchors, use_length))
        self.direct = settled(direct_edges(self.graph).select("family_id", "src", "dst", "weight"))
        rows = anchors.select("family_id", F.col("row_id").cast("long").alias("row_id"), F.col("len").cast("long").alias("len"))
        keys = ["family_id", "row_id"]
        self.first = settled(rows.join(self.graph.select("family_id", F.col("dst").alias("row_id")).distinct(), keys, "left_anti"))
        self.last = settled(rows.select(*keys).join(self.graph.select("family_id", F.col("src").alias("row_id")).distinct(), keys, "left_anti"))

    def drop(self) -> None:
        released(self.graph, self.direct, self.first, self.last)


def _walk(order: Order, front: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of all rounds whose row_id nothing follows. front: family_id, row_id and what step keeps; a round for each anchor of the longest chain."""
    edge = order.direct.select("family_id", F.col("src").alias("row_id"), F.col("dst"), F.col("weight").alias("more"))

    rounds = []
    front = settled(front)
    while not front.isEmpty():
        rounds.append(front)
        front = settled(step(front.join(edge, ["family_id", "row_id"])))
    if not rounds:
        return front
    released(front)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    out = settled(out.join(order.last, ["family_id", "row_id"], "left_semi"))
    released(*rounds)
    return out


#: Families of at most so many anchors have at most 3 ** 8 chains that nothing extends, and are walked within a task.
FEW = 24


def _few(anchors: DataFrame, few: int) -> tuple[DataFrame, DataFrame | None]:
    """The anchors of families of at most `few`, and those of the others, if there are any."""
    sizes = anchors.groupBy("family_id").agg(F.count("*").alias("n"))
    wide = settled(sizes.where(F.col("n") > few).select("family_id"))
    if wide.isEmpty():
        released(wide)
        return anchors, None
    return anchors.join(wide, "family_id", "left_anti"), anchors.join(wide, "family_id", "left_semi")


def _together(n: int) -> int:
    """Families of n anchors whose order, and chains, are held together."""
    return max(1, families.CELLS // max(n * n, 3 ** -(-n // 3)))


def chain_counts(anchors: DataFrame, use_length: bool = False, few: int = FEW) -> DataFrame:
    """family_id, n_chains (decimal) and longest (anchors) of the chains that nothing extends, from counts: no chain is listed."""
    small, large = _few(anchors, few)
    count = lambda table: (families.chain_counts(own, use_length) for own in families.same_sizes(table, _together))
    out = families.by_family(small, count, "family_id long, n_chains long, longest int").withColumn("n_chains", F.col("n_chains").cast("decimal(38,0)"))
    return out if large is None else out.unionByName(walked_counts(large, use_length))


def walked_counts(anchors: DataFrame, use_length: bool = False, order: Order | None = None) -> DataFrame:
    """chain_counts by rounds over tables, for families of any size."""
    own = order or Order(anchors, use_length)
    whole = lambda c: c.cast("decimal(38,0)")
    front = own.first.select("family_id", "row_id", whole(F.lit(1)).alias("n"), F.lit(1).alias("size"))

    def step(rows: DataFrame) -> DataFrame:
        return rows.groupBy("family_id", F.col("dst").alias("row_id"), (F.col("size") + 1).alias("size")).agg(whole(F.sum("n")).alias("n"))

    ends = _walk(own, front, step)
    out = ends.groupBy("family_id").agg(whole(F.sum("n")).alias("n_chains"), F.max("size").alias("longest"))
    if order is None:
        own.drop()
    return out


#: Chains of one family that all_chains lists, at most.
MOST_CHAINS = 10_000_000


def all_chains(anchors: DataFrame, use_length: bool = False, most: int = MOST_CHAINS, few: int = FEW, only_longest: bool = False) -> DataFrame:
    """family_id, path (row_ids), size and weight of every chain that nothing extends, or of those with most anchors.

    Their number can be exponential, so it is counted first: a family with more than `most` is an error, not a cut list.
    Families of at most `few` anchors, whose chains are bounded, are walked within a task; in others chains are rows that
    grow by an anchor a round, so that a family's are spread over tasks.
    """
    if 3 ** -(-few // 3) > most:
        few = 0
    small, large = _few(anchors, few)
    walk = lambda table: (batch for own in families.same_sizes(table, _together) for batch in families.all_chains(own, use_length, only_longest))
    out = families.by_family(small, walk, "family_id long, path array<long>, size int, weight long")
    if large is None:
        return out
    rest = walked_chains(large, use_length, most)
    return out.unionByName(longest_chains(rest) if only_longest else rest)


def walked_chains(anchors: DataFrame, use_length: bool, most: int) -> DataFrame:
    """all_chains by rounds over tables, for families of any size."""
    order = Order(anchors, use_length)
    many = walked_counts(anchors, use_length, order).where(F.col("n_chains") > most).first()
    if many:
        order.drop()
        raise ValueError(f"family {many.family_id} has {many.n_chains} chains, more than {most}")
    front = order.first.select("family_id", "row_id", F.array("row_id").alias("path"), F.col("len").alias("weight"))

    def step(rows: DataFrame) -> DataFrame:
        return rows.select("family_id", F.col("dst").alias("row_id"), F.array_append("path", F.col("dst")).alias("path"), (F.col("weight") + F.col("more")).alias("weight"))

    out = _walk(order, front, step).select("family_id", "path", F.size("path").alias("size"), "weight")
    order.drop()
    return out


def longest_chains(chains: DataFrame) -> DataFrame:
    """The chains of each family with most anchors."""
    most = chains.groupBy("family_id").agg(F.max("size").alias("size"))
    return chains.join(most, ["family_id", "size"]).select(chains.columns)
