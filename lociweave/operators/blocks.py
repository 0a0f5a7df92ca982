"""Families of any number of anchors in blocks by first position: the order graph, and the heaviest chain across tasks.

An edge raises every position, so it never leads to a block that ends before. Each block has an index entry: for each
sequence the least end of its anchors, and their greatest position. A pair of blocks is looked at only if in all sequences
something in the later one may follow something in the earlier one; the entries of blocks are matched, not anchors.

Chains go through the blocks as a front. In a round, the front block of each family is finished within one task, and what
it is to each later block is handed on: the best chain that ends before, from a divide and conquer over one sequence
after the other, instead of a test of all pairs. Predecessors are kept with the weights, so that the chain itself is read
by pointers of doubling length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lociweave.functions.sequences import gap_inconsistency, precedes
from lociweave.operators.numbering import in_ranges
from lociweave.operators.storage import released, settled

#: Anchors in a block of the order graph, and blocks whose entries meet in one task.
BLOCK, TOGETHER = 256, 256
#: Anchors in a block of the front.
FRONT = 4096


def _by_block() -> WindowSpec:
    return Window.partitionBy("family_id").orderBy("block")


def blocks(anchors: DataFrame, size: int) -> DataFrame:
    """family_id, block (rising with the first position), and its anchors as an array of at most size."""
    kept = anchors.select("family_id", F.col("row_id").cast("long").alias("row_id"), F.col("len").cast("long").alias("len"), F.col("pos").cast("array<bigint>").alias("pos"), F.col("pos")[0].cast("long").alias("first"))
    placed = in_ranges(kept, ["family_id", "first", "row_id"])
    one = F.struct("first", "row_id", "len", "pos")
    return settled(placed.groupBy("family_id", F.expr(f"_serial div {size}").alias("block")).agg(F.sort_array(F.collect_list(one)).alias("rows")))


def _entries(of: DataFrame, use_length: bool) -> DataFrame:
    """family_id, block, and for each sequence low (the least end of an anchor) and high (the greatest position)."""
    dims = F.sequence(F.lit(0), F.size(F.col("rows")[0]["pos"]) - 1)
    end = lambda r, d: F.get(r["pos"], d) + (r["len"] if use_length else F.lit(0))
    low = F.transform(dims, lambda d: F.array_min(F.transform("rows", lambda r: end(r, d))))
    high = F.transform(dims, lambda d: F.array_max(F.transform("rows", lambda r: F.get(r["pos"], d))))
    return of.select("family_id", "block", low.alias("low"), high.alias("high"))


def block_pairs(of: DataFrame, use_length: bool) -> DataFrame:
    """family_id, a and b: the pairs of different blocks between which there may be edges.

    Entries meet by family and stretch of TOGETHER blocks, so that those of a large family meet in many tasks.
    """
    # Blocks are numbered anew, without gaps: a row each, in families that have several.
    turn = F.row_number().over(_by_block()) - 1
    entries = settled(_entries(of, use_length).withColumn("turn", turn))
    several = entries.where("turn > 0").groupBy("family_id").agg(F.max("turn").alias("last"))
    entries = entries.join(several, "family_id")
    stretch = F.expr(f"turn div {TOGETHER}")
    left = entries.select("family_id", F.col("block").alias("a"), "low", F.explode(F.sequence(stretch, F.expr(f"last div {TOGETHER}"))).alias("stretch"))
    right = entries.select("family_id", F.col("block").alias("b"), "high", stretch.alias("stretch"))
    may = F.forall(F.zip_with("low", "high", lambda x, y: x < y), lambda x: x)
    return left.join(right, ["family_id", "stretch"]).where((F.col("a") < F.col("b")) & may).select("family_id", "a", "b")


def edges(anchors: DataFrame, use_length: bool = True, gaps: bool = False, size: int = BLOCK) -> DataFrame:
    """family_id, src, dst, weight (length of dst) for each pair of anchors in strict order in all sequences; with gaps, gap too."""
    of = blocks(anchors, size)
    own = of.select("family_id", F.col("rows").alias("a"), F.col("rows").alias("b"))
    early = of.select("family_id", F.col("block").alias("a"), F.col("rows").alias("early"))
    late = of.select("family_id", F.col("block").alias("b"), F.col("rows").alias("late"))
    across = block_pairs(of, use_length).join(early, ["family_id", "a"]).join(late, ["family_id", "b"]).select("family_id", F.col("early").alias("a"), F.col("late").alias("b"))
    met = own.unionByName(across).select("family_id", F.explode("a").alias("a"), "b").select("family_id", "a", F.explode("b").alias("b"))
    length = F.col("a.len") if use_length else F.lit(0).cast("long")
    more = [gap_inconsistency(F.col("b.pos"), F.col("a.pos")).alias("gap")] if gaps else []
    kept = met.where((F.col("a.first") < F.col("b.first")) & precedes(F.col("a.pos"), length, F.col("b.pos")))
    return kept.select("family_id", F.col("a.row_id").alias("src"), F.col("b.row_id").alias("dst"), F.col("b.len").alias("weight"), *more)


def _uneven(x: np.ndarray) -> np.ndarray:
    """Sum of the distances of all pairs of columns, by row."""
    s = np.sort(x, axis=1)
    n = s.shape[1]
    return (s * (2 * np.arange(n) - n + 1)).sum(axis=1)


class Best:
    """For each anchor the best chain before it: weight, gap inconsistency and row_id of its last anchor."""

    def __init__(self, n: int):
        self.weight, self.gap, self.row = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)

    def offer(self, at: np.ndarray, weight: np.ndarray, gap: np.ndarray, row: np.ndarray) -> None:
        """Take a heavier chain, then a less uneven step, then the lower row_id; at holds no place twice."""
        now = (self.weight[at], self.gap[at], self.row[at])
        better = (weight > now[0]) | ((weight == now[0]) & (weight > 0) & ((gap < now[1]) | ((gap == now[1]) & (row < now[2]))))
        at = at[better]
        self.weight[at], self.gap[at], self.row[at] = weight[better], gap[better], row[better]


def heaviest_before(end: np.ndarray, best: np.ndarray, pos: np.ndarray, small: int = 32) -> np.ndarray:
    """For each row of pos the greatest best of those rows of end that are below it in all columns; 0 if there are none.

    Divide and conquer: split at the median of a column; low queries meet low sources, high ones high sources, and high
    queries meet low sources in the columns that are left. The last column is a running maximum over sorted ends.
    """
    out = np.zeros(len(pos), dtype=np.int64)

    def last(s: np.ndarray, q: np.ndarray, c: int) -> None:
        order = s[np.argsort(end[s, c], kind="stable")]
        top = np.maximum.accumulate(best[order])
        k = np.searchsorted(end[order, c], pos[q, c], side="left")
        some = k > 0
        out[q[some]] = np.maximum(out[q[some]], top[k[some] - 1])

    def meet(s: np.ndarray, q: np.ndarray, c: int) -> None:
        stack = [(s, q)]
        while stack:
            s, q = stack.pop()
            if not len(s) or not len(q):
                continue
            if c == end.shape[1] - 1:
                last(s, q, c)
                continue
            if min(len(s), len(q)) <= small:
                below = (end[s, None, c:] < pos[None, q, c:]).all(axis=2)
                out[q] = np.maximum(out[q], np.where(below, best[s, None], 0).max(axis=0))
                continue
            cut = np.median(end[s, c])
            low, high = end[s, c] <= cut, pos[q, c] > cut
            if low.all():
                meet(s, q[high], c + 1)
                # Sources that equal the cut are below none of the low queries; the others meet them again.
                under = end[s, c] < cut
                stack.append((s[under], q[~high]))
                continue
            meet(s[low], q[high], c + 1)
            stack += [(s[low], q[~high]), (s[~low], q[high])]

    meet(np.arange(len(end)), np.arange(len(pos)), 0)
    return out


def _take(best: Best, at: np.ndarray, sources: tuple[np.ndarray, ...], pos: np.ndarray) -> None:
    """Offer each of the rows at the best chains of sources (end, best, pos, row): the weight first, then who gives it."""
    end, weight, own, row = sources
    heavy = heaviest_before(end, weight, pos[at])
    open_ = (heavy > 0) & (heavy >= best.weight[at])
    by_weight = np.argsort(weight, kind="stable")
    sorted_ = weight[by_weight]
    for k in np.flatnonzero(open_):
        lo, hi = np.searchsorted(sorted_, [heavy[k], heavy[k] + 1])
        same = by_weight[lo:hi]
        same = same[(end[same] < pos[at[k]]).all(axis=1)]
        gap = _uneven(pos[at[k]] - own[same])
        first = np.lexsort((row[same], gap))[0]
        best.offer(at[k : k + 1], heavy[k : k + 1], gap[first : first + 1], row[same[first : first + 1]])


def within(pos: np.ndarray, length: np.ndarray, row: np.ndarray, best: Best, small: int = 64) -> None:
    """Finish a block whose rows are sorted by first position: halves in turn, the first handed to the second."""
    stack = [(0, len(pos), False)]
    while stack:
        a, b, handed = stack.pop()
        if b - a <= small:
            for k in range(a, b):
                before = a + np.flatnonzero((pos[a:k] + length[a:k, None] < pos[k]).all(axis=1))
                if len(before):
                    total = best.weight[before] + length[before]
                    top = before[total == total.max()]
                    gap = _uneven(pos[k] - pos[top])
                    first = np.lexsort((row[top], gap))[0]
                    best.offer(np.array([k]), total.max(keepdims=True), gap[first : first + 1], row[top[first : first + 1]])
            continue
        mid = (a + b) // 2
        if handed:
            s = np.arange(a, mid)
            _take(best, np.arange(mid, b), (pos[s] + length[s, None], best.weight[s] + length[s], pos[s], row[s]), pos)
            stack.append((mid, b, False))
        else:
            stack += [(a, b, True), (a, mid, False)]


STATE = "family_id long, block long, row_id long, len long, pos array<long>, weight long, gap long, before long"
_NAMES = ["family_id", "block", "row_id", "len", "pos", "weight", "gap", "before"]


def _arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
    row, length = (np.array(table.column(c), dtype=np.int64) for c in ("row_id", "len"))
    pos = np.array(table.column("pos").to_pylist(), dtype=np.int64)
    order = np.lexsort((row, pos[:, 0]))
    return order, row[order], length[order], pos[order]


def _best_of(table: pa.Table, order: np.ndarray) -> Best:
    best = Best(len(order))
    best.weight, best.gap, best.row = (np.array(table.column(c), dtype=np.int64)[order] for c in ("weight", "gap", "before"))
    return best


def _batch(table: pa.Table, order: np.ndarray, best: Best) -> pa.Table:
    kept = table.select(_NAMES[:5]).take(pa.array(order))
    return pa.table([*kept.columns, pa.array(best.weight), pa.array(best.gap), pa.array(best.row)], names=_NAMES)


def _finish(table: pa.Table) -> pa.Table:
    order, row, length, pos = _arrays(table)
    best = _best_of(table, order)
    within(pos, length, row, best)
    return _batch(table, order, best)


def _hand_on(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """left: the rows of a later block; right: those of the front block, finished."""
    order, row, length, pos = _arrays(left)
    best = _best_of(left, order)
    if right.num_rows:
        _, s_row, s_length, s_pos = _arrays(right)
        s_order = np.lexsort((np.array(right.column("row_id"), dtype=np.int64), np.array(right.column("pos").to_pylist(), dtype=np.int64)[:, 0]))
        weight = np.array(right.column("weight"), dtype=np.int64)[s_order] + s_length
        _take(best, np.arange(len(row)), (s_pos + s_length[:, None], weight, s_pos, s_row), pos)
    return _batch(left, order, best)


def weighed(anchors: DataFrame, size: int = FRONT) -> DataFrame:
    """family_id, row_id, len, pos, weight (of the best chain before), before (its last row_id, or -1) of each anchor.

    A round for each block of the family with most blocks. The rows of a block are one task's; those of a family never are.
    """
    of = blocks(anchors, size)
    pairs = settled(block_pairs(of, use_length=True))
    turns = settled(of.select("family_id", "block", (F.row_number().over(_by_block()) - 1).cast("long").alias("turn")))
    rounds = (turns.agg(F.max("turn")).first()[0] or 0) + 1
    flat = of.join(turns, ["family_id", "block"]).select("family_id", "turn", F.explode("rows").alias("r"))
    zero = F.lit(0).cast("long")
    state = settled(flat.select("family_id", F.col("turn").alias("block"), "r.row_id", "r.len", "r.pos", zero.alias("weight"), zero.alias("gap"), F.lit(-1).cast("long").alias("before")))
    a = turns.select("family_id", F.col("block").alias("a"), F.col("turn").alias("ta"))
    b = turns.select("family_id", F.col("block").alias("b"), F.col("turn").alias("tb"))
    pairs_by_turn = settled(pairs.join(a, ["family_id", "a"]).join(b, ["family_id", "b"]).select("family_id", "ta", "tb"))
    done = []
    for k in range(rounds):
        front = settled(state.where(F.col("block") == k).groupBy("family_id", "block").applyInArrow(_finish, STATE))
        done.append(front)
        later = state.where(F.col("block") > k)
        if k == rounds - 1:
            break
        reached = pairs_by_turn.where(F.col("ta") == k).select("family_id", F.col("tb").alias("block"))
        sources = front.drop("block").join(reached, "family_id").select(*_NAMES)
        met = later.join(reached, ["family_id", "block"], "left_semi").groupBy("family_id", "block").cogroup(sources.groupBy("family_id", "block")).applyInArrow(_hand_on, STATE)
        others = later.join(reached, ["family_id", "block"], "left_anti")
        following = settled(met.unionByName(others.select(*_NAMES)))
        released(state)
        state = following
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    result = settled(out.select("family_id", "row_id", "len", "pos", "weight", "before"))
    released(state, pairs, turns, pairs_by_turn, of, *done)
    return result


def traced(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """family_id, row_id, step: the chain that leads to each family's end (family_id, row_id), the end at step 1.

    Pointers are doubled until none leads anywhere; then the marked rows take the longest pointers first.
    """
    jump = settled(rows.where("before >= 0").select("family_id", F.col("row_id"), F.col("before").alias("to")))
    jumps = [jump]
    while True:
        again = jumps[-1].select("family_id", F.col("row_id").alias("to"), F.col("to").alias("far"))
        further = settled(jumps[-1].join(again, ["family_id", "to"]).select("family_id", "row_id", F.col("far").alias("to")))
        if further.isEmpty():
            released(further)
            break
        jumps.append(further)
    marked = ends.select("family_id", "row_id", F.lit(1).alias("step"))
    for k in range(len(jumps) - 1, -1, -1):
        moved = marked.join(jumps[k], ["family_id", "row_id"]).select("family_id", F.col("to").alias("row_id"), (F.col("step") + (1 << k)).alias("step"))
        marked = marked.unionByName(moved)
    out = settled(marked)
    released(*jumps)
    return out


def chain(anchors: DataFrame, size: int = FRONT) -> DataFrame:
    """family_id, step, row_id, len, pos, score: the heaviest chain of each family, in blocks. Ties as in chain.heaviest_chain."""
    from lociweave.functions.sequences import spread

    rows = weighed(anchors, size)
    total = F.col("weight") + F.col("len")
    # The heaviest, then the least spread, then the lowest row_id.
    top = rows.groupBy("family_id").agg(F.min(F.struct((-total).alias("w"), spread(F.col("pos")).alias("cost"), "row_id")).alias("x"))
    ends = settled(top.select("family_id", "x.row_id", (-F.col("x.w")).alias("score")))
    steps = traced(rows, ends)
    return steps.join(rows, ["family_id", "row_id"]).join(ends.select("family_id", "score"), "family_id").select("family_id", "step", "row_id", "len", "pos", "score")
