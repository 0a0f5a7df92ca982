"""The trie of conversations' prefixes: counts per node from perfect-hash node tables, added up towards the root.

A path is a conversation's sequence of items; a node stands for one distinct sequence of first items, the root for none.
Nodes are known by two 64-bit digests: the exclusive or of their items' hashes, each taken with its depth. All rows of
a digest must agree in parent, item and depth, or the job fails: no two prefixes are ever counted as one.

1. Paths are cut into segments of `segment` items, so that a path of any length is spread over tasks. Digests within a
   segment start from those of the segments before.
2. Distinct digests are enumerated by one aggregation with partial sums, so copies of a conversation, or of a first turn,
   are counted where they lie. Each node belongs to its smallest member, whose path holds it and all nodes above.
3. Shards are batches of whole segments of such paths. In each, the distinct digests get the slots of a minimal perfect
   hash; the table keeps each slot's digest, and every look-up is compared with it. Counts are scattered into flat arrays
   by slot and added through the array of parent slots, deepest first. Paths of other members add nothing and are left out.
4. What the shards hold of a node is summed. Ends of conversations are listed in sorted blocks and hashed as a stream.

Null conv_ids are no conversation and are left out; null turns come first; ties of a turn are ordered by the digest of
role and text; null roles and texts are empty; repeated rows are turns of their own; other columns are ignored; an empty
table gives no node, a conversation without items ends at the root. A text of any length takes part as its digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.llm.common import Scratch, mix64

SEGMENT = 1024
#: Rows of one shard's arrays, and conversations of one line of ends.
SHARD_ROWS, END_ROWS = 200_000, 50_000
#: Fixed value: a conversation takes its opening from the one at the start of its group of so many.
GROUP, OPENING = 20, 3


class PerfectHash:
    """A minimal perfect hash of distinct keys (two uint64 arrays): level by level, keys that meet no other get a slot."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.first, self.second = np.empty_like(first), np.empty_like(second)
        left, base = np.arange(len(first)), 0
        while len(left):
            at = self._place(first[left], second[left], len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(at, minlength=2 * len(left) + 1) == 1
            ranks = np.cumsum(alone) - alone
            self.levels.append((alone, ranks, base))
            done = alone[at]
            slots = base + ranks[at[done]]
            self.first[slots], self.second[slots] = first[left[done]], second[left[done]]
            base += int(done.sum())
            left = left[~done]
            if len(self.levels) > 200:
                raise ValueError("keys of a perfect hash must be distinct")

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = mix64(first * np.uint64(2 * level + 1) + mix64(second + np.uint64(level)))
        return (mixed % np.uint64(size)).astype(np.int64)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 for keys that the table does not hold."""
        slots = np.full(len(first), -1, dtype=np.int64)
        left = np.arange(len(first))
        for level, (alone, ranks, base) in enumerate(self.levels):
            at = self._place(first[left], second[left], level, len(alone))
            hit = alone[at]
            slots[left[hit]] = base + ranks[at[hit]]
            left = left[~hit]
        known = slots >= 0
        known[known] = (self.first[slots[known]] == first[known]) & (self.second[slots[known]] == second[known])
        return np.where(known, slots, -1)


def item_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, m (digest of role and text) and w (words of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), item_digest(role, text).alias("m"), words.alias("w"))


def placed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, m, w, p (place of the turn, from 0) and n_base: how many of its first OPENING turns the group's first conversation has.

    Turns are sorted over range partitions, so a conversation may lie in many. Each partition numbers its own turns; what
    the partitions before hold of its first conversation and its first group is added after that, a row a partition.
    """
    spark = turns.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["conv_id", "turn", "m"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, seen, group, base_seen = None, 0, None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
            if not len(conv):
                continue
            starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            sizes = np.diff(np.append(starts, len(conv)))
            more = np.zeros(len(starts), dtype=np.int64)
            more[0] = seen if conv[0] == last else 0
            q = np.arange(len(conv)) - np.repeat(starts - more, sizes)
            base = conv - conv % GROUP
            groups = np.flatnonzero(np.append(True, base[1:] != base[:-1]))
            at_base = np.add.reduceat((conv == base).astype(np.int64), groups)
            at_base[0] += base_seen if base[0] == group else 0
            n_base = np.repeat(np.minimum(at_base, OPENING), np.diff(np.append(groups, len(conv))))
            last, seen, group, base_seen = conv[-1], int(q[-1]) + 1, base[-1], int(min(at_base[-1], OPENING))
            names = ["part", "conv_id", "m", "w", "q", "n_base"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, dtype=np.int32)), batch.column("conv_id"), batch.column("m"), batch.column("w"), pa.array(q), pa.array(n_base)], names=names)

    numbered = turns.repartitionByRange(tasks, *by).sortWithinPartitions(*by).mapInArrow(number, "part int, conv_id long, m binary, w long, q long, n_base long")
    rows = scratch.put(numbered, "turns")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", (F.col("q") + 1).alias("n"))).alias("last"), F.max(F.struct(base.alias("base"), "n_base")).alias("group"))
    # At most as many rows as there are partitions.
    carries, last, group = [], (None, 0), (None, 0)
    for r in ends.orderBy("part").collect():
        first_group = r.first - r.first % GROUP
        more = last[1] if r.first == last[0] else 0
        base_more = group[1] if first_group == group[0] else 0
        carries.append((r.part, r.first, more, base_more))
        n = r.last.n + (more if r.last.conv_id == r.first else 0)
        last = (r.last.conv_id, n)
        group = (r.group.base, min(OPENING, r.group.n_base + (base_more if r.group.base == first_group else 0)))
    carry = spark.createDataFrame(carries, "part int, first long, more long, base_more long")
    joined = rows.join(F.broadcast(carry), "part")
    p = F.col("q") + F.when(F.col("conv_id") == F.col("first"), F.col("more")).otherwise(0)
    own = F.col("first") - F.pmod("first", F.lit(GROUP))
    n_base = F.least(F.col("n_base") + F.when(base == own, F.col("base_more")).otherwise(0), F.lit(OPENING))
    return joined.select("conv_id", "m", "w", p.alias("p"), n_base.alias("n_base"))


def shared_openings(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Paths (conv_id, depth, m, w) of conversations that open with up to OPENING turns of their group's first one; and all conv_ids.

    Of conversation c, crc32 of its number modulo 4 says how many turns; its own turns behind those follow.
    """
    rows = scratch.put(placed(turns_of(conversations), scratch), "placed")
    opening = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (OPENING + 1)
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))
    own = rows.where(F.col("p") >= opening).select("conv_id", (F.col("p") - opening + F.least(opening, F.col("n_base")) + 1).alias("depth"), "m", "w")
    ids = rows.where("p = 0").select("conv_id", base.alias("base"), opening.alias("opening"))
    heads = rows.where((F.col("conv_id") == base) & (F.col("p") < OPENING)).select(F.col("conv_id").alias("base"), "p", "m", "w")
    opened = ids.join(heads, "base").where(F.col("p") < F.col("opening")).select("conv_id", (F.col("p") + 1).alias("depth"), "m", "w")
    return own.unionByName(opened), ids.select("conv_id")


def prefixes(paths: DataFrame, segment: int, scratch: Scratch) -> DataFrame:
    """conv_id, seg, depth, m, w, the digests d1 and d2 of the prefix, and those of its parent, p1 and p2."""
    x = lambda salt: F.xxhash64(F.lit(salt), "depth", "m")
    rows = paths.select("conv_id", F.floor((F.col("depth") - 1) / segment).alias("seg"), "depth", "m", "w", x(1).alias("x1"), x(2).alias("x2"))
    rows = scratch.put(rows.repartition("conv_id", "seg"), "segments")
    whole = rows.groupBy("conv_id", "seg").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each segment; only those of paths longer than one go on.
    carried = whole.select("conv_id", "seg", F.bit_xor("s1").over(before).alias("c1"), F.bit_xor("s2").over(before).alias("c2")).where("seg > 0")
    within = Window.partitionBy("conv_id", "seg").orderBy("depth")
    joined = rows.join(carried, ["conv_id", "seg"], "left")
    d = lambda k: F.bit_xor(f"x{k}").over(within).bitwiseXOR(F.coalesce(f"c{k}", F.lit(0).cast("long")))
    done = joined.select("conv_id", "seg", "depth", "m", "w", "x1", "x2", d(1).alias("d1"), d(2).alias("d2"))
    return done.select("conv_id", "seg", "depth", "m", "w", "d1", "d2", F.col("d1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("x2")).alias("p2"))


def enumerated(rows: DataFrame) -> DataFrame:
    """A row for each distinct digest: d1, d2, conv_id (smallest member), seg, depth, w, n_convs, p1, p2; fails if two prefixes share one."""
    same = ["p1", "p2", "m", "depth", "w"]
    found = rows.groupBy("d1", "d2").agg(F.count("*").alias("n_convs"), F.min(F.struct("conv_id", "seg")).alias("top"), *(f(c).alias(f"{c}_{f.__name__}") for c in same for f in (F.min, F.max)))
    agree = F.lit(True)
    for c in same:
        agree = agree & (F.col(f"{c}_min") == F.col(f"{c}_max"))
    depth = F.when(agree, F.col("depth_min")).otherwise(F.raise_error(F.lit("two different prefixes share a digest")).cast("long"))
    return found.select("d1", "d2", F.col("top.conv_id").alias("conv_id"), F.col("top.seg").alias("seg"), depth.alias("depth"), F.col("w_min").alias("w"), "n_convs", F.col("p1_min").alias("p1"), F.col("p2_min").alias("p2"))


def _shard(rows: dict[str, np.ndarray], segment: int) -> pa.RecordBatch:
    """One shard: slots for all digests, leaves and tokens scattered by slot, then added to the parents' slots, deepest first.

    The root has a slot; the first row of a deeper segment has no parent here, as the segments above get its sums as rows.
    """
    d1, d2, p1, p2 = (rows[c].view(np.uint64) for c in ("d1", "d2", "p1", "p2"))
    all1, all2 = np.append(d1, np.uint64(0)), np.append(d2, np.uint64(0))
    order = np.lexsort((all2, all1))
    s1, s2 = all1[order], all2[order]
    new = np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))
    table = PerfectHash(s1[new], s2[new])
    slot, size = table(d1, d2), int(new.sum())
    if (slot < 0).any():
        raise ValueError("a digest has no slot")
    parent, depth = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
    gate = (rows["depth"] > 1) & ((rows["depth"] - 1) % segment == 0)
    parent[slot], depth[slot] = np.where(gate, -1, table(p1, p2)), rows["depth"]
    leaves, tokens = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    np.add.at(leaves, slot, rows["leaves"])
    np.add.at(tokens, slot, rows["tokens"])
    by_depth = np.argsort(-depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        up = level[parent[level] >= 0]
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(tokens, parent[up], tokens[up])
    some = (leaves != 0) | (tokens != 0)
    own = [table.first[some].view(np.int64), table.second[some].view(np.int64), leaves[some], tokens[some]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in own], names=["d1", "d2", "leaves", "tokens"])


def accumulated(rows: DataFrame, nodes: DataFrame, segment: int) -> DataFrame:
    """d1, d2, n_leaves and saved_tokens of all nodes, the root (0, 0) among them."""
    own = nodes.select("conv_id", "seg", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("w")).alias("tokens"))
    # The segments of paths that hold nodes of their own, and those above them.
    reach = own.groupBy("conv_id").agg(F.max("seg").alias("top"))
    units = reach.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("seg"))
    sums = own.groupBy("conv_id", "seg").agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    long = reach.where("top > 0").select("conv_id").join(units, "conv_id").join(sums, ["conv_id", "seg"], "left")
    below = long.select("conv_id", "seg", ((F.col("seg") + 1) * segment).alias("depth"), F.sum("leaves").over(deeper).alias("leaves"), F.sum("tokens").over(deeper).alias("tokens")).where("leaves is not null")
    zero = F.lit(0).cast("long")
    path = rows.join(units, ["conv_id", "seg"]).select("conv_id", "seg", "depth", "d1", "d2", "p1", "p2", zero.alias("leaves"), zero.alias("tokens"))
    none = F.lit(None).cast("long")
    values = own.unionByName(below).select("conv_id", "seg", "depth", *(none.alias(c) for c in ("d1", "d2", "p1", "p2")), F.coalesce("leaves", zero).alias("leaves"), F.coalesce("tokens", zero).alias("tokens"))
    names = ["conv_id", "seg", "depth", "d1", "d2", "p1", "p2", "leaves", "tokens"]
    both = path.unionByName(values).repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "depth", F.col("d1").isNull())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def merged(part: pa.Table) -> dict[str, np.ndarray]:
            """Path rows, with the values of the rows behind each of them."""
            is_path = part.column("d1").is_valid().to_numpy()
            at = np.flatnonzero(is_path)
            out = {c: np.array(part.column(c).filter(pa.array(is_path)), dtype=np.int64) for c in names}
            for c in ("leaves", "tokens"):
                out[c] = np.add.reduceat(np.array(part.column(c), dtype=np.int64), at)
            return out

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) < SHARD_ROWS:
                continue
            whole = pa.Table.from_batches(held)
            conv, seg = (np.array(whole.column(c), dtype=np.int64) for c in ("conv_id", "seg"))
            cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (seg[1:] != seg[:-1])) + 1
            if not len(cuts):
                continue
            yield _shard(merged(whole.slice(0, int(cuts[-1]))), segment)
            held = whole.slice(int(cuts[-1])).to_batches()
        if held:
            yield _shard(merged(pa.Table.from_batches(held)), segment)

    sums = both.select(*names).mapInArrow(add, "d1 long, d2 long, leaves long, tokens long")
    return sums.groupBy("d1", "d2").agg(F.sum("leaves").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"))


def endings(ends: DataFrame) -> DataFrame:
    """d1, d2 and ends_sha256: the hash of the sorted, comma-joined conv_ids of ends (d1, d2, conv_id).

    Sorted runs become lines of at most END_ROWS ids; a node's lines are hashed one behind the other, never joined.
    """
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["d1", "d2", "conv_id"]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2, conv = (np.array(batch.column(c), dtype=np.int64) for c in by)
            if not len(d1):
                continue
            new = np.flatnonzero(np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])))
            starts = np.unique(np.concatenate([new, np.arange(0, len(d1), END_ROWS)]))
            stops = np.append(starts[1:], len(d1))
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(d1[starts]), pa.array(d2[starts]), pa.array(conv[starts]), pa.array(text)], names=["d1", "d2", "first", "line"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["d1", "d2", "ends_sha256"])
        for batch in batches:
            done = []
            for d1, d2, line in zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if (d1, d2) != key:
                    if key is not None:
                        done.append(one())
                    key, state = (d1, d2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(line.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if key is not None:
            yield one()

    blocks = ends.repartitionByRange(tasks, *by).sortWithinPartitions(*by).mapInArrow(lines, "d1 long, d2 long, first long, line string")
    return blocks.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(hashes, "d1 long, d2 long, ends_sha256 string")


def prefix_trie(paths: DataFrame, ids: DataFrame, segment: int = SEGMENT, scratch: Scratch | None = None) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    paths: conv_id, depth (1, 2, ...), m (the item's digest), w (its tokens); ids: every conv_id, once, with or without items.
    """
    scratch = scratch or Scratch()
    rows = scratch.put(prefixes(paths, segment, scratch), "prefixes")
    zero = F.lit(0).cast("long")
    found = scratch.put(enumerated(rows), "nodes")
    ids = scratch.put(ids, "ids")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("conv_id is not null")
    root = root.select(zero.alias("d1"), zero.alias("d2"), "conv_id", zero.alias("seg"), zero.alias("depth"), zero.alias("w"), "n_convs", *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")))
    children = found.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    nodes = found.unionByName(root).join(children, ["d1", "d2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = scratch.put(nodes, "trie")
    below = nodes.where("depth > 0")
    sums = scratch.put(accumulated(rows, below, segment), "sums")
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "d1", "d2")).alias("x")).select("conv_id", "x.d1", "x.d2")
    ends = ids.join(last, "conv_id", "left").select(F.coalesce("d1", zero).alias("d1"), F.coalesce("d2", zero).alias("d2"), "conv_id")
    ended = endings(ends)
    top = root.select("conv_id").first()
    parents = below.where("n_children > 0").select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # The root's children take its conv_id as a value; those of another hot parent are split by skew handling.
    first = nodes.where("depth <= 1").select(*nodes.columns, F.when(F.col("depth") == 1, F.lit(top.conv_id if top else None).cast("long")).alias("parent_conv_id"))
    deeper = nodes.where("depth > 1").join(parents, ["p1", "p2"]).select(*nodes.columns, "parent_conv_id")
    whole = first.unionByName(deeper).join(sums, ["d1", "d2"], "left").join(ended, ["d1", "d2"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    lone = (F.col("depth") == 0) & (F.col("n_children") == 0)
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.when(lone, F.lit(1).cast("long")).otherwise(F.coalesce("n_leaves", zero)).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The nodes of conversations with shared openings, written once; what was written on the way is deleted."""
    scratch = Scratch()
    paths, ids = shared_openings(conversations, scratch)
    out = scratch.put(prefix_trie(paths, ids, segment, scratch), "conversation-trie")
    scratch.drop_all_but(out)
    return out
