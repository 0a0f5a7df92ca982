"""Near-duplicate groups: fast similarity sketches, banding, and links confirmed on full shingle sets.

Sketching (after Dahlgaard, Knudsen and Thorup, 2017) goes in rounds: each round throws every shingle of a text into
one of SKETCH bins and keeps the least value of a bin; after SKETCH rounds, round SKETCH + b throws all into bin b, so
every bin fills. Texts with the same shingle set are one node from the start; those that share a band are candidates.
With BANDS bands of ROWS, a pair at the threshold shares a band with probability 0.999996.

Candidates are settled in three steps. Each node is compared with the smallest member of the buckets it shares most;
the links found so make a forest. Buckets that still hold several trees are laid out in bounded blocks, in which four
bits of each sketch value estimate the similarity of members of different trees: pairs that are far below the
threshold are passed over (a pair at the threshold is so with a probability of some 0.000003), of pairs far above it as
many are compared as would join their trees, and all others are compared, each pair in the first bucket it shares.
Where a pair far above it was no link after all, every pair of its buckets is compared. A comparison is always one of
full sets; sets travel to blocks, not to pairs, so that a group costs tables in proportion to its members.

Null and empty texts have no shingles, link with nothing and stay. Rows that share a doc_id count as versions of one
document. Rows whose doc_id is null link with nothing and have no component_id. Columns beyond doc_id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.bytetext import Rolling, bytes_of, words_of
from lociweave.llm.common import Scratch, mix64, slices
from lociweave.llm.components import components

BANDS, ROWS = 64, 6
SKETCH = BANDS * ROWS
#: Four bits of each sketch value, 16 values a word. A pair at the threshold differs in 90 of 384 values on average, with
#: a deviation of 8; pairs that differ in more than FAR are no links, pairs that differ in at most CLOSE should be links.
WORDS = SKETCH // 16
FAR, CLOSE = 128, 60
#: Members of a bucket that are looked at together, and shingles in all their sets; larger buckets are cut into blocks.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Pairs that share one copy of a set.
SHARING = 1024
TEXT_SLICE = 1 << 20
#: Bytes that part words: space and the five controls from tab on.
GAP = np.zeros(256, dtype=bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
TURNS = mix64(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, sorted within each row, and the size of each row's set."""
    data, offsets = bytes_of(column)
    starts, stops, counts = words_of(data, offsets, GAP)
    rows = len(counts)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    words = Rolling(data, fold_case=True)(starts, stops)
    ends = np.cumsum(counts)
    sets: list[np.ndarray] = []
    hashed = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        hashed += words[k : k + len(hashed)] * TURNS[k]
    hashed = mix64(hashed)
    for row in range(rows):
        n, first = counts[row], ends[row] - counts[row]
        if n >= size:
            sets.append(np.unique(hashed[first : first + n - size + 1]))
        elif n:
            own = np.sum(words[first : first + n] * TURNS[:n], dtype=np.uint64) + np.uint64(n)
            sets.append(mix64(np.array([own])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets), np.fromiter(map(len, sets), dtype=np.int64, count=rows)


def sketches(shingles: np.ndarray, sizes: np.ndarray, bins: int = SKETCH) -> np.ndarray:
    """A row of bins values for each set; a value's top ten bits are the round that filled the bin."""
    filled = np.full(len(sizes) * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for turn in range(2 * bins):
        if not len(shingles):
            break
        value = mix64(shingles ^ mix64(np.array([turn + 1], dtype=np.uint64)))
        place = (value % np.uint64(bins)).astype(np.int64) if turn < bins else np.int64(turn - bins)
        np.minimum.at(filled, owner * bins + place, (np.uint64(turn) << np.uint64(54)) | (value >> np.uint64(10)))
        full = (filled.reshape(-1, bins) != np.iinfo(np.uint64).max).all(axis=1)
        keep = ~full[owner]
        owner, shingles = owner[keep], shingles[keep]
    return filled.reshape(-1, bins)


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, a 16-byte signature of the set, the hash of each band, and four bits of each sketch value."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_SLICE, rows=4096):
            shingles, sizes = shingle_sets(batch.column("text"), size)
            some = np.flatnonzero(sizes)
            bands = np.zeros((len(sizes), BANDS), dtype=np.uint64)
            signature = np.zeros((len(sizes), 2), dtype=np.uint64)
            digest = np.zeros((len(sizes), WORDS), dtype=np.uint64)
            if len(some):
                values = sketches(shingles, sizes[some])
                nibbles = (mix64(values) >> np.uint64(60)).reshape(len(some), WORDS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
                digest[some] = np.bitwise_or.reduce(nibbles, axis=2)
                values = values.reshape(len(some), BANDS, ROWS)
                bands[some] = mix64((values * TURNS[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * TURNS[8])
                firsts = np.cumsum(sizes[some]) - sizes[some]
                signature[some, 0] = np.add.reduceat(shingles, firsts)
                signature[some, 1] = np.bitwise_xor.reduceat(mix64(shingles), firsts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sizes) + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel()))
            marks, digests = (pa.array([row.tobytes() for row in x], pa.binary()) for x in (signature, digest))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), marks, lists, digests], ["doc_id", "n_shingles", "mark", "bands", "digest"])

    return docs.mapInArrow(step, "doc_id long, n_shingles long, mark binary, bands array<long>, digest binary")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """node and its sorted shingle hashes as bytes."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_SLICE):
            shingles, sizes = shingle_sets(batch.column("text"), size)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingles[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(step, "node long, shingles binary")


def _with_set(pairs: DataFrame, sets: DataFrame, end: str, name: str, scratch: Scratch) -> DataFrame:
    """pairs with the set of one end; a node of many pairs has several copies, so that no task gets all its pairs."""
    often = scratch.put(pairs.groupBy(end).agg(F.ceil(F.count("*") / SHARING).cast("int").alias("copies")).where("copies > 1"), "often")
    dealt = pairs.join(often, end, "left").withColumn("copy", F.pmod(F.xxhash64("u", "v"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    copied = sets.withColumnRenamed("node", end).join(often, end, "left")
    copied = copied.select(end, F.col("shingles").alias(name), F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    return dealt.join(copied, [end, "copy"]).drop("copy")


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int, scratch: Scratch) -> DataFrame:
    """pairs (u, v and others) with linked: whether the full sets are similar enough."""
    names = pairs.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(shared > 0 and 100 * shared >= per_cent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(linked, pa.bool_())], [*names, "linked"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names)
    joined = _with_set(_with_set(pairs, sets, "v", "b", scratch), sets, "u", "a", scratch).select(*names, "a", "b")
    return scratch.put(joined.mapInArrow(step, f"{kinds}, linked boolean"), "confirmed")


def rooted(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and its root, where links (u, v; v smaller) gives each u one v."""
    roots = scratch.put(links.select(F.col("u").alias("node"), F.col("v").alias("component"), F.lit(True).alias("moved")), "roots")
    while not roots.where("moved").isEmpty():
        onward = roots.select(F.col("node").alias("component"), F.col("component").alias("next"))
        following = roots.join(onward, "component", "left").select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved"))
        following = scratch.put(following, "roots")
        scratch.drop(roots)
        roots = following
    return roots.drop("moved")


def _unlike(digests: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many sketch values the members a and b differ, by four bits of each."""
    x = digests[a] ^ digests[b]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def _trees(tree: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, nearest first, that join trees; and each member's tree once they are joined."""
    tree, used = tree.copy(), []
    order = np.argsort(far, kind="stable")
    a, b = a[order], b[order]
    while len(order):
        apart = tree[a] != tree[b]
        order, a, b = order[apart], a[apart], b[apart]
        if not len(order):
            break
        # Each tree's nearest pair; pairs are in order, so these never close a ring but by ties, which the union sees.
        ends = np.concatenate([tree[a], tree[b]])
        rank = np.tile(np.arange(len(order)), 2)
        by = np.lexsort((rank, ends))
        first = np.append(True, ends[by][1:] != ends[by][:-1])
        chosen = np.unique(rank[by][first])
        lead = np.arange(tree.max() + 1)

        def top(x: int, lead: np.ndarray = lead) -> int:
            while lead[x] != x:
                lead[x] = lead[lead[x]]
                x = lead[x]
            return x

        for k in chosen:
            x, y = top(tree[a[k]]), top(tree[b[k]])
            if x != y:
                lead[max(x, y)] = min(x, y)
                used.append(order[k])
        tree = np.array([top(x) for x in range(len(lead))])[tree]
    return np.array(used, dtype=np.int64), tree


def _pairs_of(rows: dict[str, np.ndarray], per_cent: int, every: bool) -> tuple[np.ndarray, ...]:
    """Indices of the pairs to compare within groups of sorted rows, and whether they should be links."""
    group, tree_of, n, digests, bands, main = (rows[c] for c in ("group", "component", "n", "digest", "bands", "main"))
    cut = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start, stop in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        m = stop - start
        _, tree = np.unique(tree_of[start:stop], return_inverse=True)
        if not tree.any():
            continue
        size, at, crossing, own = n[start:stop], main[start:stop], bool(rows["crossing"][start]), rows["bucket"][start]
        step = max(1, 100_000 // m)
        found = []
        for first in range(0, m, step):
            a = np.arange(first, min(m, first + step))
            ok = (tree[a][:, None] != tree) & (a[:, None] < np.arange(m))
            ok &= 100 * np.minimum(size[a][:, None], size) >= per_cent * np.maximum(size[a][:, None], size)
            if crossing:
                ok &= at[a][:, None] != at
            x, y = np.nonzero(ok)
            far = _unlike(digests, a[x] + start, y + start)
            near = far <= FAR
            found.append((a[x[near]], y[near], far[near]))
        a, b, far = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(a):
            continue
        # A pair belongs to the first bucket that both are in; close ones of earlier buckets are joined there.
        here = np.concatenate([bands[x, np.argmax(bands[x] == bands[y], axis=1)] == own for x, y in zip(np.array_split(a + start, len(a) // 50_000 + 1), np.array_split(b + start, len(a) // 50_000 + 1), strict=True)])
        close = far <= CLOSE
        if every:
            out.append((a[here] + start, b[here] + start, close[here]))
            continue
        before = np.flatnonzero(close & ~here)
        _, tree = _trees(tree, a[before], b[before], far[before])
        at = np.flatnonzero(close & here)
        used, tree = _trees(tree, a[at], b[at], far[at])
        keep = np.concatenate([at[used], np.flatnonzero(here & ~close & (tree[a] != tree[b]))])
        out.append((a[keep] + start, b[keep] + start, close[keep]))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(bool)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _open_buckets(entries: DataFrame, labels: DataFrame, looks: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, node, component, main, crossing and blocks, for the buckets that hold several components.

    A bucket of several blocks is cut so that members outside its largest component, and these only, meet all others:
    blocks of those alone, and crossing ones in which they meet the main component's.
    """
    labelled = entries.select("bucket", "node").join(looks.select("node", "n"), "node").join(labels, "node", "left")
    labelled = scratch.put(labelled.withColumn("component", F.coalesce("component", "node")), "labelled")
    parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    most = F.max(F.struct("k", "w", "component")).alias("most")
    mixed = parts.groupBy("bucket").agg(F.sum("k").alias("k"), F.sum("w").alias("w"), F.count("*").alias("parts"), most).where("parts > 1")
    blocks = lambda k, w: F.ceil(F.greatest(k / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    whole, own, others = blocks(F.col("k"), F.col("w")), blocks(F.col("most.k"), F.col("most.w")), blocks(F.col("k") - F.col("most.k"), F.col("w") - F.col("most.w"))
    mixed = scratch.put(mixed.select("bucket", whole.alias("whole"), own.alias("own"), others.alias("others"), F.col("most.component").alias("largest")), "mixed")
    own, others = F.col("own"), F.col("others")
    each = lambda count, key: F.transform(F.sequence(F.lit(0), count - 1), key)
    place = lambda count: F.pmod(F.xxhash64("node"), count).cast("int")
    main = F.col("component") == F.col("largest")
    inside = F.when(main, each(others, lambda i: i * own + place(own)))
    outside = F.concat(
        each(own, lambda j: place(others) * own + j),
        each(others, lambda t: own * others + F.least(t, place(others)) * others + F.greatest(t, place(others))),
    )
    where = F.when(F.col("whole") == 1, F.array(F.lit(-1))).otherwise(F.coalesce(inside, outside)).cast("array<bigint>")
    return labelled.join(mixed, "bucket").select("bucket", "node", "component", "n", main.alias("main"), (own * others).alias("crossings"), where.alias("blocks"))


def _by_group(batches: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.Table]:
    """Rows sorted by bucket and block, so that no group is cut. Groups are bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 2 * BLOCK and sum(b.nbytes for b in held) < most_bytes:
            continue
        rows = pa.Table.from_batches(held)
        bucket, block = (np.asarray(rows.column(c).combine_chunks()) for c in ("bucket", "block"))
        change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]))
        if len(change):
            end = int(change[-1]) + 1
            yield rows.slice(0, end)
            held = rows.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _numbers(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    return [np.asarray(rows.column(c).combine_chunks()) for c in columns]


def _to_compare(open_: DataFrame, looks: DataFrame, per_cent: int, every: bool, scratch: Scratch) -> DataFrame:
    """bucket, block and node of what is to be compared on full sets, and with which nodes: those that should be links, and others."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            bucket, block, node, component, n, main, crossings = _numbers(rows, "bucket", "block", "node", "component", "n", "main", "crossings")
            group = np.cumsum(np.append(0, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])))
            bands = np.asarray(pa.chunked_array(rows.column("bands").chunks).combine_chunks().flatten()).reshape(len(node), BANDS)
            digest = np.frombuffer(b"".join(rows.column("digest").to_pylist()), dtype=np.uint64).reshape(len(node), WORDS)
            a, b, close = _pairs_of({"group": group, "bucket": bucket, "component": component, "n": n, "main": main, "crossing": (block >= 0) & (block < crossings), "digest": digest, "bands": bands}, per_cent, every)
            if not len(a):
                continue
            asked = np.unique(np.concatenate([a, b]))
            columns = [pa.array(x[asked]) for x in (bucket, block, node)]
            for kind in (close, ~close):
                x, y = a[kind], b[kind]
                order = np.argsort(x, kind="stable")
                ends = np.searchsorted(x[order], asked, side="right")
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(node[y[order]])))
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "node", "close", "others"])

    rows = open_.join(looks.drop("n"), "node").select("bucket", F.explode("blocks").alias("block"), "node", "component", "n", "main", "crossings", "digest", "bands")
    dealt = rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node")
    return scratch.put(dealt.mapInArrow(step, "bucket long, block long, node long, close array<long>, others array<long>"), "asked")


def _compared(asked: DataFrame, sets: DataFrame, per_cent: int, scratch: Scratch) -> DataFrame:
    """u, v, close and linked: all links among what is asked, and the pairs that should be links but are none."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            bucket, block, node = _numbers(rows, "bucket", "block", "node")
            sets_ = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for c in rows.column("shingles").chunks for x in c]
            size = np.fromiter(map(len, sets_), dtype=np.int64, count=len(sets_))
            kinds = [[np.asarray(x.values) if len(x) else None for c in rows.column(k).chunks for x in c] for k in ("close", "others")]
            cut = np.append(np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]))), len(node))
            out: list[tuple[np.ndarray, ...]] = []
            for start, stop in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                order = np.argsort(node[start:stop], kind="stable") + start
                named = node[order]
                for close, asked_ in zip((True, False), kinds, strict=True):
                    for k in range(start, stop):
                        if asked_[k] is None:
                            continue
                        # A partner may have several rows: versions of one document.
                        low, high = (np.searchsorted(named, asked_[k], side=x) for x in ("left", "right"))
                        with_ = order[np.repeat(high - np.cumsum(high - low), high - low) + np.arange((high - low).sum())]
                        mine, theirs = sets_[k], np.concatenate([sets_[x] for x in with_])
                        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                        shared = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum(size[with_]) - size[with_])
                        linked = 100 * shared >= per_cent * (len(mine) + size[with_] - shared)
                        keep = linked | close
                        out.append((np.full(keep.sum(), node[k]), node[with_][keep], np.full(keep.sum(), close), linked[keep]))
            if out:
                a, b, close, linked = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.maximum(a, b), np.minimum(a, b), close, linked)], ["u", "v", "close", "linked"])

    dealt = asked.join(sets, "node").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node")
    return scratch.put(dealt.select("bucket", "block", "node", "close", "others", "shingles").mapInArrow(step, "u long, v long, close boolean, linked boolean"), "compared")


def _failed(compared: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs that should be links but are none; versions of a document may link in one and not in another: one is enough."""
    return scratch.put(compared.where("close").groupBy("u", "v").agg(F.max("linked").alias("linked")).where("not linked").select("u", "v"), "failed")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, per_cent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    scratch = Scratch()
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    base = scratch.put(sketched(docs, shingle_words), "sketches")
    some = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    copies = some.groupBy("mark").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("digest").alias("digest"))
    copies = scratch.put(copies, "copies")
    named = some.select("doc_id", "n_shingles", "mark").join(copies.select("mark", "node"), "mark").drop("mark")
    rest = base.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("node"))
    rows = scratch.put(named.unionByName(rest), "rows")
    scratch.drop(base)
    members = copies.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").drop("last")
    entries = scratch.put(members.join(shared, "bucket"), "entries")
    candidates = scratch.put(entries.select("node").distinct(), "candidates")
    looks = scratch.put(copies.select("node", "n", "digest", "bands").join(candidates, "node", "left_semi"), "looks")
    scratch.drop(copies)
    sets = scratch.put(full_sets(docs.join(candidates.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), shingle_words), "sets")

    # Each node with the centre of most of its buckets.
    common = entries.where("node <> centre").repartition("node").groupBy("node", "centre").agg(F.count("*").alias("k"))
    stars = common.groupBy("node").agg(F.max_by("centre", F.struct("k", -F.col("centre"))).alias("centre")).select(F.col("node").alias("u"), F.col("centre").alias("v"))
    labels = rooted(confirmed(scratch.put(stars, "stars"), sets, per_cent, scratch).where("linked").select("u", "v").distinct(), scratch)
    # Members of buckets that hold several trees.
    open_ = _open_buckets(entries, labels, looks, scratch)
    compared = _compared(_to_compare(open_, looks, per_cent, False, scratch), sets, per_cent, scratch)
    links, failed, done = compared.where("linked").select("u", "v"), _failed(compared, scratch), None
    while not failed.isEmpty():
        of = lambda end: open_.select("bucket", F.col("node").alias(end))
        again = failed.join(of("u"), "u").join(of("v"), ["v", "bucket"]).select("bucket").distinct()
        again = scratch.put(again if done is None else again.join(done, "bucket", "left_anti"), "again")
        done = again if done is None else done.unionByName(again)
        compared = _compared(_to_compare(open_.join(again, "bucket", "left_semi"), looks, per_cent, True, scratch), sets, per_cent, scratch)
        links, failed = links.unionByName(compared.where("linked").select("u", "v")), _failed(compared, scratch)
    # Versions of one document, whatever their texts are.
    versions = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last").select("doc_id", "v")
    versions = rows.join(versions, "doc_id").select(F.col("node").alias("u"), "v").where("u <> v")
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_root"))
    ends = links.unionByName(versions).join(of("u"), "u", "left").join(of("v"), "v", "left")
    joined = components(ends.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")), scratch)
    # A node's root, and what that root is part of.
    final = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    final = scratch.put(final.unionByName(joined.join(labels, "node", "left_anti").select("node", "component")), "final")
    out = rows.join(final, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    scratch.drop_all_but(rows, final)
    return out.select("doc_id", "n_shingles", "component_id", (F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))).alias("kept"))
