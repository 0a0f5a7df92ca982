"""Long repeats, large families and hot words: the distributed ways against brute force and the plain ones."""

import random
from itertools import product as every

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.operators import anchors as A
from lociweave.operators import blocks as B
from lociweave.operators import chain as C
from lociweave.operators import repeats as R
from lociweave.operators.longrepeats import long_repeats
from lociweave.operators.numbering import row_numbers

TEXTS = "family_id long, seq_idx int, bases string"


def occurring(texts, k):
    """All words of at least k symbols without N, with prev, next, sequence and position of each occurrence."""
    out: dict = {}
    for s, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i + k, len(t) + 1):
                if t[j - 1] == "N" or "N" in t[i : i + k]:
                    break
                out.setdefault(t[i:j], []).append((t[i - 1] if i else f"^{s}", t[j] if j < len(t) else f"#{s}", s, i + 1))
    return {w: o for w, o in out.items() if len({x[1] for x in o}) > 1}


@pytest.mark.parametrize("seed", range(2))
def test_right_maximal_words_and_their_places(spark, seed):
    """Copies, shifted copies, runs of one symbol and N, all much longer than the width."""
    rnd = random.Random(seed)
    bases = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    core, other = bases(70), bases(33)
    texts = [f"{bases(5)}{core}{bases(9)}{other}", f"{core}{bases(3)}", f"{bases(4)}{core[7:60]}N{other}{core[:50]}", "A" * 45, f"{bases(2)}{'A' * 30}C{'AC' * 20}"]
    want = occurring(texts, 3)
    rows = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], TEXTS)
    words, found = R.found_words(rows, 3, width=8)
    got: dict = {}
    for r in found.collect():
        assert r.len == len(r.word)
        got.setdefault(r.word, []).append((r.prev, r.next, r.seq_idx, r.pos))
    assert {w: sorted(o) for w, o in got.items()} == {w: sorted(o) for w, o in want.items()}
    assert {r.word for r in words.collect()} == set(want)
    assert {(r.word, r.kmer) for r in R.right_maximal(rows, 3, width=8).collect()} == {(w, w[:3]) for w in want}


def test_equal_texts_among_short_ones(spark):
    """Two equal texts of 3,000 symbols: rows stay in proportion, and no suffix is carried as a string."""
    rnd = random.Random(1)
    long = "".join(rnd.choice("ACGT") for _ in range(3_000))
    rows = [(0, 0, long), (0, 1, f"G{long}")] + [(k, 0, "".join(rnd.choice("ACGT") for _ in range(40))) for k in range(1, 300)]
    found = R.maximal_repeats(spark.createDataFrame(rows, TEXTS), 20)
    got = [(r.family_id, r.seq_idx, r.pos, r.len) for r in found.collect()]
    assert sorted(x for x in got if x[3] > 1000) == [(0, 0, 1, 3_000), (0, 1, 2, 3_000)]
    assert {r.word for r in found.where("len > 1000").collect()} == {long}
    for plan in (R.marked_words(spark.createDataFrame(rows, TEXTS), 20),):
        assert plan.where("len > 1000").agg(F.max(F.length("word"))).first()[0] < 40


def test_run_of_one_symbol(spark):
    rows = spark.createDataFrame([(0, 0, "A" * 300)], TEXTS)
    found = R.marked_words(rows, 7, width=8)
    # A word of n symbols stands at 301 - n places; the last one has none behind it to differ from.
    assert found.count() == sum(301 - n for n in range(7, 300))


def test_long_repeats_have_no_join_on_the_family_alone(spark):
    rows = spark.createDataFrame([(0, 0, "ACGT" * 20), (0, 1, "ACGT" * 20)], TEXTS)
    starts = R.suffixes(rows, 3, 8)
    cut = R.cuts(starts, 8)
    shared = cut.where((F.col("n") > 1) & (F.length("suffix") == 8)).select("family_id", "suffix", "first")
    members = starts.join(shared, ["family_id", "suffix"]).select("family_id", "seq_idx", "pos", "prev", "first")
    found = long_repeats(members, R.windows(rows, 1, 4), 8)
    assert found.where("len < 8").count() == 0 and found.agg(F.max("len")).first()[0] == 80


@pytest.mark.parametrize("together", [1, 3, 1 << 14])
def test_products_by_ordinals(spark, together):
    places = {0: [3, 9, 20], 1: [5], 2: [7, 8]}
    rows = [(1, "ACG", 3, s, p) for s, own in places.items() for p in own] + [(1, "AAA", 3, 0, 2), (2, "C", 1, 0, 4)]
    found = spark.createDataFrame(rows, "family_id long, word string, len int, seq_idx int, pos int")
    sizes = spark.createDataFrame([(1, 3), (2, 1)], "family_id long, n int")
    got = {(r.family_id, r.word, r.ordinal, tuple(r.pos)) for r in A.anchors(found, sizes, together=together).collect()}
    want = {(1, "ACG", k, p[::-1]) for k, p in enumerate(every(*(places[s] for s in (2, 1, 0))))}
    assert got == want | {(2, "C", 0, (4,))}
    whole = A.anchors(found, sizes, all_sequences=False, together=together).where("word = 'AAA'").collect()
    assert [(r.ordinal, list(r.pos)) for r in whole] == [(0, [2, None, None])]


def test_a_word_of_many_anchors_makes_no_large_row(spark):
    rows = spark.range(300).select(F.lit(1).cast("long").alias("family_id"), F.lit("ACG").alias("word"), F.lit(3).alias("len"), (F.col("id") % 3).cast("int").alias("seq_idx"), F.col("id").cast("int").alias("pos"))
    sizes = spark.createDataFrame([(1, 3)], "family_id long, n int")
    out = A.anchors(rows, sizes)
    total = out.agg(F.count("*"), F.sum("ordinal"), F.count_distinct("ordinal"), *(F.sum(F.col("pos")[k]) for k in range(3))).first()
    n = 100**3
    assert total[:3] == (n, n * (n - 1) // 2, n) and total[3:] == tuple(n // 100 * sum(range(k, 300, 3)) for k in range(3))


def test_numbers_of_a_group_that_fills_several_partitions(spark):
    rnd = random.Random(2)
    rows = [(1, rnd.random(), k) for k in range(3000)] + [(g, rnd.random(), g) for g in range(2, 90) for _ in range(rnd.randrange(3))]
    frame = spark.createDataFrame(rows, "g long, x double, y long")
    got = row_numbers(frame, ["g"], ["x"], "n")
    assert got.columns == ["g", "x", "y", "n"]
    by: dict = {}
    for r in got.collect():
        by.setdefault(r.g, []).append((r.x, r.n))
    assert all([n for _, n in sorted(own)] == list(range(1, len(own) + 1)) for own in by.values()) and sum(map(len, by.values())) == len(rows)
    assert row_numbers(frame.limit(0), ["g"], ["x"], "n").collect() == []


def crowd(seed, sizes, dims, wide, long):
    rnd = random.Random(seed)
    return [(f, k, rnd.randrange(1, long), [rnd.randrange(wide) for _ in range(dims)]) for f, n in enumerate(sizes) for k in range(n)]


ANCHORS = "family_id long, row_id long, len long, pos array<long>"


@pytest.mark.parametrize("dims, use_length", [(1, True), (2, False), (3, True)])
def test_edges_of_families_in_many_blocks(spark, dims, use_length):
    rows = crowd(dims, (150, 1, 40, 7), dims, 60, 6)
    want = {(f, i, j, m) for f, i, n, a in rows for g, j, m, b in rows if f == g and all(x + (n if use_length else 0) < y for x, y in zip(a, b, strict=True))}
    for size in (4, 32, 256):
        got = [tuple(r) for r in B.edges(spark.createDataFrame(rows, ANCHORS), use_length, size=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_family_with_few_edges_meets_few_pairs(spark):
    """Positions rise in one sequence and fall in the other: the entries of blocks tell that nothing follows."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("family_id"), F.col("id").alias("row_id"), F.lit(5).cast("long").alias("len"), F.array(F.col("id") * 10, 200_000 - F.col("id") * 10).alias("pos"))
    of = B.blocks(rows, B.BLOCK)
    assert of.count() > 70 and B.block_pairs(of, True).count() == 0
    assert B.edges(rows).count() == 0


def test_heaviest_before_equals_all_pairs():
    rnd = np.random.default_rng(3)
    for dims in (1, 2, 3, 4):
        for wide in (4, 50, 10_000):
            end, pos, best = rnd.integers(0, wide, (400, dims)), rnd.integers(0, wide, (300, dims)), rnd.integers(1, 30, 400)
            below = (end[:, None, :] < pos[None]).all(axis=2)
            assert (B.heaviest_before(end, best, pos, small=8) == np.where(below, best[:, None], 0).max(axis=0)).all()


@pytest.mark.parametrize("seed, dims", [(1, 2), (2, 3), (3, 1)])
def test_chains_across_blocks_equal_the_plain_ones(spark, seed, dims):
    """Many ties in weight; one family is in many blocks, and one is empty of edges."""
    rows = crowd(seed, (120, 1, 3, 25), dims, 40, 4)
    frame = spark.createDataFrame(rows, ANCHORS)
    plain = sorted((r.family_id, r.step, r.row_id, r.score) for r in C.heaviest_chain(frame).collect())
    got = sorted((r.family_id, r.step, r.row_id, r.score) for r in B.chain(frame, size=16).collect())
    assert got == plain
    assert sorted((r.family_id, r.step, r.row_id, r.score) for r in C.best_chains(frame, large=20).collect()) == plain


def test_blocks_finished_by_halves():
    rnd = np.random.default_rng(5)
    n = 500
    pos, length, row = rnd.integers(0, 90, (n, 2)), rnd.integers(1, 5, n), rnd.permutation(n)
    order = np.lexsort((row, pos[:, 0]))
    pos, length, row = pos[order], length[order], row[order]
    halves, plain = B.Best(n), B.Best(n)
    B.within(pos, length, row, halves, small=8)
    B.within(pos, length, row, plain, small=n)
    assert (halves.weight == plain.weight).all() and (halves.row == plain.row).all() and (halves.gap == plain.gap).all()


def test_vectorised_chains_cost_no_call_a_family(spark):
    """Families of all sizes, some across batches, give the plain chains; 60,000 small ones are a matter of seconds."""
    import time

    rnd = random.Random(5)
    rows = [(f, r, rnd.randint(1, 4), [rnd.randint(0, 40) for _ in range(2 + f % 2)]) for f in range(300) for r in range(rnd.randint(1, 12))]
    rows += [(300, r, rnd.randint(1, 3), [rnd.randint(0, 300), rnd.randint(0, 300)]) for r in range(400)]
    frame = spark.createDataFrame(rows, "family_id long, row_id long, len long, pos array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert sorted(map(tuple, C.chain_large(frame).collect())) == sorted(map(tuple, C.heaviest_chain(frame).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = spark.range(240_000).select((F.col("id") % 60_000).alias("family_id"), F.col("id").alias("row_id"), F.lit(1).cast("long").alias("len"), F.array("id", "id").alias("pos"))
    began = time.monotonic()
    assert C.chain_large(many).where("step = 1 and score = 4").count() == 60_000
    assert time.monotonic() - began < 20


def test_clear_starts_equal_all_starts_without_n(spark):
    """Across pieces, at ends, beside N, and in texts of N alone; numbers of starts come from the lengths of stretches."""
    rnd = random.Random(11)
    text = "".join(rnd.choice("ACGTACGTACGTN") for _ in range(R.CHUNK * R.TOGETHER * 2 + 40))
    rows = spark.createDataFrame([(0, 0, text), (0, 1, "A" * 60), (1, 0, "NNNNNNNN"), (1, 1, "ACGTN"), (2, 0, ""), (2, 1, None), (3, 0, "ACGTACGT")], TEXTS)
    for k, width in ((5, 8), (8, 48)):
        want = {(r.family_id, r.seq_idx, r.pos, r.before, (r.raw.split("N")[0] + "N") if "N" in r.raw else r.raw) for r in R.windows(rows, k, width).where(~F.contains(F.substring("raw", 1, k), F.lit("N"))).collect()}
        got = [tuple(r) for r in R.clear_windows(rows, k, width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    counts = {(r.k, r.family_id): r.n_kmers for r in R.kmer_counts(rows, [5, 8]).collect()}
    assert counts == {(k, r.family_id): r.n for k in (5, 8) for r in R.kmers(rows, k).groupBy("family_id").agg(F.count("*").alias("n")).collect()}


def test_maximal_words_in_one_pass(spark):
    rnd = random.Random(4)
    rows = [(f, w, rnd.choice("AC"), rnd.choice("GT")) for f in range(3) for w in "abcdefgh" for _ in range(rnd.randrange(1, 6))]
    found = spark.createDataFrame(rows, "family_id long, word string, prev string, next string")
    kept = R.left_diverse(found)
    want = kept.join(R.subsumed(found, kept), ["family_id", "word"], "left_anti")
    assert sorted(map(tuple, R.maximal_words(found).collect())) == sorted((r.family_id, r.word) for r in want.collect())


def test_long_repeats_read_no_other_start(spark, monkeypatch):
    """What is behind a shared window is kept with it: all starts are not made again for it."""
    monkeypatch.setattr(R, "windows", None)
    rows = spark.createDataFrame([(0, 0, f"{'ACGTTGCA' * 9}NAC"), (0, 1, f"G{'ACGTTGCA' * 9}")], TEXTS)
    assert R.maximal_repeats(rows, 60).agg(F.max("len")).first()[0] == 72
