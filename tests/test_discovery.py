"""Hand-derived cases of the discovery plan, strict and literal."""

import pytest
from pyspark.sql import functions as F

from lociweave.functions import sequences as S
from lociweave.operators import anchors as A
from lociweave.operators import chain as C
from lociweave.operators import repeats as R
from lociweave.plans import discover as P

SEQUENCES = "family_id long, seq_idx int, name string, bases string, len long"
GENES = "family_id long, seq_idx int, gene string, chr string, strand string, region_start long, gene_start long, gene_end long, region_end long"
ANCHORS = "family_id long, row_id long, word string, len int, pos array<int>"


def family(spark, *bases, region=100, gene=(150, 160), strands="+++"):
    rows = [(0, k, f"n{k}", b, len(b)) for k, b in enumerate(bases)]
    genes = [(0, k, f"Gene{k}", f"chr{k + 1}", strands[k], region, *gene, region + 999) for k in range(len(bases))]
    return spark.createDataFrame(rows, SEQUENCES), spark.createDataFrame(genes, GENES)


def words(frame):
    return sorted((r.word, list(r.pos)) for r in frame.collect())


@pytest.mark.parametrize("mode, pos, starts", [("strict", [2, 2], [101, 101]), ("literal", [2, 3], [102, 103])])
def test_two_sequences_share_one_repeat(spark, mode, pos, starts):
    found = P.discover(*family(spark, "TACGTCA", "GACGTTC"), 3, mode=mode)
    assert words(found["anchors"]) == [("ACGT", pos)]
    assert [list(r.abs_pos) for r in found["cns"].collect()] == [starts]
    assert [list(r.chr) for r in found["cns"].collect()] == [["chr1", "chr2"]]


def test_shorter_repeat_of_three_sequences_is_kept_with_more_left_symbols(spark):
    assert words(P.discover(*family(spark, "TACGTCA", "GACGTTC", "CACGCAT"), 3)["anchors"]) == [("ACG", [2, 2, 2])]
    every = P.literal_anchors(*(lambda t, g: (P.prepared(t, g), P.X.gene_frames(P.prepared(t, g), g)))(*family(spark, "TACGTCA", "GACGTTC", "CACGCAT")), 3)
    assert [(r.word, list(r.pos)) for r in every.orderBy("row_id").collect()] == [("ACGT", [2, 3, 0]), ("ACG", [2, 3, 4])]


def test_subsumed_repeat_is_suppressed_only_on_demand(spark):
    three = family(spark, "TACGTCA", "GACGTTC", "TACGCAT")
    assert words(P.discover(*three, 3)["anchors"]) == []
    assert ("ACG", [2, 2, 2]) in words(P.discover(*three, 3, suppress_subsumed=False)["anchors"])


def literal_rows(spark, k, *bases):
    sequences, genes = family(spark, *bases)
    texts = P.prepared(sequences, genes)
    return words(P.literal_anchors(texts, P.X.gene_frames(texts, genes), k))


def test_literal_boundary_halves(spark):
    assert ("ACGT", [2, 3]) in literal_rows(spark, 3, "GACGT", "TACGT")
    assert ("TAC", [0, 2, 3]) in literal_rows(spark, 3, "GGA", "TACT", "TACA")
    assert ("TAC", [0, 2, 3]) in literal_rows(spark, 4, "GGA", "TACT", "TACA")
    assert words(P.discover(*family(spark, "GGA", "TACT", "TACA"), 4)["anchors"]) == []


def test_dedup_keeps_the_longest_and_literal_drops_by_old_numbers(spark):
    rows = spark.createDataFrame([(0, 0, "ACG", 3, [0, 6]), (0, 1, "ACGTA", 5, [5, 6]), (0, 2, "ACGT", 4, [5, 6])], ANCHORS)
    kept = rows.where("row_id > 0")
    assert [r.row_id for r in A.dedup_longest(kept).collect()] == [1]
    assert [r.row_id for r in P.literal_dedup(rows, kept).collect()] == [2]


@pytest.mark.parametrize("pos, keep", [((2, 3), True), ((2, 70), False), ((55, 55), False), ((70, 80), True), ((50, 3), False), ((61, 61), True), ((0, 5), False), ((60, 60), False)])
def test_filters(spark, pos, keep):
    frames = spark.createDataFrame([(0, 0, 50, 60), (0, 1, 50, 60)], "family_id long, seq_idx int, g0 long, g1 long")
    rows = spark.createDataFrame([(0, 0, "A", 1, list(pos))], ANCHORS)
    assert (P.literal_filtered(rows, frames).count() == 1) == keep


def test_chain_needs_a_base_between(spark):
    rows = spark.createDataFrame([(0, 0, "", 5, [10, 20]), (0, 1, "", 4, [16, 26]), (0, 2, "", 8, [15, 25])], ANCHORS)
    for chain in (C.heaviest_chain(rows), C.chain_large(rows), C.best_chains(rows), C.best_chains(rows, large=1)):
        assert [(r.step, r.row_id, r.score) for r in chain.orderBy("step").collect()] == [(1, 1, 9), (2, 0, 9)]
    twice = spark.createDataFrame([(0, 0, "", 6, [10, 10]), (0, 1, "", 5, [10, 10]), (0, 2, "", 10, [16, 16])], ANCHORS)
    assert C.scores(twice).first().score == 15
    assert C.scores(A.dedup_longest(twice)).first().score == 10


def test_coordinates(spark):
    one = spark.range(1)
    at = lambda strand, n, literal: one.select(S.absolute_start(F.lit(20), F.lit(8), F.lit(n), F.lit(1000), F.lit(strand), literal)).first()[0]
    assert (at("+", 100, True), at("+", 100, False), at("-", 100, True), at("-", 100, False)) == (1020, 1019, 1072, 1073)
    offset = one.select(*(S.gene_offset(F.lit(g), F.lit(1000), F.lit(100), F.lit("-")) for g in (1050, 1060))).first()
    assert tuple(offset) == (49, 39)


def test_reverse_complement_and_alphabet(spark):
    rows = spark.createDataFrame([("ACGTN",), ("aCg",)], "b string")
    assert [r[0] for r in rows.select(S.reverse_complement(F.col("b"))).collect()] == ["NACGT", "gGa"]
    assert [r[0] for r in rows.select(S.normalize(F.col("b"))).collect()] == ["ACGTN", "NCN"]
    assert [r[0] for r in rows.select(S.normalize(F.col("b"), soft_mask=False)).collect()] == ["ACGTN", "ACG"]


def test_edge_cases(spark):
    with pytest.raises(ValueError):
        P.discover(*family(spark, "ACGT", "ACGT"), 0)
    with pytest.raises(ValueError):
        P.discover(*family(spark, "ACGTACGT", "ACGTACGT", strands="+."), 3)
    found = P.discover(*family(spark, "TANGTCA", "GANGTTC"), 3)
    assert words(found["anchors"]) == [] and found["cns"].count() == 0
    assert words(P.discover(*family(spark, ""), 3)["anchors"]) == []


def test_repeats_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ACGTN" if k == 2 else "ACG") for _ in range(60)) for k in range(3)]
    frame = spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "family_id long, seq_idx int, bases string")
    for k, width in ((3, 256), (3, 4)):
        occ: dict = {}
        for s, t in enumerate(texts):
            for i in range(len(t)):
                for j in range(i + k, len(t) + 1):
                    if "N" not in t[i:j]:
                        occ.setdefault(t[i:j], []).append((t[i - 1] if i else f"^{s}", t[j] if j < len(t) else f"#{s}", s, i + 1))
        kept = set()
        for w, o in occ.items():
            prevs, nexts = {a for a, *_ in o}, {b for _, b, *_ in o}
            if len(prevs) > 1 and len(nexts) > 1 and not any({a for a, c, *_ in o if c == b} == prevs for b in nexts):
                kept |= {(w, s, p) for *_, s, p in o}
        got = {(r.word, r.seq_idx, r.pos) for r in R.maximal_repeats(frame, k, width=width).collect()}
        assert got == kept


def test_repeats_longer_than_the_first_width_and_than_a_chunk(spark):
    """Words of 300 and 1,200 symbols, across chunks; the symbol behind a word is no end where the text goes on."""
    import random

    rnd = random.Random(5)
    bases = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    for n in (256, 300, 1200):
        core = bases(n)
        texts = spark.createDataFrame([(0, 0, f"{bases(700)}A{core}C{bases(90)}"), (0, 1, f"{bases(30)}G{core}T{bases(1500)}")], "family_id long, seq_idx int, bases string")
        words, found = R.found_words(texts, 20)
        assert core in {r.word for r in words.collect()}
        assert {(r.seq_idx, r.prev, r.next) for r in found.where(F.col("word") == core).collect()} == {(0, "A", "C"), (1, "G", "T")}
        assert {r.word for r in R.maximal_repeats(texts, 20).collect()} == {core}


def test_windows_of_a_long_text_are_its_substrings(spark):
    import random

    rnd = random.Random(6)
    text = "".join(rnd.choice("ACGTN") for _ in range(3000))
    rows = R.windows(spark.createDataFrame([(0, 0, text), (0, 1, "ACG"), (0, 2, "")], "family_id long, seq_idx int, bases string"), 5, 600).collect()
    assert sorted((r.pos, r.before, r.raw) for r in rows) == [(k + 1, text[k - 1] if k else "^", text[k : k + 600]) for k in range(2996)]


def test_strict_mode_needs_a_gene_for_each_sequence(spark):
    sequences, genes = family(spark, "TACGTCA", "GACGTTC")
    for wrong in ((sequences, genes.where("seq_idx = 0")), (sequences.where("seq_idx = 0"), genes)):
        with pytest.raises(ValueError, match="not both there"):
            P.discover(*wrong, 3)
    with pytest.raises(ValueError, match="does not match"):
        P.by_name(sequences, genes)
    named = P.by_name(sequences.withColumn("name", F.concat(F.lit("Gene"), (1 - F.col("seq_idx")).cast("string"))), genes)
    assert sorted((r.seq_idx, r.gene) for r in named.collect()) == [(0, "Gene1"), (1, "Gene0")]
