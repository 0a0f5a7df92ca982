"""Column expressions over bases, positions and gene coordinates. All stay in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet in rank order, with the end mark first and the sequence boundary last.
ALPHABET = "$ACGNT#"
RANKS = "0123456"


def normalize(bases: Column, soft_mask: bool = True) -> Column:
    """Everything but A, C, G and T becomes N; with soft_mask, lower case does too."""
    return F.regexp_replace(bases if soft_mask else F.upper(bases), "[^ACGT]", "N")


def reverse_complement(bases: Column) -> Column:
    """Only upper-case bases are complemented; all are reversed."""
    return F.reverse(F.translate(bases, "ACGT", "TGCA"))


def oriented(bases: Column, strand: Column) -> Column:
    return F.when(strand == "-", reverse_complement(bases)).otherwise(bases)


def gene_offset(coordinate: Column, region_start: Column, length: Column, strand: Column) -> Column:
    """0-based offset of a genome coordinate within the oriented sequence."""
    offset = coordinate - region_start
    return F.when(strand == "-", length - offset - 1).otherwise(offset)


def absolute_start(position: Column, span: Column, length: Column, region_start: Column, strand: Column, literal: bool = False) -> Column:
    """Genome coordinate of the first base of a match at a 1-based position of an oriented sequence."""
    if literal:
        return F.when(strand == "+", region_start + position).otherwise(region_start + length - position - span)
    return F.when(strand == "+", region_start + position - 1).otherwise(region_start + length - position - span + 1)


def rank_key(word: Column, post_order: bool = True) -> Column:
    """Sort key in alphabet order; with post_order a word comes after its extensions."""
    key = F.translate(word, ALPHABET, RANKS)
    return F.concat(key, F.lit("7")) if post_order else key


def ambiguous(word: Column) -> Column:
    return word.rlike("[NnXx]")


def homopolymer(word: Column) -> Column:
    return (F.length(word) > 0) & (F.length(F.replace(word, F.substring(word, 1, 1), F.lit(""))) == 0)


def spread(positions: Column) -> Column:
    """Sum of the distances of all pairs of positions."""
    indexed = F.transform(positions, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    each = F.transform(indexed, lambda a: F.aggregate(F.filter(indexed, lambda b: b["i"] > a["i"]), F.lit(0).cast("long"), lambda s, b: s + F.abs(a["x"] - b["x"])))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)


def gap_inconsistency(later: Column, earlier: Column) -> Column:
    """Sum over all pairs of sequences of how far their gaps between two anchors differ."""
    return spread(F.zip_with(later, earlier, lambda a, b: a - b))


def precedes(earlier: Column, length: Column | int, later: Column) -> Column:
    """In every sequence, the earlier match ends before the later one starts, with a base between them."""
    return F.forall(F.zip_with(earlier, later, lambda a, b: a + length < b), lambda x: x)


def present_in_all(positions: Column) -> Column:
    return F.forall(positions, lambda x: x.isNotNull() & (x != 0))


def same_side(positions: Column, low: Column, high: Column) -> Column:
    """All positions are before their genes' starts, or none; and the same beyond their ends. low, high: arrays."""
    n = F.size(positions)
    before = F.size(F.filter(F.arrays_zip(positions.alias("x"), low.alias("g")), lambda z: z["x"] < z["g"]))
    behind = F.size(F.filter(F.arrays_zip(positions.alias("x"), high.alias("g")), lambda z: z["x"] > z["g"]))
    return ((before == 0) | (before == n)) & ((behind == 0) | (behind == n))


def outside_gene(positions: Column, low: Column, high: Column, spans: Column | None = None) -> Column:
    """No match starts within its gene; with spans, none ends there either."""
    inside = F.zip_with(F.arrays_zip(positions.alias("x"), low.alias("a")), high, lambda z, b: z["x"].between(F.least(z["a"], b), F.greatest(z["a"], b)))
    out = ~F.exists(inside, lambda x: x)
    return out if spans is None else out & outside_gene(F.transform(positions, lambda x: x + spans - 1), low, high)
