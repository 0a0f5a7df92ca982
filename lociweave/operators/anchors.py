"""Anchors: one position per sequence for each repeat that all sequences of a family share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions.sequences import outside_gene, present_in_all, rank_key, same_side
from lociweave.operators.numbering import row_numbers

#: Anchors of a word that one task makes together.
TOGETHER = 1 << 14


def by_sequence(occurrences: DataFrame) -> DataFrame:
    """family_id, word, len, and an array with the sorted positions in each sequence that has any."""
    each = occurrences.groupBy("family_id", "word", "len", "seq_idx").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return each


def anchor_counts(occurrences: DataFrame) -> DataFrame:
    """How many anchors each word would give, absent sequences counting once."""
    sizes = by_sequence(occurrences).groupBy("family_id", "word").agg(F.collect_list(F.size("positions").cast("long")).alias("sizes"))
    return sizes.select("family_id", "word", F.aggregate("sizes", F.lit(1).cast("long"), lambda p, n: p * n).alias("n_anchors"))


def unranked(lists: Column, ordinal: Column) -> Column:
    """The choice with this ordinal of one element of each list, the first list varying fastest; a null list gives a null."""
    start = F.struct(ordinal.alias("left"), F.expr("cast(array() as array<int>)").alias("done"))

    def digit(state: Column, own: Column) -> Column:
        n = F.greatest(F.coalesce(F.size(own), F.lit(1)), F.lit(1)).cast("long")
        pick = F.get(own, (state["left"] % n).cast("int"))
        return F.struct(F.floor(state["left"] / n).cast("long").alias("left"), F.array_append(state["done"], pick).alias("done"))

    return F.aggregate(lists, start, digit, lambda s: s["done"])


def anchors(occurrences: DataFrame, sizes: DataFrame, all_sequences: bool = True, together: int = TOGETHER) -> DataFrame:
    """family_id, word, len, ordinal, pos: the products of the positions of each word.

    sizes: family_id, n (sequences). With all_sequences, words that miss one are dropped before anything is multiplied.
    Ordinals are dealt over tasks in ranges of `together`, and each is turned into its positions by div and mod.
    """
    each = by_sequence(occurrences)
    lists = each.groupBy("family_id", "word", "len").agg(F.map_from_entries(F.collect_list(F.struct("seq_idx", "positions"))).alias("m"))
    lists = lists.join(sizes, "family_id")
    if all_sequences:
        lists = lists.where(F.size("m") == F.col("n"))
    ordered = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at(F.col("m"), i))
    count = F.aggregate("lists", F.lit(1).cast("long"), lambda p, own: p * F.greatest(F.coalesce(F.size(own), F.lit(1)), F.lit(1)))
    rows = lists.select("family_id", "word", "len", ordered.alias("lists")).withColumn("count", count)
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / together))))
    parts = parts.repartition("family_id", "word", "part")
    last = F.least((F.col("part") + 1) * together, "count") - 1
    dealt = parts.select("family_id", "word", "len", "lists", F.explode(F.sequence(F.col("part") * together, last)).alias("ordinal"))
    return dealt.select("family_id", "word", "len", "ordinal", unranked(F.col("lists"), F.col("ordinal")).alias("pos"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with row_id: words in alphabet order, extensions first, then the product's order."""
    keyed = rows.withColumn("_key", rank_key(F.col("word")))
    return row_numbers(keyed, ["family_id"], ["_key", "ordinal"], "row_id").drop("_key")


def gene_arrays(genes: DataFrame) -> DataFrame:
    """family_id and, by sequence, arrays of 1-based gene bounds (lower, upper)."""
    one = F.struct("seq_idx", F.least("g0", "g1").alias("lo"), F.greatest("g0", "g1").alias("hi"))
    sorted_ = F.sort_array(F.collect_list(one))
    rows = genes.groupBy("family_id").agg(sorted_.alias("g"))
    return rows.select("family_id", F.transform("g", lambda x: x["lo"] + 1).alias("low"), F.transform("g", lambda x: x["hi"] + 1).alias("high"))


def filtered(anchor_rows: DataFrame, bounds: DataFrame, test_end: bool = False) -> DataFrame:
    """Anchors in all sequences, all on one side of their genes and starting in none."""
    joined = anchor_rows.join(bounds, "family_id")
    spans = F.col("len") if test_end else None
    return joined.where(present_in_all(F.col("pos")) & same_side(F.col("pos"), F.col("low"), F.col("high")) & outside_gene(F.col("pos"), F.col("low"), F.col("high"), spans)).select(anchor_rows.columns)


def dedup_longest(rows: DataFrame) -> DataFrame:
    """Of anchors with the same positions the longest, the last of those."""
    order = Window.partitionBy("family_id", "pos").orderBy(F.desc("len"), F.desc("row_id"))
    return rows.withColumn("first", F.row_number().over(order)).where("first = 1").drop("first")


def serials(rows: DataFrame) -> DataFrame:
    return row_numbers(rows, ["family_id"], ["row_id"], "serial")


def funnel(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """How many anchors of each family pass each filter, one behind the other."""
    joined = rows.join(bounds, "family_id")
    present = present_in_all(F.col("pos"))
    side = present & same_side(F.col("pos"), F.col("low"), F.col("high"))
    out = side & outside_gene(F.col("pos"), F.col("low"), F.col("high"))
    return joined.groupBy("family_id").agg(F.count("*").alias("n_anchors"), F.count_if(present).alias("n_present"), F.count_if(side).alias("n_same_side"), F.count_if(out).alias("n_outside"))
