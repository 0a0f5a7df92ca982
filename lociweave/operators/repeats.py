"""Maximal repeats of sequence families by K-mer shuffles, neighbours in suffix order, and doubled classes.

Suffixes are cut at the first N, where repeats end anyway, and at `width` symbols. Equal cuts are counted first, so that
copies and runs of one symbol meet as one row each; repeats shorter than the width are then the common prefixes of
neighbours among the different cuts of a (family, K-mer). Where they occur is found through the cuts as well: a start
asks only for the prefixes that its neighbours share with it. Longer repeats are found by operators.longrepeats, from
classes of equal strings of doubling length: they are (sequence, start, length) until they have passed all filters.

Strict mode takes each sequence as a text of its own, with boundaries that match nothing. Literal mode takes a
family's sequences as one text with "#" behind each, lets repeats run across, and splits them there afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociweave.functions.sequences import ambiguous
from lociweave.operators import smallfamilies
from lociweave.operators.longrepeats import long_repeats
from lociweave.operators.storage import released, settled

#: Symbols of a suffix that are compared as a string; a power of two.
WIDTH = 32
#: Symbols of a chunk of text, and chunks that stay together when texts are dealt out.
CHUNK, TOGETHER = 64, 256
SHORT = 16
#: Pieces whose starts are found at once.
SLICE = 128


def check_k(k: int) -> None:
    if not isinstance(k, int) or k <= 0:
        raise ValueError("K must be a whole number above 0")


def _split(text: Column | str, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _before(parts: str, index: Column, edge: Column) -> Column:
    """The symbol before a part: the last one of the part before, or edge."""
    return F.when(index == 0, edge).otherwise(F.right(F.try_element_at(parts, index), F.lit(1)))


def _pieces(texts: DataFrame, k: int, width: int) -> DataFrame:
    """family_id, seq_idx, n, c, last, piece: stretches with the symbol before and width symbols behind, dealt out by their place."""
    check_k(k)
    size = CHUNK * TOGETHER
    split = texts.where(F.length("bases") >= k).select("family_id", "seq_idx", F.length("bases").alias("n"), _split("bases", size).alias("pieces"))
    piece = lambda c: F.concat(_before("pieces", c, F.lit("^")), F.try_element_at("pieces", c + 1), F.left(F.array_join(F.slice("pieces", c + 2, -(-width // size)), ""), F.lit(width)))
    pieces = split.select("family_id", "seq_idx", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - k) / size).cast("int")), piece)).alias("c", "piece"))
    last = F.least(F.lit(size), F.col("n") - k + 1 - F.col("c") * size)
    return pieces.repartition("family_id", "seq_idx", "c").select("family_id", "seq_idx", "n", "c", last.cast("int").alias("last"), "piece")


def clear_windows(texts: DataFrame, k: int, width: int) -> DataFrame:
    """family_id, seq_idx, pos, before and raw as windows() has them, of starts of k symbols without an N; raw ends with its first N.

    Symbols are single bytes, so that starts are found in a slice of pieces at once: where N are many, few become rows.
    """
    pieces = _pieces(texts, k, width).select("family_id", "seq_idx", (F.col("c") * (CHUNK * TOGETHER)).cast("int").alias("base"), "last", "piece")
    kind = {f.name: f.dataType for f in pieces.schema.fields}
    schema = T.StructType([T.StructField(c, d) for c, d in (("family_id", kind["family_id"]), ("seq_idx", kind["seq_idx"]), ("pos", T.IntegerType()), ("before", T.StringType()), ("raw", T.StringType()))])

    def found(rows: pa.RecordBatch) -> pa.RecordBatch:
        text = rows.column("piece").to_pylist()
        edge = np.concatenate([[0], np.cumsum([len(x) for x in text])])
        data = np.frombuffer("".join(text).encode("ascii"), dtype=np.uint8)
        stops = np.unique(np.concatenate([np.flatnonzero(data == ord("N")), edge[1:]]))
        # For each symbol, the next N or end of a piece; the first symbol of a piece is no start.
        room = np.repeat(stops, np.diff(stops, prepend=-1))[: len(data)] - np.arange(len(data))
        at = np.flatnonzero(room >= k)
        row = np.searchsorted(edge, at, side="right") - 1
        own = at - edge[row]
        kept = (own >= 1) & (own <= rows.column("last").to_numpy()[row])
        at, row, own = at[kept], row[kept], own[kept]
        end = at + room[at]
        ended = (room[at] < width) & (end < edge[row + 1])
        size = np.minimum(room[at], width) + ended
        offsets = np.concatenate([[0], np.cumsum(size)])
        raw = data[np.repeat(at - offsets[:-1], size) + np.arange(offsets[-1])]
        strings = lambda offsets, values: pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values))
        pick = pa.array(row)
        pos = (rows.column("base").to_numpy()[row] + own).astype(np.int32)
        columns = [rows.column("family_id").take(pick), rows.column("seq_idx").take(pick), pa.array(pos), strings(np.arange(len(at) + 1), data[at - 1]), strings(offsets, raw)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                yield found(batch.slice(k, SLICE))

    return pieces.mapInArrow(run, schema)


def windows(texts: DataFrame, k: int, width: int) -> DataFrame:
    """family_id, seq_idx, pos (1-based), before (the symbol before; "^" at the start), left (symbols from here to the end) and raw, up to width symbols, for each start of k symbols.

    Texts are split into pieces, which are dealt out by their place: a long text, or a file of one row group, is no single
    task. There they are split into short chunks, each read with what follows it, so that a start costs a short substring.
    """
    size = CHUNK * TOGETHER
    pieces = _pieces(texts, k, width)
    fine = pieces.select("family_id", "seq_idx", "n", (F.col("c") * size).alias("base"), "last", F.left("piece", F.lit(1)).alias("edge"), _split(F.substring("piece", 2, size + width), CHUNK).alias("chunks"))
    chunk = lambda f: F.concat(_before("chunks", f, F.col("edge")), F.array_join(F.slice("chunks", f + 1, 1 + -(-width // CHUNK)), ""))
    chunks = fine.select("family_id", "seq_idx", "n", "base", "last", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"(last - 1) div {CHUNK}").cast("int")), chunk)).alias("f", "part"))
    own = F.least(F.lit(CHUNK), F.col("last") - F.col("f") * CHUNK)
    at = F.sequence(F.lit(1), own.cast("int"))
    starts = chunks.select("family_id", "seq_idx", "n", "base", "f", "part", F.explode(at).alias("i"))
    pos = (F.col("base") + F.col("f") * CHUNK + F.col("i")).cast("int")
    return starts.select("family_id", "seq_idx", pos.alias("pos"), F.substring("part", F.col("i"), F.lit(1)).alias("before"), (F.col("n") - pos + 1).alias("left"), F.substring("part", F.col("i") + 1, F.lit(width)).alias("raw"))


def kmers(texts: DataFrame, k: int, keep_ambiguous: bool = False) -> DataFrame:
    """family_id, seq_idx, pos and kmer for each start of k symbols; those with an N only with keep_ambiguous."""
    rows = windows(texts, k, k) if keep_ambiguous else clear_windows(texts, k, k)
    return rows.select("family_id", "seq_idx", "pos", F.col("raw").alias("kmer"))


def kmer_counts(texts: DataFrame, ks: list[int]) -> DataFrame:
    """k, family_id and n_kmers, how many starts kmers() has, for several K in one pass: from the lengths of stretches without an N, no start is a row."""
    for k in ks:
        check_k(k)
    lengths = F.filter(F.transform(F.split("bases", "N"), lambda run: F.length(run)), lambda n: n >= min(ks))
    own = lambda k: F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + F.greatest(n - (k - 1), F.lit(0)))
    each = texts.select("family_id", lengths.alias("lengths")).where(F.size("lengths") > 0)
    sums = each.select("family_id", *(own(k).alias(f"k{k}") for k in ks)).groupBy("family_id").agg(*(F.sum(f"k{k}").alias(f"k{k}") for k in ks))
    by_k = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("n_kmers")) for k in ks))
    return sums.select("family_id", F.inline(by_k)).where("n_kmers > 0").select("k", "family_id", "n_kmers")


def suffixes(texts: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """family_id, seq_idx, pos (1-based), kmer, prev, suffix and behind for each start of k symbols without an N.

    texts: family_id, seq_idx, bases. The symbol before a sequence's first is a mark of its own. behind: half a width of
    what follows a suffix of the whole width; null if an N or the end comes before.
    """
    rows = clear_windows(texts, k, width + width // 2).withColumns({"kmer": F.substring("raw", 1, k), "more": F.expr(f"substring(raw, {width + 1})"), "raw": F.substring("raw", 1, width)})
    prev = F.when(F.col("before") == "^", F.concat(F.lit("^"), F.col("seq_idx").cast("string"))).otherwise(F.col("before"))
    whole = (F.length("raw") == width) & ~F.contains("raw", F.lit("N"))
    return rows.select("family_id", "seq_idx", "pos", "kmer", prev.alias("prev"), F.col("raw").alias("suffix"), F.when(whole, F.col("more")).alias("behind"))


def long_members(starts: DataFrame, cut: DataFrame, width: int) -> tuple[DataFrame, DataFrame] | None:
    """The starts whose whole window others share, and the symbols behind them, for longrepeats; None if there are none.

    A repeat of at least a window ends with a window that is shared too: what is behind members is all that is asked for.
    """
    shared = cut.where((F.col("n") > 1) & (F.length("suffix") == width) & ~F.contains("suffix", F.lit("N"))).select("family_id", "suffix", "first")
    if shared.isEmpty():
        return None
    rows = settled(starts.join(shared, ["family_id", "suffix"]).select("family_id", "seq_idx", "pos", "prev", "first", "behind"))
    return rows.drop("behind"), rows.select("family_id", "seq_idx", (F.col("pos") + width).alias("pos"), F.col("behind").alias("raw"))


def width_for(k: int, width: int = WIDTH) -> int:
    """The width in symbols, a power of two above K."""
    return max(width, 1 << k.bit_length())


def cuts(starts: DataFrame, width: int) -> DataFrame:
    """A row for each different cut suffix of a family: n, first (its least seq_idx and pos), lcp with the one before in order, and most.

    most: up to how many symbols another start agrees with those of this cut, below the width. Any order of the symbols
    gives neighbours the same common prefixes, so the plain one is taken.
    """
    # One number is summed up in hash tables; a struct would be sorted for it.
    packed = F.col("seq_idx").cast("long") * (1 << 32) + F.col("pos")
    each = starts.groupBy("family_id", "kmer", "suffix").agg(F.count("*").alias("n"), F.min(packed).alias("first"))
    each = each.withColumn("first", F.struct(F.shiftright("first", 32).cast("int").alias("seq_idx"), F.col("first").bitwiseAND((1 << 32) - 1).cast("int").alias("pos")))
    order = Window.partitionBy("family_id", "kmer").orderBy("suffix")
    near = each.withColumn("neighbour", F.lag("suffix").over(order)).withColumn("lcp", F.coalesce(common_prefix("suffix", "neighbour", width), F.lit(0))).drop("neighbour")
    own = F.when((F.col("n") > 1) & (F.length("suffix") < width), F.length("suffix")).otherwise(0)
    return near.withColumn("most", F.greatest("lcp", F.coalesce(F.lead("lcp").over(order), F.lit(0)), own))


def common_prefix(a: str, b: str, width: int) -> Column:
    """Length of the longest common prefix of two columns, at most width, by halving steps; null if either is."""

    def steps(most: int) -> Column:
        sizes, step = [], 1 << (max(1, most) - 1).bit_length()
        while step:
            sizes.append(F.lit(step))
            step //= 2
        longer = lambda n, s: (n + s <= F.length(a)) & (n + s <= F.length(b)) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s))
        return F.aggregate(F.array(*sizes), F.lit(0), lambda n, s: F.when(longer(n, s), n + s).otherwise(n))

    # Most neighbours part early: long steps are tried only where a short one holds.
    return F.when(F.col(b).isNotNull(), F.when(F.substring(a, 1, SHORT) == F.substring(b, 1, SHORT), steps(width)).otherwise(steps(SHORT)))


def short_words(cut: DataFrame, k: int, width: int) -> DataFrame:
    """family_id, kmer, word, len: the words below the width at which occurrences part; ends of sequences part from all."""
    parted = cut.where(F.col("lcp") >= k).select("family_id", "kmer", F.expr("substring(suffix, 1, lcp)").alias("word"))
    ended = cut.where((F.col("n") > 1) & (F.length("suffix") < width)).select("family_id", "kmer", F.col("suffix").alias("word"))
    return parted.unionByName(ended).distinct().where(~ambiguous(F.col("word"))).withColumn("len", F.length("word"))


def short_occurrences(words: DataFrame, cut: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """Where each short word occurs, with the symbols before and behind it; sequence boundaries are symbols of their own.

    Every cut asks for those of its prefixes that a neighbour shares: the join is on words, and grows with its result.
    """
    asked = cut.where(F.col("most") >= k).select("family_id", "suffix", F.explode(F.sequence(F.lit(k), "most")).alias("len"))
    asked = asked.withColumn("word", F.expr("substring(suffix, 1, len)"))
    known = asked.join(words.select("family_id", "word"), ["family_id", "word"], "left_semi").groupBy("family_id", "suffix").agg(F.collect_list("len").alias("lens"))
    at = starts.join(known, ["family_id", "suffix"]).select("family_id", "suffix", "seq_idx", "pos", "prev", F.explode("lens").alias("len"))
    behind = F.expr("substring(suffix, len + 1, 1)")
    end = F.concat(F.lit("#"), F.col("seq_idx").cast("string"))
    return at.select("family_id", F.expr("substring(suffix, 1, len)").alias("word"), "len", "seq_idx", "pos", "prev", F.when(behind == "", end).otherwise(behind).alias("next"))


def marked_words(texts: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """Where the right-maximal words occur: family_id, word, len, seq_idx, pos, prev and next. Long words of large families are marks, for spelled()."""
    check_k(k)
    small, large = smallfamilies.divided(texts)
    found = smallfamilies.occurrences(small, k)
    return settled(found if large is None else found.unionByName(shuffled_words(large, k, width)))


def shuffled_words(texts: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """The same for families of any size, by shuffles; long words are marks."""
    width = width_for(k, width)
    starts = settled(suffixes(texts, k, width))
    cut = settled(cuts(starts, width))
    words = short_words(cut, k, width)
    found = short_occurrences(words, cut, starts, k)
    known = long_members(starts, cut, width)
    if known is None:
        out = settled(found)
    else:
        long = long_repeats(*known, width)
        out = settled(found.unionByName(long))
        released(long, known[0])
    released(cut, starts)
    return out


def spelled(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with their long words as text, read once for each different one."""
    mark = F.col("word").startswith("=")
    part = F.split(F.substring("word", 2, 64), ":")
    marks = rows.where(mark).select("family_id", "word").distinct()
    marks = marks.select("family_id", "word", *(part[k].cast("int").alias(c) for k, c in enumerate(("seq_idx", "pos", "size"))))
    text = marks.join(texts.select("family_id", "seq_idx", "bases"), ["family_id", "seq_idx"]).select("family_id", "word", F.expr("substring(bases, pos, size)").alias("text"))
    return rows.join(text, ["family_id", "word"], "left").withColumn("word", F.coalesce("text", "word")).select(rows.columns)


def found_words(texts: DataFrame, k: int, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The right-maximal words (family_id, word, len), and where they occur, as text."""
    found = spelled(marked_words(texts, k, width), texts)
    return found.select("family_id", "word", "len").distinct(), found


def right_maximal(texts: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """family_id, kmer, word, len: the distinct words of at least k symbols at which occurrences part."""
    check_k(k)
    small, large = smallfamilies.divided(texts)
    found = smallfamilies.words(small, k)
    return found if large is None else found.unionByName(shuffled_right_maximal(large, k, width))


def shuffled_right_maximal(texts: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """The same for families of any size, by shuffles."""
    width = width_for(k, width)
    starts = suffixes(texts, k, width)
    cut = settled(cuts(starts, width))
    words = short_words(cut, k, width)
    known = long_members(starts, cut, width)
    if known is None:
        return words
    long = long_repeats(*known, width).select("family_id", "word", "len").distinct()
    long = spelled(long, texts).select("family_id", F.substring("word", 1, k).alias("kmer"), "word", "len")
    return words.unionByName(long)


def left_diverse(occurring: DataFrame) -> DataFrame:
    """family_id, word, prevs of the words that at least two different symbols precede."""
    sets = occurring.groupBy("family_id", "word").agg(F.array_sort(F.collect_set("prev")).alias("prevs"))
    return sets.where(F.size("prevs") >= 2)


def subsumed(occurring: DataFrame, words: DataFrame, literal: bool = False) -> DataFrame:
    """Words of which one extension has the same preceding symbols, at least two, as the word itself."""
    by_next = occurring.groupBy("family_id", "word", "next").agg(F.array_sort(F.collect_set("prev")).alias("prevs")).where(F.size("prevs") >= 2)
    if literal:
        by_next = by_next.where(F.col("prevs") != F.array(F.lit("$"), F.lit("A")))
    return by_next.join(words, ["family_id", "word", "prevs"]).select("family_id", "word").distinct()


def maximal_words(occurring: DataFrame) -> DataFrame:
    """family_id, word of the left-diverse words that are not subsumed, in one pass.

    The symbols before an extension are among those before the word: they are the same if there are as many.
    """
    by_next = occurring.groupBy("family_id", "word", "next").agg(F.collect_set("prev").alias("prevs"))
    sets = by_next.groupBy("family_id", "word").agg(F.max(F.size("prevs")).alias("most"), F.size(F.array_distinct(F.flatten(F.collect_list("prevs")))).alias("n"))
    return sets.where("n >= 2 and most < n").select("family_id", "word")


def maximal_repeats(texts: DataFrame, k: int, suppress_subsumed: bool = True, width: int = WIDTH) -> DataFrame:
    """Occurrences (family_id, word, len, seq_idx, pos) of the repeats that neither side extends."""
    check_k(k)
    small, large = smallfamilies.divided(texts)
    found = smallfamilies.occurrences(small, k, "maximal" if suppress_subsumed else "diverse")
    return settled(found if large is None else found.unionByName(shuffled_repeats(large, k, suppress_subsumed, width)))


def shuffled_repeats(texts: DataFrame, k: int, suppress_subsumed: bool = True, width: int = WIDTH) -> DataFrame:
    """The same for families of any size, by shuffles."""
    found = shuffled_words(texts, k, width)
    kept = maximal_words(found) if suppress_subsumed else left_diverse(found)
    rows = found.join(kept.select("family_id", "word"), ["family_id", "word"], "left_semi")
    out = settled(spelled(rows, texts).select("family_id", "word", "len", "seq_idx", "pos"))
    released(found)
    return out


def boundary_split(words: DataFrame, k: int, literal: bool = False) -> DataFrame:
    """family_id, word, part, side, shift: the halves of words that run across sequence boundaries, and plain words.

    Literal: cut at the first boundary only, and the right half counts the boundary in its length.
    """
    at = F.locate("#", F.col("word"))
    plain = words.where(at == 0).select("family_id", "word", F.col("word").alias("part"), F.lit(0).alias("side"), F.lit(0).alias("shift"))
    crossing = words.where(at > 0)
    if literal:
        left = crossing.where(at - 1 >= k).select("family_id", "word", F.expr("substring(word, 1, locate('#', word) - 1)").alias("part"), F.lit(0).alias("side"), F.lit(0).alias("shift"))
        right = crossing.where(F.length("word") - at + 1 >= k).select("family_id", "word", F.expr("substring(word, locate('#', word) + 1, length(word))").alias("part"), F.lit(1).alias("side"), at.alias("shift"))
        return plain.unionByName(left).unionByName(right)
    pieces = crossing.select("family_id", "word", F.posexplode(F.split("word", "#")).alias("side", "part"))
    shift = F.expr("length(substring_index(word, '#', side))") + F.when(F.col("side") > 0, 1).otherwise(0)
    return plain.unionByName(pieces.where(F.length("part") >= k).select("family_id", "word", "part", "side", shift.alias("shift")))


def kmer_pairs(starts: DataFrame) -> DataFrame:
    """All pairs of starts with the same K-mer, on diagonals: family_id, two sequences and positions.

    Starts are many more than Spark takes them for by the size of their texts: they are merged, never broadcast.
    """
    a = starts.select("family_id", "kmer", F.col("seq_idx").alias("seq_a"), F.col("pos").alias("pos_a"))
    b = starts.select("family_id", "kmer", F.col("seq_idx").alias("seq_b"), F.col("pos").alias("pos_b"))
    return a.hint("merge").join(b.hint("merge"), ["family_id", "kmer"]).where("seq_a < seq_b")


def seed_counts(starts: DataFrame) -> DataFrame:
    """How many such pairs any two sequences have, from counts; no pair is made."""
    counts = settled(starts.groupBy("family_id", "kmer", "seq_idx").agg(F.count("*").alias("n")))
    a = counts.select("family_id", "kmer", F.col("seq_idx").alias("seq_a"), F.col("n").alias("n_a"))
    b = counts.select("family_id", "kmer", F.col("seq_idx").alias("seq_b"), F.col("n").alias("n_b"))
    joined = a.join(b, ["family_id", "kmer"]).where("seq_a < seq_b")
    return joined.groupBy("family_id", "seq_a", "seq_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n_seeds"))


def extensions(pairs: DataFrame, k: int) -> DataFrame:
    """Islands of neighbouring pairs on a diagonal: their start in both sequences and the length of the match."""
    diagonal = ["family_id", "seq_a", "seq_b", F.col("pos_b") - F.col("pos_a")]
    serial = F.row_number().over(Window.partitionBy(*diagonal).orderBy("pos_a"))
    islands = pairs.withColumn("island", F.col("pos_a") - serial).withColumn("diagonal", F.col("pos_b") - F.col("pos_a"))
    return islands.groupBy("family_id", "seq_a", "seq_b", "diagonal", "island").agg(F.min("pos_a").alias("pos_a"), F.min("pos_b").alias("pos_b"), (F.count("*") + k - 1).alias("len")).drop("diagonal", "island")


def island_edges(starts: DataFrame, beside: str) -> DataFrame:
    """Pairs of starts with the same K-mer in two sequences and other symbols beside them; an N, or none, differs from all.

    A start asks for those sequences and symbols that its K-mer is known with: the join grows with its result.
    """
    cell = F.struct(F.col("seq_idx").alias("seq_a"), F.col(beside).alias("beside"))
    cells = starts.groupBy("family_id", "kmer").agg(F.collect_set(cell).alias("cells")).where(F.size("cells") > 1)
    differs = lambda c: (c["seq_a"] < F.col("seq_idx")) & ((c["beside"] != F.col(beside)) | F.col(beside).isin("", "N"))
    asked = starts.hint("merge").join(cells.hint("merge"), ["family_id", "kmer"])
    asked = asked.select("family_id", "kmer", F.col("seq_idx").alias("seq_b"), F.col("pos").alias("pos_b"), F.inline(F.filter("cells", differs)))
    a = starts.select("family_id", "kmer", F.col("seq_idx").alias("seq_a"), F.col(beside).alias("beside"), F.col("pos").alias("pos_a"))
    pairs = a.hint("merge").join(asked.hint("merge"), ["family_id", "kmer", "seq_a", "beside"])
    return pairs.select("family_id", "seq_a", "seq_b", F.col("pos_a").cast("long").alias("pos_a"), F.col("pos_b").cast("long").alias("pos_b"))


def islands(texts: DataFrame, k: int) -> DataFrame:
    """family_id, seq_a, seq_b, pos_a, pos_b, len: stretches of at least k symbols without an N that two sequences share, as long as they go."""
    check_k(k)
    small, large = smallfamilies.divided(texts.where("family_id is not null and seq_idx is not null"))
    found = smallfamilies.islands(small, k)
    return found if large is None else found.unionByName(shuffled_islands(large, k))


def shuffled_islands(texts: DataFrame, k: int) -> DataFrame:
    """The same for families of any size, by shuffles: islands from where they begin and end, which take turns on a diagonal.

    Where a (family_id, seq_idx) is repeated, they do not: there islands are what all pairs on a diagonal give when they are numbered.
    """
    again = texts.groupBy("family_id", "seq_idx").count().where("count > 1")
    again = settled(again.select(F.col("family_id").alias("_again")).distinct())
    same = F.col("family_id") == F.col("_again")
    single = texts.join(again, same, "left_anti")
    starts = clear_windows(single, k, k + 1).select(
        "family_id", "seq_idx", "pos", F.substring("raw", 1, k).alias("kmer"), F.when(F.col("pos") == 1, "").otherwise(F.col("before")).alias("before"), F.expr(f"substring(raw, {k + 1}, 1)").alias("behind")
    )
    starts = settled(starts)
    edges = island_edges(starts, "before").withColumn("ends", F.lit(0)).unionByName(island_edges(starts, "behind").withColumn("ends", F.lit(1)))
    diagonal = Window.partitionBy("family_id", "seq_a", "seq_b", F.col("pos_b") - F.col("pos_a")).orderBy("pos_a", "ends")
    found = edges.withColumn("last", F.lead("pos_a").over(diagonal)).where("ends = 0").withColumn("len", F.col("last") - F.col("pos_a") + k).drop("last", "ends")
    if not again.isEmpty():
        numbered = extensions(kmer_pairs(kmers(texts.join(again, same, "left_semi"), k)), k)
        found = found.unionByName(numbered.withColumns({c: F.col(c).cast("long") for c in ("pos_a", "pos_b")}))
    out = settled(found)
    released(starts)
    return out
