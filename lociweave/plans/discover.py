"""The whole discovery plan: sequences and genes in, shared order-consistent matches with genome coordinates out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lociweave.functions.sequences import normalize, oriented, outside_gene, present_in_all, rank_key, same_side
from lociweave.operators import anchors as A
from lociweave.operators import chain as C
from lociweave.operators import coordinates as X
from lociweave.operators import repeats as R
from lociweave.operators.storage import settled


def prepared(sequences: DataFrame, genes: DataFrame, soft_mask: bool = True) -> DataFrame:
    """family_id, seq_idx, bases (normalised and turned to the gene's strand), len."""
    strands = genes.select("family_id", "seq_idx", "strand")
    joined = sequences.join(strands, ["family_id", "seq_idx"])
    bases = oriented(normalize(F.col("bases"), soft_mask), F.col("strand"))
    return joined.select("family_id", "seq_idx", bases.alias("bases"), F.length("bases").cast("long").alias("len"))


def check(sequences: DataFrame, genes: DataFrame) -> None:
    """Strict mode takes + and - strands only, and a gene for each sequence and a sequence for each gene."""
    wrong = genes.where(~F.col("strand").isin("+", "-") | F.col("strand").isNull()).limit(1).count()
    if wrong:
        raise ValueError("strands must be + or -")
    keys = ["family_id", "seq_idx"]
    lone = sequences.select(*keys).join(genes.select(*keys), keys, "left_anti").unionByName(genes.select(*keys).join(sequences.select(*keys), keys, "left_anti"))
    found = lone.first()
    if found:
        raise ValueError(f"family {found.family_id}: sequence {found.seq_idx} and its gene are not both there")


def by_name(sequences: DataFrame, genes: DataFrame) -> DataFrame:
    """genes with the seq_idx of the sequence of the same name; names that occur once on each side only are taken, others fail."""
    both = sequences.select("family_id", "name", F.col("seq_idx").alias("own")).join(genes.withColumnRenamed("gene", "name"), ["family_id", "name"], "full")
    counted = both.withColumn("times", F.count("*").over(Window.partitionBy("family_id", "name")))
    wrong = counted.where(F.col("own").isNull() | F.col("seq_idx").isNull() | (F.col("times") > 1)).first()
    if wrong:
        raise ValueError(f"family {wrong.family_id}: the name {wrong.name} does not match one sequence and one gene")
    return both.select("family_id", F.col("own").alias("seq_idx"), F.col("name").alias("gene"), *(c for c in genes.columns if c not in ("family_id", "seq_idx", "gene")))


def sided(found: DataFrame, frames: DataFrame) -> DataFrame:
    """Occurrences outside their genes, with the side they are on: 0 before the gene, 1 behind it."""
    bounds = frames.select("family_id", "seq_idx", (F.least("g0", "g1") + 1).alias("low"), (F.greatest("g0", "g1") + 1).alias("high"))
    joined = found.join(bounds, ["family_id", "seq_idx"]).where((F.col("pos") < F.col("low")) | (F.col("pos") > F.col("high")))
    return joined.withColumn("side", (F.col("pos") > F.col("high")).cast("int")).drop("low", "high")


class Diagnostics:
    """Counts that are taken while tables are written, and read once they are: no table is read a second time for them."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation | None] = {}

    def watch(self, rows: DataFrame, name: str, *values: Column) -> DataFrame:
        """rows, written here once, with their number and the given aggregates under name.

        A plan that reads rows twice would count them twice, and one that is found to be empty counts nothing: such a table has 0 rows.
        """
        seen = Observation(name)
        out = settled(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *values))
        self.seen[name] = None if out.isEmpty() else seen
        return out

    def read(self) -> dict[str, dict]:
        """The counts of all tables, by name."""
        return {name: {"rows": 0} if seen is None else seen.get for name, seen in self.seen.items()}


def strict_anchors(texts: DataFrame, frames: DataFrame, k: int, suppress_subsumed: bool = True, test_end: bool = False, repeats: DataFrame | None = None, diagnostics: Diagnostics | None = None) -> DataFrame:
    """family_id, row_id, word, len, pos: what passes all filters. Each filter comes before the products where it can.

    repeats: the maximal repeats, where they are there already; those of a lower K hold all of a higher one.
    """
    watch = diagnostics.watch if diagnostics else lambda rows, *_: rows
    sizes = texts.groupBy("family_id").agg(F.count("*").cast("int").alias("n"))
    repeats = R.maximal_repeats(texts, k, suppress_subsumed) if repeats is None else repeats.where(F.col("len") >= k)
    repeats = watch(repeats, "repeats", F.max("len").alias("longest"))
    found = watch(sided(repeats, frames), "outside_genes")
    by_side = found.select("family_id", F.concat_ws("/", "word", "side").alias("word"), "len", "seq_idx", "pos")
    rows = A.anchors(by_side, sizes).withColumns({"side": F.substring_index("word", "/", -1).cast("int"), "word": F.substring_index("word", "/", 1)})
    rows = watch(rows, "anchors")
    rows = A.numbered(rows.withColumn("ordinal", F.col("side").cast("long") * (1 << 40) + F.col("ordinal")))
    if test_end:
        bounds = A.gene_arrays(frames)
        rows = rows.join(bounds, "family_id").where(outside_gene(F.col("pos"), F.col("low"), F.col("high"), F.col("len")))
    return rows.select("family_id", "row_id", "word", "len", "pos")


def literal_anchors(texts: DataFrame, frames: DataFrame, k: int) -> DataFrame:
    """All anchor rows of literal mode, absent sequences as 0, in its row order; nothing is filtered yet.

    The sequences of a family are one text; positions count one more for each sequence before.
    """
    one = F.struct("seq_idx", "bases")
    whole = texts.groupBy("family_id").agg(F.sort_array(F.collect_list(one)).alias("s"))
    joined = whole.select("family_id", F.lit(0).alias("seq_idx"), F.concat(F.array_join(F.transform("s", lambda x: F.concat(x["bases"], F.lit("#"))), ""), F.lit("$")).alias("bases"))
    found = R.marked_words(joined, k).withColumn("prev", F.when(F.col("prev").startswith("^"), "$").otherwise(F.col("prev")))
    kept = R.left_diverse(found)
    kept = kept.join(R.subsumed(found, kept, literal=True), ["family_id", "word"], "left_anti").select("family_id", "word")
    found = settled(R.spelled(found.join(kept, ["family_id", "word"], "left_semi"), joined))
    halves = R.boundary_split(found.select("family_id", "word").distinct(), k, literal=True)
    at = X.global_starts(texts.select("family_id", "seq_idx", (F.col("len") + 1).alias("len"))).select("family_id", "seq_idx", "start", F.col("len").alias("room"))
    placed = halves.join(found.select("family_id", "word", "pos"), ["family_id", "word"]).withColumn("at", F.col("pos") + F.col("shift"))
    placed = X.local_positions(placed, at)
    local = placed.select("family_id", F.concat_ws("/", "word", "side", "part").alias("word"), F.length("part").alias("len"), "seq_idx", X.literal_position((F.col("at") - F.col("start")).cast("int"), F.col("seq_idx")).alias("pos"))
    sizes = texts.groupBy("family_id").agg(F.count("*").cast("int").alias("n"))
    rows = A.anchors(local, sizes, all_sequences=False).withColumn("pos", F.transform("pos", lambda x: F.coalesce(x, F.lit(0))))
    parts = F.split("word", "/")
    order = Window.partitionBy("family_id").orderBy(rank_key(parts[0]), parts[1], "ordinal")
    return rows.select("family_id", (F.row_number().over(order) - 1).cast("long").alias("row_id"), parts[2].alias("word"), "len", "pos")


def literal_filtered(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Literal mode compares its positions with 0-based gene offsets, in the order they are given."""
    one = F.struct("seq_idx", "g0", "g1")
    g = frames.groupBy("family_id").agg(F.sort_array(F.collect_list(one)).alias("g"))
    g = g.select("family_id", F.transform("g", lambda x: x["g0"]).alias("low"), F.transform("g", lambda x: x["g1"]).alias("high"))
    pos = F.col("pos")
    return rows.join(g, "family_id").where(present_in_all(pos) & same_side(pos, F.col("low"), F.col("high")) & outside_gene(pos, F.col("low"), F.col("high"))).select(rows.columns)


def literal_dedup(all_rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Literal mode numbers the kept rows anew to find duplicates, but drops the rows that had those numbers before."""
    compact = kept.withColumn("c", F.row_number().over(Window.partitionBy("family_id").orderBy("row_id")) - 1)
    best = Window.partitionBy("family_id", "pos").orderBy(F.desc("len"), F.desc("c"))
    doomed = compact.withColumn("first", F.row_number().over(best)).where("first > 1").select("family_id", F.col("c").cast("long").alias("row_id"))
    return kept.join(doomed, ["family_id", "row_id"], "left_anti").select(kept.columns)


def discover(sequences: DataFrame, genes: DataFrame, k: int, mode: str = "strict", suppress_subsumed: bool = True, test_end: bool = False, soft_mask: bool = True, repeats: DataFrame | None = None, diagnostics: Diagnostics | None = None) -> dict[str, DataFrame]:
    """anchors, mem (deduplicated), chain and cns of all families in one job.

    With diagnostics, sequences, repeats, occurrences outside genes, anchors, mem and cns are counted while they pass.
    """
    R.check_k(k)
    if mode not in ("strict", "literal"):
        raise ValueError("mode is strict or literal")
    watch = diagnostics.watch if diagnostics else lambda rows, *_: rows
    sequences = watch(sequences, "sequences", F.sum("len").alias("symbols"), F.max("len").alias("longest"))
    texts = prepared(sequences, genes, soft_mask)
    frames = X.gene_frames(texts, genes)
    if mode == "strict":
        check(sequences, genes)
        rows = strict_anchors(texts, frames, k, suppress_subsumed, test_end, repeats, diagnostics)
        mem = A.dedup_longest(rows)
    else:
        every = watch(literal_anchors(texts, frames, k), "anchors")
        rows = literal_filtered(every, frames)
        mem = literal_dedup(every, rows)
    chain = C.best_chains(rows)
    words = rows.select("family_id", "row_id", "word")
    cns = X.absolute(chain.join(words, ["family_id", "row_id"]), frames, literal=mode == "literal")
    return {"anchors": rows, "mem": watch(mem, "mem"), "chain": chain, "cns": watch(cns, "cns"), "texts": texts, "frames": frames}


def shared_repeats(sequences: DataFrame, genes: DataFrame, ks: list[int], suppress_subsumed: bool = True, soft_mask: bool = True) -> DataFrame:
    """The maximal repeats of the least K, which hold those of all others: whether a repeat is maximal does not depend on K."""
    if not ks:
        raise ValueError("no K given")
    return R.maximal_repeats(prepared(sequences, genes, soft_mask), min(ks), suppress_subsumed)


def discover_many(sequences: DataFrame, genes: DataFrame, ks: list[int], **options) -> DataFrame:
    """cns of several K. In strict mode repeats are found once, for the least of them."""
    if not ks:
        raise ValueError("no K given")
    for k in ks:
        R.check_k(k)
    repeats = None
    if options.get("mode", "strict") == "strict":
        repeats = shared_repeats(sequences, genes, ks, options.get("suppress_subsumed", True), options.get("soft_mask", True))
    out = None
    for k in ks:
        own = discover(sequences, genes, k, repeats=repeats, **options)["cns"].withColumn("k", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out
