"""From positions in oriented sequences to genome coordinates, and between global and local positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions.sequences import absolute_start, gene_offset
from lociweave.operators.numbering import in_ranges
from lociweave.operators.storage import settled


def framed(rows: DataFrame) -> DataFrame:
    """Genes that have their sequence's len, with 0-based gene offsets within the oriented sequence."""
    offset = lambda c: gene_offset(F.col(c), F.col("region_start"), F.col("len"), F.col("strand"))
    return rows.withColumn("g0", offset("gene_start")).withColumn("g1", offset("gene_end"))


def gene_frames(sequences: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes joined with their sequences by order, framed."""
    return framed(genes.join(sequences.select("family_id", "seq_idx", "len"), ["family_id", "seq_idx"]))


def absolute(chain: DataFrame, frames: DataFrame, literal: bool = False) -> DataFrame:
    """chain with abs_pos and chr, arrays by sequence."""
    one = F.struct("seq_idx", "region_start", F.col("len").alias("n"), "strand", "chr")
    arrays = frames.groupBy("family_id").agg(F.sort_array(F.collect_list(one)).alias("g"))
    joined = chain.join(arrays, "family_id")
    placed = F.zip_with("pos", "g", lambda x, g: absolute_start(x, F.col("len"), g["n"], g["region_start"], g["strand"], literal))
    return joined.withColumn("abs_pos", placed).withColumn("chr", F.transform("g", lambda g: g["chr"])).drop("g")


def global_starts(sequences: DataFrame) -> DataFrame:
    """Where each sequence starts in its family's sequences put one behind the other (0-based)."""
    before = Window.partitionBy("family_id").orderBy("seq_idx").rowsBetween(Window.unboundedPreceding, -1)
    return sequences.withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0)))


def literal_position(position: Column, seq_idx: Column) -> Column:
    """The position as reported when boundaries are not taken off: one more for each sequence before."""
    return position + seq_idx


def local_positions(positions: DataFrame, starts: DataFrame) -> DataFrame:
    """positions (family_id, at: 1-based, and others) with the seq_idx, start and room of the sequence that each lies in.

    starts: family_id, seq_idx, start (0-based), room. Both are sorted together over range partitions, and each position
    takes the last start before it; what a partition's first family has begun in partitions before is a row for each of
    them. Positions beyond their sequence's room, or before the first start, are left out.
    """
    names = [c for c in positions.columns if c not in ("family_id", "at")]
    one = F.struct("seq_idx", "start", "room")
    own = F.struct(*names) if names else F.struct(F.lit(0).alias("none"))
    asked = positions.select("family_id", F.col("at").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("seq_idx"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("room"), own.alias("own"))
    whole = lambda c: F.col(c).cast("long").alias(c)
    marks = starts.select("family_id", (F.col("start") + 1).cast("long").alias("at"), F.lit(0).alias("kind"), F.col("seq_idx").cast("int").alias("seq_idx"), whole("start"), whole("room"), F.lit(None).cast(asked.schema["own"].dataType).alias("own"))
    # Of sequences without room, several start at one place: the last one has it.
    placed = settled(in_ranges(marks.unionByName(asked), ["family_id", "at", "kind", "seq_idx"]))
    mark = F.when(F.col("kind") == 0, one)
    last = placed.where("kind = 0").groupBy("_part", "family_id").agg(F.max(F.struct("at", "seq_idx", "start", "room")).alias("m"))
    parts = placed.select("_part", "family_id").distinct().join(last, ["_part", "family_id"], "left")
    earlier = Window.partitionBy("family_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("c", F.last("m", ignorenulls=True).over(earlier)).where("c is not null").select("_part", "family_id", F.struct("c.seq_idx", "c.start", "c.room").alias("c"))
    up_to = Window.partitionBy("_part", "family_id").orderBy("_serial").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("s", F.last(mark, ignorenulls=True).over(up_to)).where("kind = 1").join(F.broadcast(carried), ["_part", "family_id"], "left")
    s = F.coalesce("s", "c")
    rows = found.select("family_id", "at", *(F.col(f"own.`{c}`").alias(c) for c in names), s["seq_idx"].alias("seq_idx"), s["start"].alias("start"), s["room"].alias("room"))
    return rows.where(F.col("at") <= F.col("start") + F.col("room"))
