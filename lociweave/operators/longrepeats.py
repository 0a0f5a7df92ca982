"""Repeats longer than a window, as (sequence, start, length), from classes of equal strings of doubling length.

Level 0 are the starts that share a window of `width` symbols, each with its class: the first start of the same string.
Two classes side by side name a string of twice the length; starts whose doubled string is no other's leave. That goes on
until no start is left, so the number of levels is that of the longest repeat, and a level is as large as its repeats.

Words between one level's length and the next are then found by a descent. A node is a string, with the starts where it
stands; it is tried with the classes of the next lower level behind it. If all starts agree, the node grows; if not,
they part somewhere within, and the node stays for shorter steps, while every class behind it that two starts share
becomes a node of its own. Below the width, symbols themselves are tried. Nodes that part at the next symbol are the
words, and their starts the occurrences. All keys are nodes or starts; sums of a node come from partial ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.operators.storage import released, settled

#: Before what is behind a start where the text ends or nothing is shared: such a mark is no other start's.
ALONE = "~"
NODE = ["family_id", "node", "len"]


def _levels(members: DataFrame, width: int) -> list[DataFrame]:
    """family_id, seq_idx, pos, class: the starts of each level."""
    first = members.select("family_id", "seq_idx", "pos", F.struct(F.col("first.seq_idx").alias("s"), F.col("first.pos").alias("p")).alias("class"))
    out, length = [settled(first)], width
    while True:
        low = out[-1]
        behind = low.select("family_id", "seq_idx", (F.col("pos") - length).alias("pos"), F.col("class").alias("second"))
        pairs = low.join(behind, ["family_id", "seq_idx", "pos"])
        named = pairs.groupBy("family_id", "class", "second").agg(F.count("*").alias("n"), F.min(F.struct(F.col("seq_idx").alias("s"), F.col("pos").alias("p"))).alias("own")).where("n > 1")
        high = settled(pairs.join(named, ["family_id", "class", "second"]).select("family_id", "seq_idx", "pos", F.col("own").alias("class")))
        if high.isEmpty():
            released(high)
            return out
        out.append(high)
        length *= 2


def _nodes(level: DataFrame, length: int) -> DataFrame:
    return level.select("family_id", F.col("class").alias("node"), F.lit(length).alias("len"), "seq_idx", "pos")


def _behind(active: DataFrame, level: DataFrame) -> DataFrame:
    """active with x, the class of the level behind the node, as text."""
    at = level.select("family_id", "seq_idx", F.col("pos").alias("at"), F.concat_ws(":", F.col("class.s").cast("string"), F.col("class.p").cast("string")).alias("x"))
    own = F.concat_ws(":", F.lit(ALONE), F.col("seq_idx").cast("string"), F.col("pos").cast("string"))
    return active.withColumn("at", F.col("pos") + F.col("len")).join(at, ["family_id", "seq_idx", "at"], "left").withColumn("x", F.coalesce("x", own)).drop("at")


def _symbols(active: DataFrame, symbols: DataFrame, size: int) -> DataFrame:
    """active with x, the size symbols behind the node, up to an N; a text that ends before them is shared with none."""
    cut = F.when(F.contains("raw", F.lit("N")), F.concat(F.substring_index("raw", "N", 1), F.lit("N"))).otherwise(F.col("raw"))
    at = symbols.select("family_id", "seq_idx", F.col("pos").alias("at"), F.substring(cut, 1, size).alias("x"))
    own = F.concat_ws(":", F.lit(ALONE), F.col("seq_idx").cast("string"), F.col("pos").cast("string"))
    joined = active.withColumn("at", F.col("pos") + F.col("len")).join(at, ["family_id", "seq_idx", "at"], "left").drop("at")
    return joined.withColumn("x", F.when(F.col("x").isNull() | ((F.length("x") < size) & ~F.contains("x", F.lit("N"))), own).otherwise(F.col("x")))


def _parting(tried: DataFrame) -> DataFrame:
    """The nodes behind which not all starts agree."""
    return tried.groupBy(*NODE).agg(F.min("x").alias("low"), F.max("x").alias("high")).where("low <> high").select(*NODE)


def _step(tried: DataFrame, size: int) -> DataFrame:
    """Nodes that stay, as what is behind their starts differs, and nodes longer by size that two starts share."""
    children = tried.where(~F.col("x").startswith(ALONE) & ~F.contains("x", F.lit("N"))).groupBy(*NODE, "x")
    shared = children.agg(F.count("*").alias("n"), F.min(F.struct(F.col("seq_idx").alias("s"), F.col("pos").alias("p"))).alias("own")).where("n > 1").drop("n")
    stay = tried.join(_parting(tried), NODE, "left_semi").select(*NODE, "seq_idx", "pos")
    grown = tried.join(shared, [*NODE, "x"]).select("family_id", F.col("own").alias("node"), (F.col("len") + size).alias("len"), "seq_idx", "pos")
    return stay.unionByName(grown)


def long_repeats(members: DataFrame, symbols: DataFrame, width: int) -> DataFrame:
    """family_id, word (a mark of sequence, start and length), len, seq_idx, pos, prev, next of words of at least width symbols.

    members: family_id, seq_idx, pos, prev and first (seq_idx and pos of the first start with the same window) of the starts
    that share their window; symbols: family_id, seq_idx, pos and raw, at least width / 2 symbols of each start; width: a power of two.
    """
    levels = _levels(members, width)
    active = None

    def entered(k: int, rows: DataFrame | None) -> DataFrame:
        new = _nodes(levels[k], width << k)
        return new if rows is None else rows.unionByName(new)

    for k in range(len(levels) - 2, -1, -1):
        tried = settled(_behind(entered(k + 1, active), levels[k]))
        done, active = active, settled(_step(tried, width << k))
        released(done, tried)
    size = width // 2
    active, done = entered(0, active), active
    while size:
        tried = settled(_symbols(active, symbols, size))
        released(done)
        active = done = settled(_step(tried, size))
        released(tried)
        size //= 2
    tried = settled(_symbols(active, symbols, 1))
    prev = members.select("family_id", "seq_idx", "pos", "prev")
    word = F.concat_ws(":", F.concat(F.lit("="), F.col("node.s").cast("string")), F.col("node.p").cast("string"), F.col("len").cast("string"))
    following = F.when(F.col("x").startswith(ALONE), F.concat(F.lit("#"), F.col("seq_idx").cast("string"))).otherwise(F.col("x"))
    out = tried.join(_parting(tried), NODE, "left_semi").join(prev, ["family_id", "seq_idx", "pos"])
    out = settled(out.select("family_id", word.alias("word"), "len", "seq_idx", "pos", "prev", following.alias("next")))
    released(done, tried, *levels)
    return out
