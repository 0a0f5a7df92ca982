"""Connected components by alternating large and small stars, all on shuffles of link rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import Scratch

#: Links that a task holds while it leaves out those that close rings.
HELD = 200_000


def _forest(links: DataFrame) -> DataFrame:
    """The same components with fewer links: those within a task become stars, without a shuffle."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        lead = np.arange(len(nodes))
        while True:
            x, y = lead[a], lead[b]
            if (x == y).all():
                break
            np.minimum.at(lead, np.maximum(x, y), np.minimum(x, y))
            while (lead[lead] != lead).any():
                lead = lead[lead]
        out = np.flatnonzero(lead != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[lead[out]])], ["u", "v"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((np.asarray(batch.column("u")), np.asarray(batch.column("v"))))
            if sum(len(u) for u, _ in held) >= HELD:
                yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        if held:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null").mapInArrow(step, "u long, v long")


def _linked(links: DataFrame) -> DataFrame:
    return links.where(F.col("u") != F.col("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _linked(joined.unionByName(least.select("u", F.col("m").alias("v"))))


def _settled(links: DataFrame) -> bool:
    """Every node has one link at most, to a node that has none."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where("down > 1 or down > 0 and up > 0").isEmpty()


def components(links: DataFrame, scratch: Scratch | None = None, most_rounds: int = 60) -> DataFrame:
    """node and its component's smallest node, for every node of links (columns u, v) that isn't itself the smallest.

    Links with a null end are none.
    """
    scratch = scratch or Scratch()
    links = scratch.put(_forest(links), "links")
    links = scratch.put(_linked(links), "links")
    for _ in range(most_rounds):
        if _settled(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        following = scratch.put(_small_star(_large_star(links)), "links")
        scratch.drop(links)
        links = following
    raise RuntimeError("the components did not settle")
