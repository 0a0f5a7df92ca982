"""Numbers within groups of any size: rows are sorted over range partitions, and what partitions before hold is added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.operators.storage import settled


def in_ranges(rows: DataFrame, keys: list) -> DataFrame:
    """rows sorted by keys over range partitions, with _part and _serial, which rise in that order. A hot group fills several partitions."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return placed.withColumns({"_part": F.spark_partition_id(), "_serial": F.monotonically_increasing_id()})


def row_numbers(rows: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """rows with name, from 1 in each group by order, which must be total.

    A partition numbers its own rows of a group; only its first group can have begun in a partition before, so that the
    counts to add are a row a partition at most, and are broadcast.
    """
    placed = settled(in_ranges(rows, [*group, *order]))
    counts = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("_before", F.sum("_n").over(earlier)).where("_before is not null").drop("_n")
    own = F.row_number().over(Window.partitionBy("_part", *group).orderBy("_serial"))
    joined = placed.withColumn("_own", own).join(F.broadcast(carried), ["_part", *group], "left")
    return joined.withColumn(name, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long")).select(*rows.columns, name)
