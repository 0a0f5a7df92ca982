"""Cutting lineage where a result is read several times: tables in the folder that all executors share, and their end."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset and driver and executor are one process."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{os.path.join(tempfile.gettempdir(), 'lociweave-tables')}"
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _at_exit() -> None:
    for path, spark in list(_kept.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session is gone already: nothing can be deleted through it
            return


def settled(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder and read back. It lasts until released, or until the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def kept_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files of another format; it lasts until the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _kept[path] = spark
    return path


def released(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()} if table is not None else ():
            for path in [p for p in _kept if folder.endswith(p.split("://")[-1])]:
                _delete(_kept.pop(path), path)
