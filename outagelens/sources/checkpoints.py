"""Cut a long lineage through the shared folder of the session, and keep what a session has stored."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or that the session has been given; all executors must see it.

    Only a local session, whose executors are the driver, gets a temporary folder where none is named.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="outagelens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def checkpointed(df: DataFrame) -> DataFrame:
    """The table read back from the checkpoint folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """The table written once as Parquet below the shared folder, and read back with column pruning.

    With `by`, files hold one value of that column each, and a filter on it reads only theirs.
    The folder goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    place, system = _path(spark, path)
    system.deleteOnExit(place)
    if by is None:
        return spark.read.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{name}`" for name in df.columns])


_kept: WeakKeyDictionary = WeakKeyDictionary()


def source_state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the files of a folder of tables; another state when a table is written anew."""
    place, system = _path(spark, folder)
    listed = []
    for table in system.listStatus(place):
        files = system.listStatus(table.getPath()) if table.isDirectory() else [table]
        listed += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(sorted(listed))


def kept(spark: SparkSession, folder: str, name: str, make: Callable):
    """make(), once in a session for each name and state of the folder's tables; forgotten with the session."""
    held, key, state = _kept.setdefault(spark, {}), (folder, name), source_state(spark, folder)
    if key not in held or held[key][0] != state:
        held[key] = (state, make())
    return held[key][1]
