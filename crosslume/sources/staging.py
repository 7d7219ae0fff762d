"""Intermediate tables that are used more than once, or end a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def stage_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local session may go without: it gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="crosslume-")
    return _local_dirs[context.applicationId]


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{stage_dir(spark)}/crosslume-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_staged(spark: SparkSession) -> int:
    """Delete what this application has staged so far; tables that still read it can no longer be used."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    return len(paths)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result is computed once, has no lineage, survives the loss of executors and is read with
    column pruning. Like checkpoints, the files stay until ``clear_staged`` or the folder's owner removes them.
    What this function has returned is not written once more.
    """
    if getattr(df, "_crosslume_staged", False):
        return df
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._crosslume_staged = True
    return staged
