"""Tables written once to the cluster's shared checkpoint folder.

A written table cuts the lineage, survives the loss of executors and keeps
column pruning for every later read.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_dir: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local session may go without it; its folder is on this machine, which
    is then the whole cluster.
    """
    global _local_dir
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="turnloom-")
    return _local_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below one folder per application, which can be deleted after it."""
    return f"{_application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def is_written(spark: SparkSession, folder: str) -> bool:
    """Whether a job has committed ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def delete_scratch(spark: SparkSession) -> None:
    """Delete what this application has in the scratch folder; its results must be written by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _application_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/turnloom-{spark.sparkContext.applicationId}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader of the written table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
