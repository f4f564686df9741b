"""Intermediate tables in the storage that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that this process has made and not deleted yet.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset and the master is local, as in tests, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/steps-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written and read again, which cuts its lineage, and its path."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``stored`` made."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


def drop_all(spark: SparkSession) -> None:
    """Deletes all folders that operators of this process have stored and not dropped.

    Results read some of these tables, so call it when results are written.
    """
    for path in list(_MADE):
        dropped(spark, path)
