"""Shared scratch storage, the one place where operators cut lineage.

A table stored here lives in the folder that ``spark.checkpoint.dir`` names, which every executor
can read, so a lost executor costs a re-read and not a re-computation of the whole job. ``release``
removes a stored table that nothing reads any more.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder: the one that the setting names, else the one that was set on the
    context. A session on one machine (tests) gets a folder of its own; on a cluster, where such a folder
    could be read by one machine only, that is an error."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + os.path.join(tempfile.mkdtemp(prefix="archivelens-"), "shared")
            spark.sparkContext.setCheckpointDir(_OWN[app])
        found = _OWN[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


#: Where stored tables lie, by the identity of the frame that reads them.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def release(*tables: DataFrame) -> None:
    """Remove what ``stored`` wrote for these tables. Nothing that still has to run may read them."""
    for table in tables:
        held, path = _PATHS.pop(id(table), (None, None))
        if path and held() is table:
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
