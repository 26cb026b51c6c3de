"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine one of our own.

    On a cluster without that setting it is an error: no folder of one machine is read by the others.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext.getCheckpointDir()
        if known is None:
            master = spark.conf.get("spark.master", "local")
            if master.startswith("local-cluster") or not master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
            known = spark.sparkContext.getCheckpointDir()
        where = known
    return where.rstrip("/")


def new_path(spark: SparkSession, kind: str = "lodestone") -> str:
    """A path of a new table or folder in the shared folder; discard() removes all of them."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(df: DataFrame, **options) -> DataFrame:
    """Writes df once to the shared folder and reads it back, so that later stages and lost executors restart there.

    options are the writer's. A written table rather than checkpoint(): that one runs its last stage twice.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Removes what this process has written on the way; for when results have been stored elsewhere. Returns how many."""
    files = spark._jvm.org.apache.hadoop.fs
    conf, n = spark._jsc.hadoopConfiguration(), 0
    while _written:
        path = files.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
