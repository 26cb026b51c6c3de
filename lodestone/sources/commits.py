"""Appends that happen once: a batch's files count only when its commit record is there.

A batch writes into a folder of its own, which a second attempt replaces, and then puts a record
(run, batch, rows) beside it. Whoever reads takes only the folders with a record, so files of an attempt that
died are never seen, and a batch that is replayed after its record writes nothing.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Names of runs: they are names of folders, too.
NAME = re.compile(r"[A-Za-z0-9_.-]+")


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _record(path: str, run: str, batch: int) -> str:
    return f"{path}/commits/{run}-{batch}.json"


def is_committed(spark: SparkSession, path: str, run: str, batch: int) -> bool:
    store, at = _store(spark, _record(path, run, batch))
    return store.exists(at)


def commit(spark: SparkSession, path: str, run: str, batch: int, rows: int) -> None:
    """Puts the record in place by a rename, so that it is there whole or not at all."""
    store, at = _store(spark, _record(path, run, batch))
    _, made = _store(spark, f"{path}/attempts/{run}-{batch}.json")
    out = store.create(made, True)
    out.write(bytearray(json.dumps({"run": run, "batch": batch, "rows": rows}), "utf-8"))
    out.close()
    store.mkdirs(at.getParent())
    if not store.rename(made, at) and not store.exists(at):
        raise OSError(f"{at} can't be written")


def append_once(df: DataFrame, path: str, run: str, batch: int) -> int | None:
    """Appends df as batch number `batch` of `run`; returns its rows, or None if that batch is already there.

    The input is computed once: rows are counted as they are written. Of a batch that is there already
    nothing is computed. Columns `run` and `batch` of df are an error, they name the folders.
    """
    if not NAME.fullmatch(run) or batch < 0:
        raise ValueError("run must be a plain name and batch a number from 0")
    if {"run", "batch"} & set(df.columns):
        raise ValueError("columns run and batch name the folders")
    spark = df.sparkSession
    if is_committed(spark, path, run, batch):
        return None
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/data/run={run}/batch={batch}")
    rows = seen.get["rows"]
    commit(spark, path, run, batch, rows)
    return rows


def records(spark: SparkSession, path: str) -> DataFrame:
    """(run, batch, rows) of every batch that is there."""
    store, at = _store(spark, f"{path}/commits")
    schema = "run string, batch long, rows long"
    return spark.read.schema(schema).json(f"{path}/commits") if store.exists(at) else spark.createDataFrame([], schema)


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches, with run and batch; partitions without a record are pruned by the join."""
    store, at = _store(spark, f"{path}/data")
    if not store.exists(at):
        return spark.createDataFrame([], f"{schema}, run string, batch long")
    data = spark.read.schema(f"{schema}, run string, batch long").parquet(f"{path}/data")
    return data.join(records(spark, path).select("run", "batch"), ["run", "batch"], "left_semi").select(*data.columns)


def append_missing_once(df: DataFrame, path: str, keys: list[str], run: str, batch: int) -> int | None:
    """append_once() of the rows whose keys no committed batch has: a run that goes on where the one before stopped."""
    if is_committed(df.sparkSession, path, run, batch):
        return None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    done = committed(df.sparkSession, path, schema).select(*keys)
    return append_once(df.join(done, keys, "left_anti").select(*df.columns), path, run, batch)


def stream_once(stream: DataFrame, path: str, run: str, checkpoint: str) -> None:
    """Handles what the stream has and stops. A batch that Spark replays from the checkpoint is appended once."""
    writer = stream.writeStream.foreachBatch(lambda df, batch: append_once(df, path, run, batch) and None)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
