"""Sources and sinks: files of transcripts and banks, resumable appends, partitioned texts, manifests."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tables of the driver; one Parquet each.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TRANSCRIPT = "Start_Time DOUBLE, End_Time DOUBLE, Text STRING, Confidence DOUBLE"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """A query over the tables it names, each read from folder; only columns it uses are read."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(text)


def transcripts(spark: SparkSession, pattern: str, suffix: str = "_Transcript.csv", schema: str = TRANSCRIPT) -> DataFrame:
    """CSV files, one a participant: participant_id from the file's name, pos from the row's place in the file.

    A file is read by one task as long as it can't be split (multiLine), which also keeps its rows in order.
    """
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).csv(pattern)
    name = F.regexp_replace(F.col("_metadata.file_name"), f"{suffix}$".replace(".", r"\."), "")
    placed = raw.select("*", name.alias("participant_id"), F.monotonically_increasing_id().alias("_row"))
    from pyspark.sql import Window

    return placed.withColumn("pos", F.row_number().over(Window.partitionBy("participant_id").orderBy("_row")) - 1).drop("_row")


def json_bank(spark: SparkSession, path: str, element: str) -> DataFrame:
    """{participant: [objects]} -> a row an object with its place; `element` is the objects' DDL."""
    text = spark.read.option("wholetext", True).text(path)
    bank = text.select(F.explode(F.from_json("value", f"map<string,array<struct<{element}>>>")).alias("participant_id", "objects"))
    return bank.select("participant_id", F.posexplode("objects").alias("pos", "o")).select("participant_id", "pos", "o.*")


def json_records(spark: SparkSession, path: str, schema: str | StructType, lines: bool = False) -> DataFrame:
    """A JSON list, or JSON lines."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def shards(spark: SparkSession, paths: list[str], fmt: str = "parquet", **options) -> DataFrame:
    """Shards of one table in one scan; columns that some lack are null there."""
    if fmt == "parquet":
        return spark.read.option("mergeSchema", True).parquet(*paths)
    out = None
    for p in paths:
        df = spark.read.options(**options).format(fmt).load(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the store's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table if it is there, else no rows of the same columns."""
    return spark.read.parquet(path).select(like.columns) if exists(spark, path) else like.limit(0)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends, as JSON lines, the rows whose keys aren't in path yet; returns how many. Run again, it goes on where it stopped.

    Rows are counted as they are written. For writers that may fail half-way or run again see commits.append_once().
    """
    spark = df.sparkSession
    new = df
    if exists(spark, path):
        done = spark.read.schema(df.select(*keys).schema).json(path)
        new = df.join(done, keys, "left_anti")
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return seen.get["n"]


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """A folder a key, with the key's text."""
    df.select(key, F.col(text).alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_frozen(df: DataFrame, path: str) -> None:
    """Fails if something is there already."""
    df.write.mode("errorifexists").parquet(path)


def write_views(df: DataFrame, views: dict[str, list[str]]) -> None:
    """The same rows under several projections; computed once if Spark can keep them."""
    kept = df.persist()
    try:
        for path, columns in views.items():
            kept.select(*columns).write.mode("overwrite").parquet(path)
    finally:
        kept.unpersist()


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, modified) of files, from the listing alone."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.col("modificationTime").alias("modified"))


def artifact_status(spark: SparkSession, expected: list[str]) -> DataFrame:
    """(artifact, status) for a list of paths."""
    return spark.createDataFrame([(p, "present" if exists(spark, p) else "MISSING") for p in expected], "artifact string, status string")


def discovered(spark: SparkSession, root: str, name: str) -> str:
    """The first path, in order, of a file of that name anywhere below root; an error if there is none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path").orderBy("path").head()
    if found is None:
        raise FileNotFoundError(f"no {name} below {root}")
    return found.path


def parquet_or_csv(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or the CSV file with a head beside it if only that is there."""
    if exists(spark, path):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(re.sub(r"\.parquet$", ".csv", path))


def json_document(df: DataFrame, most: int = 100_000) -> str:
    """A small table as one indented JSON list; an error if it has more rows than a document should."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2, default=str)


def markdown_lines(df: DataFrame, order: str) -> DataFrame:
    """(place, line): a Markdown table, head and rule first, rows in order; a bar or line feed in a value is escaped."""
    cells = (F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in df.columns)
    line = F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    head = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    rows = df.select(F.concat(F.lit("2:"), F.lpad(F.col(order).cast("string"), 24, "0")).alias("place"), line.alias("line"))
    return df.sparkSession.createDataFrame(list(zip(("0", "1"), head)), "place string, line string").unionAll(rows)


def first_available(spark: SparkSession, folders: list[str], names: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, missing): each named CSV file from the first folder that has it, with `file` and `folder`, and the names that none has."""
    found, lacking = {}, []
    for n in names:
        where = next((f for f in folders if exists(spark, f"{f}/{n}")), None)
        found.setdefault(where, []).append(n) if where else lacking.append((n,))
    out = None
    for f, files in found.items():
        part = spark.read.schema(schema).option("header", True).csv([f"{f}/{n}" for n in files]).select("*", F.col("_metadata.file_name").alias("file"), F.lit(f).alias("folder"))
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], f"{schema}, file string, folder string")
    return out, spark.createDataFrame(lacking, "file string")
