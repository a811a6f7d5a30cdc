"""Partitioned tables, their manifest, and logs with line numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The bands.
BANDS = ("era5", "lag_fill", *(f"forecast_lead{i}" for i in range(1, 8)))


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share: spark.checkpoint.dir, or where that is unset a local one, which
    only a local session can use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='thermaline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/thermaline-{uuid.uuid4().hex}"


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Moves a file, and makes the folder it goes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(new).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(new).getParent())
    fs.rename(path(old), path(new))


def write_partitions(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """One sorted zstd file for each partition; only partitions that occur in rows are replaced."""
    rows.repartition(*keys).sortWithinPartitions(*keys, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def read_partitions(spark: SparkSession, path: str, schema, band: str, months: list[str] | None = None) -> DataFrame:
    if band not in BANDS:
        raise ValueError(f"unknown band {band}")
    got = spark.read.schema(schema).parquet(path).where(F.col("band") == band)
    return got.where(F.col("month").isin(months)) if months is not None else got


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and bytes of each file of a table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+=[^/]+/.*|[^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify(claimed: DataFrame, found: DataFrame) -> DataFrame:
    """Files of the claimed manifest that are missing or differ."""
    got = claimed.join(found.select("file", F.col("sha256").alias("now")), "file", "left")
    return got.select("file", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "differs").alias("violation")).where("violation IS NOT NULL")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their line number; blank lines don't count."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).where("trim(text) <> ''")
    return lines.select("line", "text", F.from_json("text", schema).alias("v")).select("line", "text", "v.*")


def flush(rows: DataFrame, path: str, batch: int, complete: bool = False) -> None:
    """Writes a batch of an unfinished job under its number, again if it is tried again; the last one is marked complete."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    if complete:
        _mark(rows.sparkSession, f"{path}/_complete")


def _mark(spark: SparkSession, file: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True).close()


def is_complete(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_complete")
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)
