"""Logs and partitions that grow: the holder of each cell, pieces fetched once, and months scored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import SCHEMAS


def read_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A log's part files as a stream, with the order that the writer gave them (a column line of the JSON)."""
    return spark.readStream.text(path).select(F.from_json("value", "line bigint, " + SCHEMAS[kind]).alias("v")).select("v.*")


def holders(events: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keeps the holder of each cell in a table at `state`, one row a cell: a batch's last event wins over what was there, an
    older one doesn't. Each batch writes a version of its own, so that a batch that runs again gives the same table."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("cell").agg(F.max_by(F.struct("line", "event", F.col("author_github").alias("author")), "line").alias("e"))
        if number:
            before = spark.read.parquet(f"{state}/v{number - 1}")
            last = before.select("cell", F.struct("line", "event", "author").alias("e")).unionByName(last).groupBy("cell").agg(F.max_by("e", "e.line").alias("e"))
        last.select("cell", "e.*").write.mode("overwrite").parquet(f"{state}/v{number}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, state: str, number: int) -> DataFrame:
    """cell and holder (null: none) after a batch."""
    return spark.read.parquet(f"{state}/v{number}").select("cell", F.when(F.col("event") == "tenure_start", F.col("author")).alias("holder"))


def fetch_once(pieces: DataFrame, fetch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Pieces of work as a stream: each batch is fetched and its result written under the batch's number, again if it failed."""

    def step(batch: DataFrame, number: int) -> None:
        fetch(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pieces.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_new(rows: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Scores the files that have come since the last run, and stops."""
    return fetch_once(rows, score, out, checkpoint)
