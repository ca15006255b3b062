"""Streaming twins of the batch pipelines, on Structured Streaming.

State lives in the query's checkpoint, so a restarted query goes on where it stopped. ``run_available`` drains what a
source has and stops: the form in which batch results and streaming ones can be compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def stream_of(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a query over what is there, appending to ``path``; gives what the path then has."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_complete(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregate over what is there; each batch replaces the snapshot at ``path``."""
    schema = df.schema

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = df.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(schema).parquet(path)


def new_ids(df: DataFrame, key: str) -> DataFrame:
    """Each key once over the life of the query: what a message-id file does, in the checkpoint."""
    return df.dropDuplicates([key])


def chunk_yield(df: DataFrame, groups: dict[str, list[str]], by: list[str], text: str = "text", foreign: list[str] | None = None) -> DataFrame:
    """Chunks and relevant chunks of each group of rows, kept up to date."""
    chunks = T.sliding_chunks(df, text).withColumn("r", T.relevance(F.col("chunk"), groups, foreign or []))
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.count_if("r.relevant").alias("kept"))


def outcome_state(df: DataFrame, key: str, at: str, short: str, limit: int = 2) -> DataFrame:
    """(key, at, consecutive, status) of each row as it comes: a run of shortfalls flags the key, a success clears it.

    A key's rows of one micro-batch are put in order together, so what one batch may hold of a key is bounded by the
    files that the source takes a trigger; rows that come in a later batch count as later, whatever their time.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(at)
        out = []
        for when, bad in zip(rows[at], rows[short], strict=True):
            n = n + 1 if bad else 0
            out.append((k[0], when, n, "flagged" if n >= limit else "active"))
        state.update((n,))
        yield pd.DataFrame(out, columns=["key", at, "consecutive", "status"])

    kind = dict(df.dtypes)
    return df.groupBy(key).applyInPandasWithState(step, f"key {kind[key]}, {at} {kind[at]}, consecutive long, status string", "n long", "append", "NoTimeout")


def each_batch(df: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Keyed upserts and other sinks of the caller's, a batch at a time, each batch once by its number."""
    df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# Beyond the reviewed engine: event time.
def windowed_counts(df: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def session_counts(df: DataFrame, at: str, by: str, gap: str = "30 minutes") -> DataFrame:
    return df.groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), by, "n")
