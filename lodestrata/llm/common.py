"""Helpers shared by the training-data operators: shared scratch folder, materialised cuts, id handling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch, shared_dir, written  # noqa: F401

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Bytes of text that a worker turns into Python objects at once.
SLICE = 1 << 20
#: Bytes of an Arrow batch between the JVM and a worker.
BATCH = 1 << 22
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that no other column of the caller can clash. Null text is empty.

    Arrow batches of the session have at most BATCH bytes (or one row) from then on, as texts may be long."""
    conf = docs.sparkSession.conf
    most = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")
    if not most.isdigit() or int(most) > BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_slices(sizes: list[int], limit: int) -> Iterator[slice]:
    """Slices of a batch with at most ``limit`` bytes each, or one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def sliced(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of a text column, or one row, so that a worker's Python objects
    are bounded by that or by the longest text. An empty batch comes as it is."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
        for s in byte_slices(pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist(), limit):
            yield batch.slice(s.start, s.stop - s.start)


def word_pieces(raw: bytes, piece: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``piece`` bytes of it each."""
    start = 0
    while len(raw) - start > piece and (m := _BLANK.search(raw, start + piece)):
        yield raw[start : m.start()].split()
        start = m.start()
    yield raw[start:].split()
