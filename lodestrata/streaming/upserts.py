"""Keyed, idempotent upserts from a stream into versioned snapshots.

A table is dealt into buckets by the hash of its key. A batch reads and writes anew the buckets that it touches; the others stay
as they are. What is where stands in the table's commits: one row a batch and bucket, with the folder of the bucket. They
are appended after the data, so a batch that dies before that leaves files that nothing names; one that dies
after it is known by its number when it comes again, and changes nothing. Any batch's state can be read later.

A key's row is the one with the greatest order, whatever the order in which batches bring them, so late rows never
replace newer ones and the table doesn't depend on how rows are dealt into batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_COMMITS = "batch long, bucket int, folder string"


class SnapshotTable:
    """A table at ``path`` in a folder that driver and executors share; ``key`` columns tell its rows apart."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, list(key), buckets

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException:  # nothing is committed yet
            return self.spark.createDataFrame([], _COMMITS)

    def last_batch(self) -> int | None:
        return self.commits().agg(F.max("batch")).first()[0]

    def _folders(self, as_of: int | None = None) -> dict[int, str]:
        """Where each bucket is, ``buckets`` rows at most."""
        c = self.commits().where("bucket IS NOT NULL")
        c = c if as_of is None else c.where(F.col("batch") <= as_of)
        return {r["bucket"]: r["folder"] for r in c.groupBy("bucket").agg(F.max_by("folder", "batch").alias("folder")).collect()}

    def read(self, as_of: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The newest state, or that after batch ``as_of``."""
        folders = [f for b, f in sorted(self._folders(as_of).items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, number: int, order: Sequence[str]) -> bool:
        """Puts in a batch, unless its number is committed already; tells if it did."""
        if not self.commits().where(F.col("batch") == number).isEmpty():
            return False
        new = batch.select(self.schema.names).withColumn("lode_bucket", self.bucket()).persist()
        touched = [r[0] for r in new.select("lode_bucket").distinct().collect()]  # as many as there are buckets at most
        rows = new.unionByName(self.read(only=touched).withColumn("lode_bucket", self.bucket()))
        value = F.struct(*self.schema.names)
        # the order decides; of equal orders the greatest row, so that the same rows give the same table
        best = rows.groupBy("lode_bucket", *[F.col(k).alias(f"lode_{k}") for k in self.key]).agg(F.max_by(value, F.struct(*order, value)).alias("row"))
        version = f"{self.path}/data/{uuid.uuid4().hex}"
        best.select("lode_bucket", "row.*").write.partitionBy("lode_bucket").parquet(version)
        self.commit(number, {b: f"{version}/lode_bucket={b}" for b in touched})
        new.unpersist()
        return True

    def commit(self, number: int, folders: dict[int, str]) -> None:
        rows = [(number, b, f) for b, f in folders.items()] or [(number, None, None)]
        self.spark.createDataFrame(rows, _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")


def upsert_stream(df: DataFrame, table: SnapshotTable, order: Sequence[str], checkpoint: str) -> DataFrame:
    """Runs a query over what its source has, merging each batch into ``table``; gives the table's newest state."""

    def put(batch: DataFrame, number: int) -> None:
        table.merge(batch, number, order)

    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.read()


def changes(table: SnapshotTable, since: int, until: int | None = None) -> DataFrame:
    """What batches after ``since`` changed: the key, ``kind`` (new or changed) and the row as it is now."""
    old, new = table.read(as_of=since), table.read(as_of=until)
    names = [c for c in table.schema.names if c not in table.key]
    was = old.select(*table.key, F.struct(*names).alias("lode_was"), F.lit(True).alias("lode_old"))
    joined = new.join(was, table.key, "left")
    kind = F.when(F.col("lode_old").isNull(), "new").when(~F.col("lode_was").eqNullSafe(F.struct(*names)), "changed")
    return joined.withColumn("kind", kind).where("kind IS NOT NULL").select(*table.schema.names, "kind")
