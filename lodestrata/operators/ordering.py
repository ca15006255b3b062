"""Numbers and running sums over a whole table in a total order, without one task that sees all rows.

Rows are dealt into ranges of the order; each range is numbered or summed by itself, and what stands before it is the sum
over the ranges before, of which there are as many as partitions. So the only window without a key has a row a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def _ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    # ranges are drawn from samples, anew for each use: written, so that all uses see the same
    return written(df.repartitionByRange(*order).withColumn("lode_part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: Sequence[Column | str], values: dict[str, Column]) -> DataFrame:
    """``df`` with running sums, from the first row to each one, in a total order (equal rows in any order)."""
    ranged = _ranged(df.withColumns({f"lode_{k}": v for k, v in values.items()}), order)
    w = Window.partitionBy("lode_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = ranged.withColumns({k: F.sum(f"lode_{k}").over(w) for k in values})
    sums = ranged.groupBy("lode_part").agg(*[F.sum(f"lode_{k}").alias(f"lode_{k}") for k in values])
    before = Window.orderBy("lode_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("lode_part", *[F.coalesce(F.sum(f"lode_{k}").over(before), F.lit(0)).alias(f"lode_before_{k}") for k in values])
    out = inner.drop(*[f"lode_{k}" for k in values]).join(F.broadcast(offsets), "lode_part")  # a row a partition
    return out.withColumns({k: F.col(k) + F.col(f"lode_before_{k}") for k in values}).drop("lode_part", *[f"lode_before_{k}" for k in values])


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "line") -> DataFrame:
    """``df`` with its rows' numbers, from 1, in a total order."""
    return running(df, order, {name: F.lit(1)})


def placed(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "place", size: str = "n") -> DataFrame:
    """``df`` with each row's place in its group, from 1, and the group's size: a group of any size takes as many tasks as it fills."""
    lines = written(numbered(df, [*by, *order], "lode_line"), "places")
    first = lines.groupBy(*by).agg(F.min("lode_line").alias("lode_first"), F.count(F.lit(1)).alias(size))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by] or [F.lit(True)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = lines.alias("l").join(first.alias("g"), on)
    return out.select("l.*", F.col(f"g.{size}").alias(size), (F.col("l.lode_line") - F.col("g.lode_first") + 1).alias(name)).drop("lode_line")
