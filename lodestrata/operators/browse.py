"""Filters built from optional criteria, paging, facets and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def criteria(equal: dict[str, object] | None = None, like: dict[str, str] | None = None, unset: list[str] | None = None, between: dict[str, tuple] | None = None, any_like: tuple[list[Column], str] | None = None) -> Column:
    """The conjunction of what is given. Patterns are ILIKE with a wildcard at both ends; wildcards inside them count."""
    parts = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    parts += [F.col(c).ilike(f"%{v}%") for c, v in (like or {}).items() if v]
    parts += [F.col(c).isNull() for c in unset or []]
    for c, (low, high) in (between or {}).items():
        parts += [F.col(c) >= low] if low is not None else []
        parts += [F.col(c) <= high] if high is not None else []
    if any_like and any_like[1]:
        parts.append(reduce(lambda a, b: a | b, [c.ilike(f"%{any_like[1]}%") for c in any_like[0]]))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    """A page in a total order (give a tie-break last)."""
    return df.orderBy(*order).offset(offset).limit(min(max(1, limit), most))


def facet(df: DataFrame, column: str, limit: int = 200) -> DataFrame:
    """Distinct values in order; blanks go after the limit, as a page of a select box."""
    return df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(limit).filter(F.trim(column) != "")


def counts_by(df: DataFrame, column: Column, name: str, empty: str = "none") -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit(empty)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(df: DataFrame, row: Column, column: Column, row_name: str, values: list[str]) -> DataFrame:
    """Counts by row value and one column per given value, 0 where there is none."""
    return df.groupBy(row.alias(row_name)).agg(*[F.count_if(column == v).alias(f"n_{v}") for v in values])


def zero_filled_days(df: DataFrame, at: str, days: int) -> DataFrame:
    """Counts of the last ``days`` days before the newest, days without rows as 0."""
    day = df.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = day.agg(F.max("day").alias("last"))
    spine = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return spine.join(day, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(n)


def priority_order(industry: Column, first: list[str], b2b: Column, name: Column, score: Column) -> list[Column]:
    """Keys that put preferred industries, business customers and GmbHs first, then the score."""
    points = industry.isin(*first).cast("int") + b2b.cast("int") + F.lower(name).contains("gmbh").cast("int")
    return [points.desc_nulls_last(), score.desc_nulls_last()]


def register_page(df: DataFrame, columns: dict[str, str], key: str, sort: str = "distance", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the register by its sort menu: nearest, biggest, best tier and nearest, or by name; unknown values last.

    ``columns`` names the columns for distance, employees, tier and name. Only the order by name can be turned round; any
    other word means distance. Ties go by key.
    """
    c = {k: F.col(v) for k, v in columns.items()}
    menu = {
        "employees": [c["employees"].desc_nulls_last()],
        "name": [c["name"].desc_nulls_last() if descending else c["name"].asc_nulls_last()],
        "tier": [c["tier"].asc_nulls_last(), c["distance"].asc_nulls_last()],
    }
    return page(df, [*menu.get(sort, [c["distance"].asc_nulls_last()]), F.col(key)], limit, max(0, offset))
