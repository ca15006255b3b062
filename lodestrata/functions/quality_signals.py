"""From the structure of a page to how it is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strategy(images: Column, cards: Column, headings: Column, length: Column, least: int = 12) -> Column:
    """struct(shape, chunking, expected): image grids by names, card directories by card, all else by sliding window."""
    kind = lambda shape, chunking, expected: F.struct(F.lit(shape).alias("shape"), F.lit(chunking).alias("chunking"), expected.cast("long").alias("expected"))
    return (
        F.when(images >= least, kind("logo_grid", "name_batch", images))
        .when((cards >= least) & (headings >= cards * 0.5), kind("card_directory", "per_card", cards))
        .when(headings >= 6, kind("article_feed", "sliding_window", headings))
        .when(length == 0, kind("empty", "none", F.lit(0)))
        .otherwise(kind("prose", "sliding_window", F.lit(0)))
    )


def card_score(unique: Column, linked: Column, heading: Column, cv: Column, size: Column, image: Column, nav: Column, least: int = 12) -> Column:
    """How much a group of siblings looks like a directory of entities; at most 0.15 inside navigation."""
    score = 0.30 * unique + 0.20 * linked + 0.15 * heading + 0.15 * (1 - F.least(F.lit(1.0), cv)) + 0.10 * F.least(F.lit(1.0), size / least) + 0.10 * image
    return F.round(F.when(nav, F.least(score, F.lit(0.15))).otherwise(score), 4)
