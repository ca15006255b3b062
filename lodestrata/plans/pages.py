"""Queries over pages as tables of nested intervals."""

from pyspark.sql import functions as F

from ..operators import dom, regions
from ..scratch import written
from ..session import table
from .registry import query


@query()
def page_cards(spark, sf_dir):
    """Of each page the group of siblings that looks most like a directory; NULL where none does."""
    e = dom.elements(table(spark, sf_dir, "pages"))
    g = dom.primary_groups(dom.card_groups(e))
    return e.where("node = 0").select("page_id").join(g.withColumn("names", F.col("members.name")).drop("members"), "page_id", "left")


@query()
def page_card_groups(spark, sf_dir):
    """All groups of like siblings with what their score is made of."""
    return dom.card_groups(dom.elements(table(spark, sf_dir, "pages"))).drop("members")


@query()
def chrome_share(spark, sf_dir):
    return dom.chrome_share(dom.elements(table(spark, sf_dir, "pages")))


@query()
def page_signals(spark, sf_dir):
    return dom.signals(dom.elements(table(spark, sf_dir, "pages")))


@query()
def page_plans(spark, sf_dir):
    """How each page is to be read: shape, extraction, chunking and how many entities it should yield."""
    return dom.page_plans(table(spark, sf_dir, "pages")).select("page_id", "shape", "extraction", "chunking", "expected", "confidence", "pattern", "pagination")


#: What the press queries watch for.
WATCHED = ["nicht", "there", "mente", "widget", "that", "ésan", "cookie"]


@query()
def article_regions(spark, sf_dir):
    """The article around the first place of each watched term on each page."""
    b = written(regions.page_blocks(dom.elements(table(spark, sf_dir, "pages"))), "blocks")
    return regions.regions(b, regions.first_hits(b, WATCHED))


@query()
def press_matches(spark, sf_dir):
    """Watched terms by article: those that stand in one are one match, with the article's text."""
    b = written(regions.page_blocks(dom.elements(table(spark, sf_dir, "pages"))), "blocks")
    found = written(regions.matches(regions.regions(b, regions.first_hits(b, WATCHED))), "matches")
    return regions.excerpts(found, b)
