"""Crawls over a stored link graph: what can be reached, and what a budget visits, on tables instead of a queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def reach(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(url, depth): what ``seeds`` (url) lead to over ``links`` (src, dst) in at most ``depth`` steps, by least depth.

    One equi-join and one anti-join a level; the number of levels is a parameter, not a property of the data. Each level is
    written, so the plan of one doesn't hold those before it.
    """
    front = seen = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    edge = links.select("src", "dst").distinct()
    for d in range(1, depth + 1):
        found = edge.join(front.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        front = written(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(front)
    return seen


#: Tiers of a frontier, the first to be visited first: pages of single entities, promising pages, all others.
DETAIL, HIGH, LOW = 0, 1, 2


def crawl(links: DataFrame, seeds: DataFrame, pages: int, depth: int, batch: int = 1, share: float = 0.6) -> DataFrame:
    """(site, url, tier, depth, visit): which pages of each site a crawl with a budget visits, in their order.

    ``links`` has site, src, dst, tier and position; ``seeds`` has site and url. A round takes up to ``batch`` pages of each
    site's frontier: details first, as long as they are less than ``share`` of the budget of ``pages``, then the tiers in order;
    within a tier what was found first. A page's links join the frontier when it is visited: details always, others above
    ``depth`` only, each address once, with the tier in which it was found first. With a batch of one this is a queue
    worked off page by page; larger batches visit at once what a round can see.

    Sites go side by side; what is ranked of a site is cut to the batch in every task before it moves. Each round's frontier
    and visits are written, and rounds are at most as many as the budget takes.
    """
    details = int(pages * share)
    first = seeds.groupBy("site", "url").count().select("site", "url", F.lit(LOW).alias("tier"), F.lit(0).alias("depth"), F.lit(0).alias("found"), F.lit(0).alias("position"))
    spent = ["site", "visits", "details"]
    frontier = written(first, "frontier")
    known = frontier.select("site", "url")
    visited, used = None, written(first.select("site").distinct().withColumns({"visits": F.lit(0), "details": F.lit(0)}), "spent")
    edges = links.select("site", "src", "dst", "tier", "position")
    while True:
        open_ = frontier.join(used.select(*spent), "site").where(F.col("visits") < pages)
        queue = Window.partitionBy("site", "tier").orderBy("found", "position", "url")
        queued = open_.withColumn("place", F.row_number().over(queue)).where(F.col("place") <= batch)
        # details beyond their share stay behind the others for good
        fit = queued.where((F.col("tier") != DETAIL) | (F.col("place") <= details - F.col("details")))
        order = Window.partitionBy("site").orderBy("tier", "place")  # three batches a site
        taken = fit.withColumn("place", F.row_number().over(order)).where(F.col("place") <= batch)
        taken = taken.withColumn("visit", F.col("visits") + F.col("place")).where(F.col("visit") <= pages)
        now = written(taken.select("site", "url", "tier", "depth", "visit"), "visits")
        if now.isEmpty():
            break
        visited = now if visited is None else visited.unionByName(now)
        one = now.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == DETAIL).alias("d"))
        used = written(used.join(one, "site", "left").select("site", (F.col("visits") + F.coalesce("n", F.lit(0))).cast("int").alias("visits"), (F.col("details") + F.coalesce("d", F.lit(0))).cast("int").alias("details")), "spent")
        from_ = now.select("site", F.col("url").alias("src"), F.col("depth").alias("above"), F.col("visit").alias("found"))
        new = edges.join(from_, ["site", "src"]).where((F.col("tier") == DETAIL) | (F.col("above") < depth))
        # of a page's links its details are found first
        new = new.groupBy("site", F.col("dst").alias("url")).agg(F.min(F.struct("found", (F.col("tier") != DETAIL).alias("late"), "position", "tier", "above")).alias("x"))
        new = new.join(known, ["site", "url"], "left_anti").select("site", "url", "x.tier", (F.col("x.above") + 1).alias("depth"), "x.found", "x.position")
        rest = frontier.join(now, ["site", "url"], "left_anti")
        frontier = written(rest.select(frontier.columns).unionByName(new.select([F.col(f.name).cast(f.dataType) for f in frontier.schema])), "frontier")
        known = written(known.unionByName(new.select("site", "url")), "known")
    return visited if visited is not None else now
