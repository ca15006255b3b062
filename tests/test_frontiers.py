"""Crawls, sweeps and refreshed pairs against queues and whole recomputations in Python."""

import math
import random
from collections import deque

import pytest
from lodestrata import plans
from lodestrata.operators import geo as G
from lodestrata.operators import matching as M
from lodestrata.plans import flows, reports, scoring
from lodestrata.sources import crawl
from pyspark.sql import functions as F

EDGES = "site string, src string, dst string, tier int, position int"


def queue_of(edges, seeds, pages, depth, share=0.6):
    """Three queues, worked off page by page."""
    out = []
    for site in sorted({s for s, _ in seeds}):
        by = {}
        for s, src, dst, tier, position in edges:
            if s == site:
                by.setdefault(src, []).append((tier != 0, position, tier, dst))
        queues = [deque(), deque(), deque((u, 0) for u in sorted({u for s, u in seeds if s == site}))]
        queued, visits, details = {u for u, _ in queues[2]}, 0, 0
        while visits < pages:
            tier = next((t for t in (0, 1, 2) if queues[t] and (t or details < int(pages * share))), None)
            if tier is None:
                break
            url, at = queues[tier].popleft()
            visits += 1
            details += tier == 0
            out.append((site, url, tier, at, visits))
            for _, _, t, dst in sorted(by.get(url, [])):
                if dst not in queued and (t == 0 or at < depth):
                    queued.add(dst)
                    queues[t].append((dst, at + 1))
    return sorted(out)


def graph(rnd, n=25):
    edges = [(s, f"u{rnd.randrange(n)}", f"u{rnd.randrange(n):02}", rnd.choice([0, 1, 2, 2]), k) for s in ("a", "b", "c") for k in range(70)]
    edges = [(s, f"u{int(x[1:]):02}", y, t, k) for s, x, y, t, k in edges]
    return edges, [("a", "u00"), ("a", "u01"), ("b", "u05"), ("c", "nowhere"), ("a", "u00")]


@pytest.mark.parametrize("pages, depth", [(1, 3), (7, 0), (8, 2), (40, 5)])
def test_a_crawl_of_single_pages_is_a_queue(spark, pages, depth):
    edges, seeds = graph(random.Random(pages))
    got = crawl.crawl(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, "site string, url string"), pages, depth)
    assert sorted(map(tuple, got.select("site", "url", "tier", "depth", "visit").collect())) == queue_of(edges, seeds, pages, depth)


def test_larger_batches_keep_budget_and_share(spark):
    edges, seeds = graph(random.Random(3))
    got = crawl.crawl(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, "site string, url string"), 10, 4, batch=4, share=0.3).collect()
    for site in "ab":
        own = sorted((r for r in got if r["site"] == site), key=lambda r: r["visit"])
        assert [r["visit"] for r in own] == list(range(1, len(own) + 1)) and len(own) <= 10
        assert sum(r["tier"] == 0 for r in own) <= 3 and len({r["url"] for r in own}) == len(own)


def rounds(edges, seeds, pages, depth, batch, share=0.6):
    """As a queue, but a round's pages are chosen before any of them is visited."""
    by, out = {}, []
    for s, src, dst, tier, position in edges:
        by.setdefault((s, src), []).append((tier != 0, position, tier, dst))
    for site in sorted({s for s, _ in seeds}):
        queues = [[], [], [(0, 0, u, 0) for u in sorted({u for s, u in seeds if s == site})]]
        queued, visits, details = {x[2] for x in queues[2]}, 0, 0
        while visits < pages:
            left = max(0, int(pages * share) - details)
            chosen = [(t, x) for t in (0, 1, 2) for x in sorted(queues[t])[: min(batch, left) if t == 0 else batch]][: min(batch, pages - visits)]
            if not chosen:
                break
            for t, x in chosen:
                queues[t].remove(x)
                visits += 1
                details += t == 0
                out.append((site, x[2], t, x[3], visits))
            new = {}
            for k, (_, x) in enumerate(chosen, visits - len(chosen) + 1):
                for late, position, t, dst in sorted(by.get((site, x[2]), [])):
                    if dst not in queued and dst not in new and (t == 0 or x[3] < depth):
                        new[dst] = (t, (k, position, dst, x[3] + 1))
            for dst, (t, x) in new.items():
                queued.add(dst)
                queues[t].append(x)
    return sorted(out)


def test_query_of_the_crawl(spark, sf_dir):
    edges = [tuple(r) for r in flows.page_graph(spark, sf_dir).collect()]
    seeds = [(r["site"], r["url"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select(flows.base_domain(F.col("url")).alias("site"), "url").collect()]
    got = sorted(map(tuple, plans.QUERIES["budgeted_crawl"](spark, sf_dir).select("site", "url", "tier", "depth", "visit").collect()))
    assert got == rounds(edges, seeds, 6, 2, 2) and len(got) > len(set(seeds))


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def swept(points, tiles, max_calls, cap, least):
    queue, calls, finds, n = deque((0, *t) for t in tiles), [], {}, 0
    while queue:
        level, lat, lon, radius = queue.popleft()
        if n == max_calls:
            calls.append((None, level, round(lat, 6), round(lon, 6), radius, None, None))
            continue
        n += 1
        near = sorted((d, i) for i, a, b in points if (d := km(lat, lon, a, b) * 1000) <= radius)[:cap]
        for _, i in near:
            finds.setdefault(i, n)
        full = len(near) >= cap
        calls.append((n, level, round(lat, 6), round(lon, 6), radius, len(near), full))
        if full and radius > least:
            half = radius / 2
            for a in (1, -1):
                for b in (1, -1):
                    queue.append((level + 1, lat + a * half / 110_574.0, lon + b * half / 111_320.0 / math.cos(math.radians(lat)), half))
    return calls, finds


@pytest.mark.parametrize("max_calls", [5, 60, 100_000])
def test_a_sweep_is_a_queue(spark, sf_dir, max_calls):
    points = [tuple(r) for r in scoring.supplier_points(spark, sf_dir).collect()]
    tiles = [(r["lat"], r["lon"], r["radius_m"]) for r in scoring.sweep_tiles(spark).orderBy("place").collect()]
    calls, finds = G.sweep(scoring.supplier_points(spark, sf_dir), scoring.sweep_tiles(spark), max_calls, cap=1, least=2000.0)
    want, seen = swept(points, tiles, max_calls, 1, 2000.0)
    got = [tuple(r) for r in calls.select("call", "level", F.round("lat", 6), F.round("lon", 6), "radius_m", "found", "full").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r["id"]: r["call"] for r in finds.collect()} == seen
    if max_calls == 100_000:  # with an endless budget every point within a tile is found down to the least radius
        assert all(r[0] is not None for r in got) and max(r[1] for r in got) >= 1


PLACE = ["name", "city", "lat", "lon"]


def test_refreshed_pairs_are_those_of_a_whole_run(spark, sf_dir):
    old, new = reports.placed_names(spark, sf_dir), reports.placed_names(spark, sf_dir, later=True)
    before = M.company_pairs(old, "id", *PLACE, ["small"])
    was = {tuple(r) for r in before.collect()}
    want = {tuple(r) for r in M.company_pairs(new, "id", *PLACE, ["small"]).collect()}
    found, compared = M.refreshed_pairs(before, old, new, "id", *PLACE, ["small"])
    got = {(r["a"], r["b"]): r["kind"] for r in found.collect()}
    assert {k for k, v in got.items() if v != "stale"} == want
    assert got == {k: "stale" if k not in want else "kept" if k in was else "added" for k in was | want}
    assert 0 < compared.count() < new.count() and set(got.values()) == {"kept", "added", "stale"}
    same, none = M.refreshed_pairs(before, old, old, "id", *PLACE, ["small"])
    assert {(r["a"], r["b"]) for r in same.collect()} == was and none.count() == 0


def test_changed_rows(spark):
    rows = lambda x: spark.createDataFrame(x, "id long, name string, city string")
    got = M.changed_rows(rows([(1, "a", None), (2, "b", "x"), (3, "c", ""), (4, "d", "")]), rows([(1, "a", ""), (2, "b", "x"), (3, None, ""), (5, "e", "")]), "id", ["name", "city"])
    assert sorted(map(tuple, got.collect())) == [(1, "changed"), (3, "changed"), (4, "gone"), (5, "new")]


def test_pool_takes_the_first_by_the_location_rule(spark, sf_dir):
    pool, rows = reports.placed_names(spark, sf_dir), reports.placed_names(spark, sf_dir, later=True).withColumn("id", F.col("id") + 10_000_000)
    both = pool.unionByName(rows)
    names = {r["id"]: r["name"] for r in pool.collect()}
    first = {}
    for a, b in map(tuple, M.company_pairs(both, "id", *PLACE, ["small"]).collect()):
        if a in names and b not in names:
            first[b] = min(first.get(b, ("~",)), (names[a], a))
    got = {r["id"]: (r["pool_key"], r["state"]) for r in plans.QUERIES["pool_matches"](spark, sf_dir).collect()}
    assert got == {r["id"]: (first[r["id"]][1], "known") if r["id"] in first else (None, "new") for r in rows.collect()}
    assert "known" in {s for _, s in got.values()}
