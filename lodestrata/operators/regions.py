"""Articles on pages of text blocks: where a watched term stands, the column of blocks around it, and what belongs together.

A block is a rectangle with text: page_id, block (its number in reading order), x0, y0, x1, y1, text. Taken from top to
bottom, two neighbours are of one column piece if the gap between them is small and they share enough of the narrower one's
width. That test is of neighbours alone, so pieces are the runs between places where it fails, and what grows from a block
is the part of its run that lies within ``reach`` blocks of it: windows and equi-joins, no walk.

Nothing is judged here: a term that stands on a page always gives a match, with the whole page as its region if no block holds
its place. Null texts hold no term; blocks without height or width never share a column; pages of null id are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import config as C
from .dom import is_chrome

_BOX = ("x0", "y0", "x1", "y1")


@F.pandas_udf(ArrayType(StringType()))
def _cut(text: pd.Series, starts: pd.Series) -> pd.Series:
    """A text's parts from each place to the blank before the next."""
    return pd.Series([[t[a : b - 1] for a, b in zip(s, [*s[1:], len(t) + 1], strict=True)] for t, s in zip(text, starts, strict=True)], dtype=object)


def page_blocks(all_elements: DataFrame, widths: Sequence[int] = (400, 140), letter: int = 5, line: int = 12, gaps: Sequence[int] = (8, 28)) -> DataFrame:
    """The blocks of marked-up pages, from their table of elements, set in two columns: contents and, to the right, chrome.

    A block is what stands between two borders of block-level elements, so all text is in one block each. Each fills as many
    lines of its column as its letters need; a heading stands off by the second of ``gaps``, so that articles part there.
    """
    e = all_elements.where("page_id IS NOT NULL")
    borders = e.where(F.col("tag").isin(*C.BLOCK_TAGS)).select("page_id", F.explode(F.array(
        F.struct(F.col("text_from").alias("start"), F.col("tag").isin(*C.HEADING_TAGS).alias("head")),
        F.struct(F.when(F.col("text_to") > F.col("text_from"), F.col("text_to") + 1).alias("start"), F.lit(False).alias("head")),
    )).alias("b")).select("page_id", "b.*").where("start IS NOT NULL")
    pages = e.where((F.col("node") == 0) & (F.col("text_to") > 0))
    borders = borders.unionByName(pages.select("page_id", F.lit(0).cast("long").alias("start"), F.lit(False).alias("head")))
    starts = borders.groupBy("page_id", "start").agg(F.max("head").alias("head"))
    starts = starts.join(pages.select("page_id", F.col("text_to").alias("length")), "page_id").where(F.col("start") < F.col("length"))

    before = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    outer = e.where((F.col("node") > 0) & is_chrome()).withColumn("seen", F.coalesce(F.max("last").over(before), F.lit(-1))).where(F.col("seen") < F.col("node"))
    outer = outer.where("text_to > text_from").select(F.col("page_id").alias("c_page"), "text_from", "text_to")  # disjoint intervals
    held = (F.col("page_id") == F.col("c_page")) & (F.col("start") >= F.col("text_from")) & (F.col("start") < F.col("text_to"))
    starts = starts.join(outer, held, "left").select("page_id", "start", "head", F.col("c_page").isNotNull().cast("int").alias("side"))

    rows = starts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("start", "head", "side"))).alias("s"))
    rows = rows.join(pages.select("page_id", F.col("text").alias("whole")), "page_id").withColumn("texts", _cut("whole", F.col("s.start")))
    b = rows.select("page_id", F.posexplode(F.arrays_zip("s", "texts")).alias("block", "z")).select("page_id", "block", "z.s.head", "z.s.side", F.col("z.texts").alias("text"))

    wide = F.when(F.col("side") == 1, F.lit(widths[1])).otherwise(F.lit(widths[0]))
    b = b.withColumn("height", F.ceil(F.length("text") * letter / wide) * line).withColumn("gap", F.when(F.col("head"), gaps[1]).otherwise(gaps[0]))
    down = Window.partitionBy("page_id", "side").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    y1, x0 = F.sum(F.col("gap") + F.col("height")).over(down), F.when(F.col("side") == 1, F.lit(widths[0] + 20)).otherwise(F.lit(0))
    b = b.withColumn("y1", y1)
    return b.select("page_id", "block", *[c.cast("double").alias(n) for n, c in zip(_BOX, (x0, F.col("y1") - F.col("height"), x0 + wide, F.col("y1")), strict=True)], "text")


def first_hits(blocks: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(page_id, term, place, x, y): where each of the terms first stands on each page, in any case of letters and within words,
    too; ``place`` is the term's place in the list."""
    low = F.lower("text")
    listed = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(t).alias("term"), F.instr(low, F.lit(t.lower())).alias("at")) for k, t in enumerate(terms)])
    found = blocks.where("page_id IS NOT NULL").select("page_id", "block", *_BOX, F.length("text").alias("length"), F.explode(F.filter(listed, lambda t: t["at"] > 0)).alias("t"))
    first = found.groupBy("page_id", "t.place", "t.term").agg(F.min_by(F.struct(*_BOX, "length", "t.at"), "block").alias("b"))
    b = F.col("b")
    return first.select("page_id", "term", "place", ((b["x0"] + b["x1"]) / 2).alias("x"), (b["y0"] + (b["y1"] - b["y0"]) * (b["at"] - 0.5) / b["length"]).alias("y"))


def in_columns(blocks: DataFrame, gap: float = C.COLUMN_GAP, inside: float = C.BLOCK_SLACK, overlap: float = C.COLUMN_OVERLAP) -> DataFrame:
    """Blocks with ``pos``, their place from top to bottom, and ``run``, the piece of a column that they are part of."""
    w = Window.partitionBy("page_id").orderBy("y0", "block")
    over = lambda c: F.lag(c).over(w)
    shared = F.greatest(F.lit(0.0), F.least("x1", over("x1")) - F.greatest("x0", over("x0")))
    narrow = F.least(F.col("x1") - F.col("x0"), over("x1") - over("x0"))
    near = (F.col("y0") - over("y1")).between(-inside, gap)
    joined = near & (F.coalesce(F.when(narrow > 0, shared / narrow), F.lit(0.0)) >= overlap)
    b = blocks.where("page_id IS NOT NULL").select("*", F.row_number().over(w).alias("pos"), F.when(joined, 0).otherwise(1).alias("begins"))
    return b.withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def anchors(columns: DataFrame, hits: DataFrame, slack: float = C.BLOCK_SLACK, band: float = 64.0) -> DataFrame:
    """Hits with pos and run of the first block, from top to bottom, that holds their place; NULL where none does.

    Blocks and hits meet by bands of the page, so that a long page isn't compared with itself.
    """
    stripe = lambda y: F.floor(y / band)
    b = columns.select("page_id", "pos", "run", *_BOX, F.explode(F.sequence(stripe(F.col("y0") - slack), stripe(F.greatest("y0", "y1") + slack))).alias("stripe"))
    within = F.col("x").between(F.col("x0") - slack, F.col("x1") + slack) & F.col("y").between(F.col("y0") - slack, F.col("y1") + slack)
    held = hits.withColumn("stripe", stripe(F.col("y"))).join(b, ["page_id", "stripe"]).where(within)
    first = held.groupBy("page_id", "place").agg(F.min(F.struct("pos", "run")).alias("a")).select("page_id", "place", "a.*")
    return hits.join(first, ["page_id", "place"], "left")


def regions(blocks: DataFrame, hits: DataFrame, reach: int = C.REGION_REACH, padding: float = C.REGION_PADDING, **rules: float) -> DataFrame:
    """(page_id, place, term, blocks, x0, y0, x1, y1): the article around each hit, padded, within its page.

    ``hits`` has page_id, place (unique on a page), term, x, y. ``blocks`` counts what the region grew to, 0 for a whole page.
    """
    columns = in_columns(blocks, **rules)
    found = anchors(columns, hits)
    near = found.where("pos IS NOT NULL").select("page_id", "place", "run", F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)).alias("pos"))
    corners = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    grown = near.join(columns, ["page_id", "pos", "run"]).groupBy("page_id", "place").agg(F.count(F.lit(1)).alias("blocks"), F.struct(*corners).alias("r"))
    pages = blocks.groupBy("page_id").agg(F.struct(*corners).alias("p"))
    r, p = F.col("r"), F.col("p")
    box = [F.greatest(r["x0"] - padding, p["x0"]), F.greatest(r["y0"] - padding, p["y0"]), F.least(r["x1"] + padding, p["x1"]), F.least(r["y1"] + padding, p["y1"])]
    out = found.join(grown, ["page_id", "place"], "left").join(pages, "page_id")
    whole = F.col("r").isNull()
    return out.select("page_id", "place", "term", F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"), *[F.when(whole, p[n]).otherwise(c).alias(n) for n, c in zip(_BOX, box, strict=True)])


def _overlap(a: Column, b: Column) -> Column:
    return (F.greatest(a["x0"], b["x0"]) < F.least(a["x1"], b["x1"])) & (F.greatest(a["y0"], b["y0"]) < F.least(a["y1"], b["y1"]))


def matches(found: DataFrame) -> DataFrame:
    """(page_id, match, terms, x0, y0, x1, y1): regions that share area as one, with all their terms.

    In the terms' order each region joins the first match that it shares area with, which grows by it, or begins a new one.
    A page has at most as many regions as there are terms, so the fold is over a short array.
    """
    one = F.struct(F.array("term").alias("terms"), *_BOX)
    pages = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", one.alias("m")))).alias("all"))
    kind = "array<struct<terms:array<string>,x0:double,y0:double,x1:double,y1:double>>"

    def joined(c: Column, r: Column) -> Column:
        low, high = (lambda n: F.least(c[n], r[n]).alias(n)), (lambda n: F.greatest(c[n], r[n]).alias(n))
        return F.struct(F.concat(c["terms"], r["terms"]).alias("terms"), low("x0"), low("y0"), high("x1"), high("y1"))

    def step(done: Column, r: Column) -> Column:
        at = F.array_position(F.transform(done, lambda c: _overlap(c, r)), True)
        return F.when(at == 0, F.concat(done, F.array(r))).otherwise(F.transform(done, lambda c, k: F.when(k + 1 == at, joined(c, r)).otherwise(c)))

    folded = F.aggregate(F.transform("all", lambda a: a["m"]), F.array().cast(kind), step)
    return pages.select("page_id", F.posexplode(folded).alias("k", "m")).select("page_id", (F.col("k") + 1).alias("match"), "m.*")


def excerpts(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Matches with the text of the blocks whose middle lies in them, from top to bottom."""
    b = blocks.select("page_id", "block", F.col("y0").alias("top"), ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"), "text")
    held = found.join(b, "page_id").where(F.col("mx").between(F.col("x0"), F.col("x1")) & F.col("my").between(F.col("y0"), F.col("y1")))
    texts = held.groupBy("page_id", "match").agg(F.array_sort(F.collect_list(F.struct("top", "block", "text"))).alias("t"))
    return found.join(texts, ["page_id", "match"], "left").withColumn("excerpt", F.array_join(F.coalesce(F.col("t.text"), F.array().cast("array<string>")), "\n")).drop("t")
