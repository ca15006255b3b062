"""Pages as a table of nested intervals: cards, page chrome, signals and the strategy that follows from them.

A page's elements are numbered as they open; ``last`` is the number of the last element inside, so d lies in a if and only if
a.node < d.node <= a.last. On that table the questions that one asks of a tree are relational:

* how many elements are inside: last - node;
* the first heading, link or image inside: the next one in the order of numbers, if it isn't beyond ``last``; one backward
  pass over a page gives all of them;
* is it part of the navigation: an interval join with the elements that are;
* which siblings look alike: a grouping by parent and shape.

Only the parsing itself needs Python, since markup nests and is left unclosed: an end tag closes what was opened last under
its name with all inside, and is passed over if nothing was; void elements never hold others. Text of scripts, styles and
templates is none. Null markup gives a root alone; a null page id stays null and its elements can't be told from those of
other null ids, so give pages ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.html import resolved, structured_types
from ..functions.policy import junk_alt
from ..scratch import written
from .quality import headline_like

ELEMENTS = (
    "page_id long, node long, last long, parent long, depth long, tag string, classes array<string>, id string, role string, rel string, "
    "href string, title string, alt string, pieces array<string>, text_from long, text_to long, text string"
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))
_HEADINGS = tuple(f"h{k}" for k in range(1, 7))


class _Tree(HTMLParser):
    """The rows of a page; row 0 is the page itself. ``text`` joins the stripped pieces by one space."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = [{"tag": "#page", "parent": None, "depth": 0, "piece": 0}]
        self.open: list[int] = [0]
        self.pieces: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node, own = len(self.rows), {k: v or "" for k, v in reversed(attrs)}
        row = {k: own.get(k) for k in ("id", "role", "rel", "href", "title", "alt")}
        self.rows.append(row | {"tag": tag, "classes": own.get("class", "").split(), "parent": self.open[-1], "depth": len(self.open), "piece": len(self.pieces)})
        self.open.append(node)
        self.silent += tag in _SILENT
        if tag in _VOID:
            self._close()

    def _close(self) -> str:
        node = self.open.pop()
        row = self.rows[node]
        row["last"], row["to"] = len(self.rows) - 1, len(self.pieces)
        self.silent -= row["tag"] in _SILENT
        return row["tag"]

    def handle_endtag(self, tag: str) -> None:
        if any(self.rows[k]["tag"] == tag for k in self.open[1:]):
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.silent and (piece := data.strip()):
            self.pieces.append(piece)


def _tree(html: str | None, short: int) -> list[dict]:
    t = _Tree()
    t.feed(html or "")
    t.close()
    while t.open:
        t._close()
    at = [0]  # where each piece begins in the page's text
    for p in t.pieces:
        at.append(at[-1] + len(p) + 1)
    for node, row in enumerate(t.rows):
        a, b = row.pop("piece"), row.pop("to")
        row |= {"node": node, "text_from": at[a], "text_to": max(at[a], at[b] - 1)}
        if row["tag"] in ("a", "button", *_HEADINGS) or row["text_to"] - row["text_from"] < short + b - a:
            row["pieces"] = t.pieces[a:b]
    t.rows[0]["text"] = " ".join(t.pieces)
    return t.rows


def text_pieces(html: str | None) -> list[str]:
    """The stripped texts of a page in order."""
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.pieces


def elements(pages: DataFrame, id_col: str = "page_id", html: str = "html", short: int = 120) -> DataFrame:
    """One row per element of each page, written to the shared folder, with its interval of numbers and of text.

    ``pieces`` holds the stripped texts inside headings, links, buttons and all elements of at most ``short`` characters;
    the whole text of any element is the page's (row 0) from ``text_from`` to ``text_to``.
    """
    schema = pages.sparkSession.createDataFrame([], ELEMENTS).schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {f: pa.list_(pa.string()) if f in ("classes", "pieces") else pa.int64() if f in ("page_id", "node", "last", "parent", "depth", "text_from", "text_to") else pa.string() for f in names}
        for batch in batches:
            for page, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = _tree(source, short)
                yield pa.RecordBatch.from_arrays([pa.array([page if f == "page_id" else r.get(f) for r in rows], types[f]) for f in names], names=names)

    found = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html).cast("string").alias("html"))
    return written(found.mapInArrow(run, ELEMENTS), "elements")


def is_chrome() -> Column:
    """Whether an element frames a page: by its tag, or by a word in its classes, id or role."""
    named = F.concat_ws(" ", F.array_join("classes", " "), "id", "role")
    return F.col("tag").isin(*C.CHROME_TAGS) | named.rlike(C.CHROME_HINTS)


def in_chrome(some: DataFrame, all_elements: DataFrame, levels: int = 5) -> DataFrame:
    """Those of ``some`` elements that are chrome, or lie in chrome at most ``levels`` above: a semi-join on intervals."""
    c = all_elements.where((F.col("node") > 0) & is_chrome()).select(F.col("page_id").alias("c_page"), F.col("node").alias("c_node"), F.col("last").alias("c_last"), F.col("depth").alias("c_depth"))
    inside = (F.col("page_id") == F.col("c_page")) & F.col("node").between(F.col("c_node"), F.col("c_last")) & (F.col("depth") - F.col("c_depth") <= levels)
    return some.join(c, inside, "left_semi")


def chrome_share(all_elements: DataFrame) -> DataFrame:
    """(page_id, elements, chrome_elements, text_length, chrome_length, share): how much of each page's text stands in its
    outermost chrome elements."""
    e = all_elements
    w = Window.partitionBy("page_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    c = e.where((F.col("node") > 0) & is_chrome()).withColumn("before", F.coalesce(F.max("last").over(w), F.lit(-1)))
    outer = c.where(F.col("before") < F.col("node"))  # intervals nest: beyond all earlier ends means in none of them
    held = outer.groupBy("page_id").agg(F.sum(F.col("last") - F.col("node") + 1).alias("chrome_elements"), F.sum(F.col("text_to") - F.col("text_from")).alias("chrome_length"))
    pages = e.where("node = 0").select("page_id", F.col("last").alias("elements"), F.col("text_to").alias("text_length"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.coalesce(F.round(F.col("chrome_length") / F.nullif("text_length", F.lit(0)), 4), F.lit(0.0))
    return pages.join(held, "page_id", "left").select("page_id", "elements", zero("chrome_elements"), "text_length", zero("chrome_length")).withColumn("share", share)


def _said(pieces: Column, by: str = "") -> Column:
    return F.array_join(pieces, by)


def features(all_elements: DataFrame, junk: Callable[[Column], Column] = junk_alt, longest: int = 120) -> DataFrame:
    """What is known of each element by what is inside it: name (the first of heading, element classed as a name, link's
    title, image's text, link's text and short text that names something), href, tag_count, text_length, has_image, has_heading."""
    e = all_elements
    back = Window.partitionBy("page_id").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = lambda test, value: F.last(F.when(test, F.struct("node", value.alias("value"))), True).over(back)
    tag, tight = F.col("tag"), _said(F.col("pieces"))
    named = F.array_join("classes", " ").rlike(C.NAME_CLASS_HINTS)
    looks = {h: nearest(tag == h, tight) for h in _HEADINGS}
    looks |= {
        "titled": nearest((tag == "a") & F.col("title").isNotNull(), F.col("title")),
        "image": nearest((tag == "img") & F.col("alt").isNotNull(), F.col("alt")),
        "any_image": nearest(tag == "img", F.lit("")),
        "link": nearest(tag == "a", tight),
        "linked": nearest((tag == "a") & F.col("href").isNotNull(), F.col("href")),
        "hint1": nearest(named, tight),
    }
    e = e.select("*", *[v.alias(k) for k, v in looks.items()])
    for k in (2, 3):  # what a named element has next to it is the second, then the third of those before it
        e = e.withColumn(f"hint{k}", F.last(F.when(named, F.struct(F.col(f"hint{k - 1}.node").alias("node"), F.col(f"hint{k - 1}.value").alias("value"))), True).over(back))
    inside = lambda c: F.when(F.col(f"{c}.node") <= F.col("last"), F.col(f"{c}.value"))

    def ok(v: Column) -> Column:
        v = F.regexp_replace(v, r"^\s+|\s+$", "")
        return F.when(F.length(v).between(2, longest) & ~junk(v), v)

    spaced = _said(F.col("pieces"), " ")
    tries = F.array(*[inside(c) for c in (*_HEADINGS, "hint1", "hint2", "hint3", "titled", "image", "link")], F.when(F.length(spaced) <= 60, spaced))
    name = F.get(F.filter(F.transform(tries, ok), lambda v: v.isNotNull()), 0)  # one test for all, or the code outgrows a method
    heading = F.greatest(*[F.when(F.col(f"{h}.node") <= F.col("last"), 1).otherwise(0) for h in _HEADINGS]) == 1
    return e.select(
        *all_elements.columns, name.alias("name"), inside("linked").alias("first_href"), (F.col("last") - F.col("node")).alias("tag_count"),
        (F.col("text_to") - F.col("text_from")).alias("text_length"), inside("any_image").isNotNull().alias("has_image"), heading.alias("has_heading"),
    )


def _shapes(children: DataFrame) -> DataFrame:
    """Children with two shapes: tag and the classes that two or more of their siblings have; tag and their own first three
    children's tags."""
    one = children.select("page_id", "parent", "node", F.explode(F.array_distinct("classes")).alias("class"))
    siblings = F.count(F.lit(1)).over(Window.partitionBy("page_id", "parent", "class"))
    shared = one.withColumn("n", siblings).where("n >= 2").groupBy("page_id", "node").agg(F.array_join(F.array_sort(F.collect_set("class")), ".").alias("shared"))
    shape = F.concat("tag", F.when(F.col("shared") != "", F.concat(F.lit("."), "shared")).otherwise(""))
    return children.join(shared, ["page_id", "node"], "left").withColumn("shared", F.coalesce("shared", F.lit(""))).withColumn("shape", shape).drop("shared")


def card_groups(all_elements: DataFrame, least: int = C.CARD_LEAST, weights: dict[str, float] = C.CARD_WEIGHTS, name_only: tuple[int, float] = C.NAME_ONLY, junk: Callable[[Column], Column] = junk_alt) -> DataFrame:
    """Groups of at least ``least`` siblings of one shape, scored by how much they look like a directory of entities.

    Siblings are grouped by shared classes; where that gives a parent no group, by their own children's tags.
    Columns: page_id, parent, shape, n, members (node, name, href), the shares that the score is made of, in_chrome,
    name_only, score.
    """
    f = features(all_elements, junk)
    w = Window.partitionBy("page_id", "parent")
    children = f.where("parent IS NOT NULL").withColumn("siblings", F.count(F.lit(1)).over(w)).where(F.col("siblings") >= least)
    kid = F.struct("node", "tag")
    kids = all_elements.where("parent IS NOT NULL").groupBy("page_id", F.col("parent").alias("node")).agg(F.slice(F.array_sort(F.collect_list(kid)), 1, 3)["tag"].alias("kids"))
    c = _shapes(children).join(kids, ["page_id", "node"], "left")
    c = c.withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy("page_id", "parent", "shape")))
    c = c.withColumn("by_class", F.max(F.col("alike")).over(w) >= least)
    plain = F.concat_ws(">", "tag", F.array_join("kids", ">"))
    c = c.withColumn("shape", F.when(F.col("by_class"), F.col("shape")).otherwise(plain))
    short, share = name_only
    names = F.sum(F.when(F.col("name").isNotNull(), 1).otherwise(0))
    n = F.count(F.lit(1))
    g = c.groupBy("page_id", "parent", "shape").agg(
        n.alias("n"),
        F.array_sort(F.collect_list(F.struct("node", "name", F.col("first_href").alias("href")))).alias("members"),
        (F.count("first_href") / n).alias("linked"),
        (F.count_distinct("first_href") / n).alias("unique_href"),
        (F.count_distinct(F.lower("name")) / n).alias("unique_name"),
        (F.count_if("has_image") / n).alias("image"),
        (F.count_if(F.col("has_heading") | F.col("name").isNotNull()) / n).alias("heading"),
        F.floor(F.median("text_length")).alias("median_text"),
        F.coalesce(F.stddev_pop("tag_count") / F.nullif(F.avg("tag_count"), F.lit(0.0)), F.lit(0.0)).alias("cv"),
        (F.count_if(F.col("text_length") <= short) / n >= share).alias("name_only"),
        F.coalesce(F.count_if(headline_like(F.col("name"))) / F.nullif(names, F.lit(0)), F.lit(0.0)).alias("headlines"),
    ).where(F.col("n") >= least)
    parents = all_elements.select("page_id", F.col("node").alias("parent"), "node", "last", "depth")
    framed = in_chrome(parents.join(g.select("page_id", "parent").distinct(), ["page_id", "parent"], "left_semi"), all_elements)
    g = g.join(framed.select("page_id", "parent", F.lit(True).alias("in_chrome")), ["page_id", "parent"], "left").withColumn("in_chrome", F.coalesce("in_chrome", F.lit(False)))
    identity = F.greatest("unique_href", "unique_name")
    s = (
        weights["identity"] * identity + weights["linked"] * F.col("linked") + weights["heading"] * F.col("heading")
        + weights["alike"] * (1 - F.least(F.lit(1.0), "cv")) + weights["size"] * F.least(F.lit(1.0), F.col("n") / least) + weights["image"] * F.col("image")
    )
    s = F.when(F.col("in_chrome"), F.least(s, F.lit(weights["chrome_cap"]))).otherwise(s)
    s = s - F.when((F.col("median_text") < 3) & (identity < 0.5), weights["empty"]).otherwise(0.0)
    return g.withColumn("score", F.greatest(F.lit(0.0), F.round(s, 6)))


def primary_groups(groups: DataFrame, threshold: float = C.CARD_THRESHOLD) -> DataFrame:
    """The best group of each page, if it reaches the threshold; of equal ones the first on the page, then by shape."""
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "parent", "shape")
    return groups.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def detail_patterns(groups: DataFrame, pages: DataFrame, url: str = "url", share: float = 0.6) -> DataFrame:
    """(page_id, parent, shape, pattern, coverage): the path that the links of a group's members have in common, if two or
    more distinct ones on the page's own host do and they are at least ``share`` of the members; else NULL."""
    path = lambda c: F.regexp_extract(c, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    host = lambda c: F.regexp_extract(c, "^[A-Za-z]+://([^/?#]*)", 1)
    m = groups.join(pages.select("page_id", F.col(url).alias("lode_url")), "page_id").select("page_id", "parent", "shape", "n", "lode_url", F.explode("members").alias("m"))
    m = m.withColumn("link", resolved(F.col("lode_url"), F.col("m.href")))
    own = m.where(host(F.col("link")) == host(F.col("lode_url"))).select("page_id", "parent", "shape", "n", path(F.col("link")).alias("path")).distinct()
    own = own.withColumn("parts", F.array_remove(F.split("path", "/"), "")).where(F.size("parts") > 0)
    # what the least and the greatest path share, all share
    g = own.groupBy("page_id", "parent", "shape").agg(F.count(F.lit(1)).alias("paths"), F.first("n").alias("n"), F.min("parts").alias("low"), F.max("parts").alias("high"))
    same = F.transform(F.arrays_zip("low", "high"), lambda x: x["low"].eqNullSafe(x["high"]) & x["low"].isNotNull())
    n_same = F.coalesce(F.nullif(F.array_position(same, False) - 1, F.lit(-1)), F.size(same).cast("long"))
    g = g.withColumn("common", F.slice("low", F.lit(1), n_same.cast("int"))).withColumn("coverage", F.when(F.col("paths") >= 2, F.col("paths") / F.col("n")).otherwise(0.0))
    found = (F.size("common") > 0) & (F.col("coverage") >= share)
    return g.select("page_id", "parent", "shape", F.when(found, F.concat(F.lit("/"), F.array_join("common", "/"), F.lit("/*"))).alias("pattern"), F.round("coverage", 4).alias("coverage"))


def signals(all_elements: DataFrame, junk: Callable[[Column], Column] = junk_alt) -> DataFrame:
    """Per page: text_length, link_density, prose_density, distinct image texts (all and those that name something), the number
    that the page says it lists, and the kind of its pagination."""
    e, tag = all_elements, F.col("tag")
    said = F.lower(_said(F.col("pieces"), " "))
    more = F.exists(F.array(*[F.lit(p.lower()) for p in C.LOAD_MORE]), lambda p: F.contains(said, p))
    number = _said(F.col("pieces")).rlike("^[0-9]{1,3}$")
    alt = F.regexp_replace("alt", r"^\s+|\s+$", "")
    alts = e.where((tag == "img") & (F.length(alt) >= 2)).groupBy("page_id", F.lower(alt).alias("key")).agg(F.min_by(alt, "node").alias("alt"))
    alts = alts.groupBy("page_id").agg(F.count(F.lit(1)).alias("alts"), F.count_if(~junk(F.col("alt"))).alias("clean_alts"))
    found = e.groupBy("page_id").agg(
        F.max(F.when(F.col("node") == 0, F.col("text_to"))).alias("text_length"),
        F.count_if(F.col("node") > 0).alias("elements"),
        F.coalesce(F.sum(F.when(tag == "a", F.col("text_to") - F.col("text_from"))), F.lit(0)).alias("link_length"),
        F.max(F.when(F.col("node") == 0, F.regexp_extract("text", C.COUNT_TEXT, 1))).alias("said"),
        F.max((tag.isin("a", "button")) & more).alias("load_more"),
        F.max((tag == "a") & F.array_contains(F.split(F.lower(F.coalesce("rel", F.lit(""))), r"\s+"), "next")).alias("next"),
        F.count_if((tag == "a") & number).alias("numbers"),
    )
    kind = F.when(F.col("load_more"), "load_more").when(F.col("next"), "rel_next").when(F.col("numbers") >= 2, "numbered")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.join(alts, "page_id", "left").select(
        "page_id", "text_length", F.when(F.col("text_length") > 0, F.col("link_length") / F.col("text_length")).otherwise(0.0).alias("link_density"),
        (F.col("text_length") / F.greatest("elements", F.lit(1))).alias("prose_density"), zero("alts"), zero("clean_alts"),
        F.coalesce(F.try_to_number("said", F.lit("9999")).cast("int"), F.lit(0)).alias("self_reported"), kind.alias("pagination"),
    )


def page_plans(pages: DataFrame, least: int = C.CARD_LEAST, prose_density: float = C.PROSE_LINKS) -> DataFrame:
    """How to read each page: its signals, its primary group of cards, and shape, extraction, chunking, expected and
    confidence. The most certain evidence comes first: an editorial feed, items that the page declares, a group of names or of cards, prose."""
    e = elements(pages)
    groups = written(primary_groups(card_groups(e, least)), "cards")
    declared = structured_types(pages).groupBy("page_id").agg(F.max("items").alias("declared"))
    d = signals(e).join(groups.drop("members"), "page_id", "left").join(detail_patterns(groups, pages).select("page_id", "pattern", "coverage"), "page_id", "left")
    d = d.join(declared, "page_id", "left").withColumn("declared", F.coalesce("declared", F.lit(0)))
    segments = F.split(F.lower(F.coalesce("pattern", F.lit(""))), "[-_/]")
    grouped, wordy = F.col("n").isNotNull(), ~F.coalesce("name_only", F.lit(True))
    feed = F.arrays_overlap(segments, F.array(*map(F.lit, C.EDITORIAL))) | (wordy & (F.col("headlines") >= 0.6)) | (wordy & (F.col("n") >= 4) & (F.col("unique_name") < 0.7))
    made = lambda shape, text, chunking, n, sure: F.struct(F.lit(shape).alias("shape"), F.lit(text).alias("extraction"), F.lit(chunking).alias("chunking"), F.coalesce(n, F.lit(0)).cast("long").alias("expected"), F.lit(sure).alias("confidence"))
    plan = (
        F.when(grouped & feed, made("article_feed", "main_prose", "sliding_window", F.lit(0), "medium"))
        .when(F.col("declared") >= least, made("card_directory", "card_structured", "per_card", F.col("declared"), "high"))
        .when(grouped & F.col("name_only"), made("logo_grid", "alt_harvest", "name_batch", F.col("n"), "high"))
        .when(grouped, made("card_directory", "card_structured", "per_card", F.col("n"), "high"))
        .when((F.col("text_length") > 0) & (F.col("link_density") <= prose_density), made("prose_listing", "main_prose", "sliding_window", F.lit(0), "medium"))
        .otherwise(made("unknown", "full_text", "sliding_window", F.lit(0), "low"))
    )
    return d.withColumnRenamed("shape", "group_shape").withColumn("plan", plan).select("*", "plan.*").drop("plan")
