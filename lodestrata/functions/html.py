"""Pages: links and densities by Spark's functions; text and structure by a parser in an Arrow UDF, since markup nests."""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_signals import strategy

#: Elements without text of their own, and elements without an end tag.
_DROP = frozenset("script style nav footer header noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: The target of a link in any letter case: in double or single quotes, or bare.
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def resolved(base: Column, href: Column) -> Column:
    """A link's absolute http address as seen from a page, without fragment; NULL for other schemes."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    root, bare = F.regexp_extract(base, "^[A-Za-z]+://[^/?#]*", 0), F.regexp_extract(base, "^[^?#]*", 0)
    path = F.regexp_extract(base, "^[A-Za-z]+://[^/?#]*(/[^?#]*/|/)?", 1)
    beside = F.concat(root, F.when(path == "", "/").otherwise(path), h)
    full = (
        F.when(h.rlike("(?i)^https?://"), h)
        .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(h == "", F.regexp_replace(base, "#.*$", ""))
        .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^[A-Za-z]+:", 0), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(bare, h))
        .otherwise(beside)
    )
    head, tail = F.regexp_extract(full, "^[A-Za-z]+://[^/?#]*", 0), F.regexp_extract(full, r"\?.*$", 0)
    parts = F.split(F.regexp_extract(full, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/")

    def walk(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    walked = F.aggregate(parts, F.array().cast("array<string>"), walk)
    walked = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.when(full.rlike(r"/\.\.?(/|$|\?)"), F.concat(head, F.array_join(walked, "/"), tail)).otherwise(full)


def links(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, link, position): absolute http links of each page without fragment, each once, where it stands first."""
    found = F.regexp_extract_all(F.col(html), F.lit(_HREF), F.lit(1))
    quoted = F.col("href").rlike("^[\"']")
    bare = F.replace(F.when(quoted, F.substring("href", F.lit(2), F.length("href") - 2)).otherwise(F.col("href")), F.lit("&amp;"), F.lit("&"))
    rows = pages.select(id_col, F.col(url).alias("lode_url"), F.posexplode(found).alias("position", "href")).withColumn("href", bare)
    rows = rows.filter(~F.trim("href").rlike("^(#|mailto:|tel:|javascript:)"))
    found = rows.select(id_col, "position", resolved(F.col("lode_url"), F.col("href")).alias("link")).filter("link IS NOT NULL")
    return found.groupBy(id_col, "link").agg(F.min("position").alias("position"))


def link_density(html: Column) -> Column:
    """struct(anchors, density): how many anchors, and their text's share of the page's."""
    anchors = F.regexp_extract_all(html, F.lit("<a [^>]*>(.*?)</a>"), F.lit(1))
    body = F.regexp_replace(F.regexp_replace(html, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return F.struct(F.size(anchors).cast("long").alias("anchors"), F.round(F.length(F.array_join(anchors, "")) / F.length(body), 4).alias("density"))


class _Page(HTMLParser):
    """Lines of text, image texts, and for each parent the shapes of its children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.alts: list[str] = []
        self.stack: list[tuple[str, str]] = []
        self.dropped = 0
        self.children: dict[int, Counter] = defaultdict(Counter)
        self.ids: list[int] = [0]
        self.next_id = 0
        self.headings = 0

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        shape = tag + "." + ".".join(sorted((own.get("class") or "").split()))
        if not self.dropped:
            self.children[self.ids[-1]][shape] += 1
        if tag == "img" and (own.get("alt") or "").strip():
            self.alts.append(own["alt"].strip())
        if tag in ("h1", "h2", "h3", "h4"):
            self.headings += 1
        if tag not in _VOID:
            self.next_id += 1
            self.stack.append((tag, shape))
            self.ids.append(self.next_id)
            self.dropped += tag in _DROP

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, _ = self.stack.pop()
                self.ids.pop()
                self.dropped -= t in _DROP
                if t == tag:
                    break

    def handle_data(self, data):
        if not self.dropped and data.strip():
            self.lines.append(" ".join(data.split()))


def parse(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    return p


#: Pages whose texts a task holds at once.
PAGES = 256


def page_texts(pages: DataFrame, id_col: str = "page_id", html: str = "html", least_alts: int = 12) -> DataFrame:
    """(id, text): lines of text outside scripts and navigation; image texts after them if there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part, out = batch.slice(at, PAGES), []
                for source in part.column(1):
                    p = parse(source.as_py())
                    text = "\n".join(p.lines)
                    out.append(text + ("\n\nNames shown as images:\n" + "\n".join(p.alts) if len(p.alts) >= least_alts else ""))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), html).mapInArrow(run, f"{id_col} long, text string")


def page_strategies(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, signals, strategy): what a page's structure looks like, and how to chunk it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source in batch[html]:
                p = parse(source)
                most = max((n for c in p.children.values() for n in c.values()), default=0)
                rows.append((len(p.alts), most, p.headings, sum(map(len, p.lines))))
            yield pd.DataFrame({id_col: batch[id_col], **{k: [r[i] for r in rows] for i, k in enumerate(("images", "cards", "headings", "text_length"))}})

    found = pages.select(id_col, html).mapInPandas(run, f"{id_col} long, images long, cards long, headings long, text_length long")
    return found.withColumn("strategy", strategy(F.col("images"), F.col("cards"), F.col("headings"), F.col("text_length")))




def _nodes(data: object, depth: int = 6) -> Iterator[dict]:
    if depth >= 0 and isinstance(data, dict):
        yield data
    for value in data.values() if isinstance(data, dict) else data if isinstance(data, list) else ():
        if depth > 0:
            yield from _nodes(value, depth - 1)


def structured_types(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, type, n, items): how often each type occurs in a page's JSON-LD, at most six levels deep, and the most items
    that a list or collection of the page says, or shows, it has. Scripts that are no JSON are passed over."""
    script = F.explode(F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))).alias("script")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch[id_col], batch["script"], strict=True):
                try:
                    nodes = list(_nodes(json.loads(text)))
                except ValueError:
                    continue
                for node in nodes:
                    kind = node.get("@type")
                    kind = kind[0] if isinstance(kind, list) and kind else kind
                    if isinstance(kind, str) and kind:
                        said, shown = node.get("numberOfItems"), node.get("itemListElement") or []
                        items = (said if isinstance(said, int) else len(shown)) if kind in ("ItemList", "CollectionPage") else 0
                        out.append((page, kind, items))
            yield pd.DataFrame(out, columns=[id_col, "type", "items"]).astype({id_col: "int64", "items": "int64"})

    found = pages.select(id_col, script).mapInPandas(run, f"{id_col} long, type string, items long")
    best = found.groupBy(id_col).agg(F.max("items").alias("items"))
    return found.groupBy(id_col, "type").agg(F.count(F.lit(1)).alias("n")).join(best, id_col)
