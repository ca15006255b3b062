"""Sources and sinks: feeds, mail text, sheets, JSON lines, and knowledge-graph or map responses as tables."""

from __future__ import annotations

import csv
import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import header_key, squeeze, strip


def feed_entries(spark: SparkSession, path: str, per_feed: int = 50) -> DataFrame:
    """(feed, pos, title, link, published, summary) of RSS files: the first entries of each; a broken file gives none."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("feed"), F.col("value"))
    field = lambda name: F.regexp_extract("item", f"(?s)<{name}[^>]*>(?:<!\\[CDATA\\[)?(.*?)(?:\\]\\]>)?</{name}>", 1)
    items = raw.select("feed", F.posexplode(F.regexp_extract_all("value", F.lit("(?s)<item[ >].*?</item>"), F.lit(0))).alias("pos", "item")).filter(F.col("pos") < per_feed)
    return items.select("feed", "pos", *[strip(field(tag)).alias(name) for name, tag in (("title", "title"), ("link", "link"), ("published", "pubDate"), ("summary", "description"))])


def entry_document(title: Column, summary: Column, article: Column, least: int = 80) -> Column:
    """Title, summary and the article's first 4000 characters by line; NULL if that is too little."""
    doc = F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (title, summary, F.substring(article, 1, 4000))])
    return F.when(F.length(doc) >= least, doc)


def feed_date(c: Column) -> Column:
    """RFC 2822 or ISO text as a timestamp; NULL if neither."""
    rfc = F.regexp_extract(c, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})", 1)
    return F.coalesce(F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c))


def mail_parts(messages: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """(key, message_id, sender, subject, text) of raw messages: the first part with text, markup stripped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch[content]:
                m = email.message_from_bytes(bytes(raw), policy=email.policy.default)
                part = m.get_body(preferencelist=("plain", "html"))
                text = part.get_content() if part is not None else ""
                name = m["from"].addresses[0].display_name if m["from"] and m["from"].addresses else ""
                rows.append((m["message-id"] or "", name, m["subject"] or "", text))
            yield pd.DataFrame({key: batch[key], **{c: [r[i] for r in rows] for i, c in enumerate(("message_id", "sender", "subject", "text"))}})

    out = messages.select(key, content).mapInPandas(run, f"{key} string, message_id string, sender string, subject string, text string")
    return out.withColumn("text", F.trim(F.regexp_replace("text", "<[^>]*>", " ")))


def new_messages(messages: DataFrame, done: DataFrame, since: Column, at: str, key: str, limit: int) -> DataFrame:
    """Messages since a day that aren't done, the oldest ``limit`` of them."""
    return messages.filter(F.col(at) >= F.to_date(since)).join(done.select(key), key, "left_anti").orderBy(at, key).limit(limit)


def sheet(spark: SparkSession, path: str, sample: str, required: str = "name") -> DataFrame:
    """A CSV sheet: delimiter from its first line (``sample``), folded headers, rows without the required column dropped."""
    try:
        sep = csv.Sniffer().sniff(sample, delimiters=",;\t").delimiter
    except csv.Error:
        sep = ","
    df = spark.read.option("sep", sep).option("header", True).option("encoding", "UTF-8").csv(path)
    keys = spark.createDataFrame([(i, c.lstrip("﻿")) for i, c in enumerate(df.columns)], "i int, c string").select("i", header_key(F.col("c")).alias("k")).orderBy("i").collect()
    return df.toDF(*[r["k"] or f"column{r['i']}" for r in keys]).filter(squeeze(F.coalesce(F.col(required), F.lit(""))) != "")


def export_sheet(df: DataFrame, path: str, sep: str = ";", mark: bool = False) -> None:
    """Rows as CSV part files with a header each; NULL as nothing. With ``mark`` each file begins with a byte order mark, which
    some spreadsheets need to read letters beyond ASCII: it is part of the header's first name."""
    named = df.toDF("\ufeff" + df.columns[0], *df.columns[1:]) if mark else df
    named.write.mode("overwrite").option("sep", sep).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def export_register(df: DataFrame, path: str, labels: dict[str, str], order: list[Column], where: Column | None = None) -> None:
    """All rows that a filter leaves, in order, with labelled columns, as marked sheets; part files are in order, too."""
    rows = (df if where is None else df.where(where)).orderBy(*order)
    export_sheet(rows.select(*[F.col(c).alias(label) for c, label in labels.items()]), path, mark=True)


def append_json(df: DataFrame, path: str) -> None:
    """One provenance row per extraction, appended."""
    df.write.mode("append").json(path)


def point(wkt: Column) -> Column:
    """struct(lat, lon) of ``Point(lon lat)``; NULL if it isn't one."""
    lon = F.regexp_extract(wkt, r"(?i)point\s*\(\s*([-0-9.]+)\s+([-0-9.]+)\s*\)", 1).try_cast("double")
    lat = F.regexp_extract(wkt, r"(?i)point\s*\(\s*([-0-9.]+)\s+([-0-9.]+)\s*\)", 2).try_cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def map_elements(df: DataFrame, body: str = "body") -> DataFrame:
    """Elements of a map service's JSON answer: id, name, lat and lon (own or of the centre), tags."""
    schema = "elements array<struct<id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
    x = df.select(F.explode(F.from_json(body, schema)["elements"]).alias("x"))
    return x.select("x.id", F.col("x.tags")["name"].alias("name"), F.coalesce("x.lat", "x.center.lat").alias("lat"), F.coalesce("x.lon", "x.center.lon").alias("lon"), "x.tags")


def keyword_hits_in_pages(pages: DataFrame, keywords: DataFrame, text: str, keyword: str = "keyword", around: int = 80, id_col: str = "doc_id") -> DataFrame:
    """(page, keyword, excerpt) of each keyword that a page contains, with what stands around its first place.

    Only ids and tokens meet the keywords; texts join the pages that have a keyword's first token."""
    words = keywords.select(F.lower(keyword).alias("k")).distinct()
    first = words.select(F.col("k"), F.regexp_extract("k", r"^[\p{L}\p{N}]+", 0).alias("token")).filter("token <> ''")
    tokens = pages.select(id_col, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("token"))
    some = tokens.join(first, "token").select(id_col, "k")
    hit = pages.join(some, id_col).filter(F.contains(F.lower(text), F.col("k")))
    at = F.instr(F.lower(text), F.col("k"))
    return hit.withColumn("excerpt", F.substring(F.col(text), F.greatest(at - around, F.lit(1)), F.length("k") + 2 * around)).withColumnRenamed("k", keyword)
