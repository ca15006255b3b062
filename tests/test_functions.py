"""Small cases of functions, sources and streaming steps that tables seldom have."""

import pandas as pd
from lodestrata.functions import identity
from lodestrata.operators import reviews
from lodestrata.sources import formats
from lodestrata.streaming import jobs
from pyspark.sql import functions as F


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_fold(spark):
    assert values(spark, identity.fold(F.col("t")), ["  KÖLN ", "Zürich", "Éa  b", None]) == ["cologne", "zurich", "ea b", ""]


def test_empty_values(spark):
    assert values(spark, identity.is_empty(F.col("t")), [None, "", "0", "x"]) == [True, True, True, False]


def test_points(spark):
    found = values(spark, formats.point(F.col("t")), ["Point(11.5 48.1)", "Point(x y)", None])
    assert (found[0]["lat"], found[0]["lon"]) == (48.1, 11.5) and found[1:] == [None, None]


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><item><title><![CDATA[One]]></title><link>u</link><pubDate>Mon, 05 Jan 2026 10:00:00 +0000</pubDate><description>text</description></item><item><title>Two</title></item></rss>")
    (tmp_path / "b.xml").write_text("<rss><item><title>never closed")
    rows = formats.feed_entries(spark, str(tmp_path), per_feed=1).withColumn("at", formats.feed_date(F.col("published"))).collect()
    assert [(r["title"], r["summary"], r["at"].year) for r in rows] == [("One", "text", 2026)]


def test_mail(spark):
    raw = b"From: A B <a@b.c>\r\nSubject: S\r\nMessage-ID: <1@b>\r\nContent-Type: text/html\r\n\r\n<p>Hello</p>"
    rows = formats.mail_parts(spark.createDataFrame([("p", bytearray(raw))], "path string, content binary")).collect()
    assert [tuple(r) for r in rows] == [("p", "<1@b>", "A B", "S", "Hello")]


def test_ties_are_not_resolved(spark):
    p = spark.createDataFrame([(1, "f", "a", 1), (1, "f", "b", 2), (2, "f", "a", 3)], "k int, field string, new string, review int")
    status = {r["review"]: r["status"] for r in reviews.resolve(p, reviews.majority(p, "k"), "k", "review").collect()}
    assert status == {1: "pending", 2: "pending", 3: "approved"}


def test_state_outlives_a_restart(spark, tmp_path):
    rows = pd.DataFrame({"k": ["a", "a", "b"], "at": [1, 2, 3], "short": [True, True, False]})
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (rows.iloc[:1], rows.iloc[1:]):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_of(spark, source, spark.read.parquet(source).schema)
        found = jobs.run_available(jobs.outcome_state(stream, "k", "at", "short"), out, state)
    assert sorted((r["key"], r["at"], r["consecutive"], r["status"]) for r in found.collect()) == [("a", 1, 1, "active"), ("a", 2, 2, "flagged"), ("b", 3, 0, "active")]


def test_no_distance_without_coordinates(spark):
    from lodestrata.functions.numeric import haversine_km
    from lodestrata.operators.matching import same_place

    none = F.lit(None).cast("double")
    row = spark.range(1).select(haversine_km(F.lit(48.0), F.lit(9.0), none, F.lit(9.0)).alias("d"), same_place(F.lit(""), F.lit("Ulm"), none, none, none, none).alias("p"), haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("far")).first()
    assert row["d"] is None and row["p"] is None and abs(row["far"] - 20015.0868) < 0.001
