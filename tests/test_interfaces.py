"""Feeds, mail and SQL functions against the library's own parts and against literal cases."""

from datetime import datetime, timezone

import pytest
from lodestrata import plans
from lodestrata.functions import identity as I
from lodestrata.functions import numeric as N
from lodestrata.functions import text as T
from lodestrata.functions.sql import register_all
from lodestrata.operators import quality as Q
from lodestrata.operators.rewording import reworded_ratio
from lodestrata.plans.interfaces import _mail
from lodestrata.plans.text import GROUPS
from lodestrata.scratch import shared_dir
from lodestrata.sources import messages as M
from pyspark.sql import functions as F

RSS = b"""<?xml version="1.0"?><rss><channel><title>No entry</title><item><title> One &amp; two </title><link> http://a.b/1 </link><pubDate>Tue, 02 Jan 2024 03:04:05 +0200</pubDate>
<description><![CDATA[<p>Text</p>]]></description></item><item><title>Second</title></item><item><title>Third</title></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">A <b>b</b></title><link rel="self" href="x"/><link rel="alternate" href="http://a.b/2"/>
<updated>2024-01-02T03:04:05Z</updated><content>Body</content></entry></feed>"""


def test_feeds():
    utc = lambda *x: datetime(*x, tzinfo=timezone.utc)
    assert M.feed_entries(RSS, 2) == [(0, "One & two", "http://a.b/1", utc(2024, 1, 2, 1, 4, 5), "<p>Text</p>", None), (1, "Second", "", None, "", None)]
    assert M.feed_entries(ATOM) == [(0, "A b", "http://a.b/2", utc(2024, 1, 2, 3, 4, 5), "Body", None)]
    assert M.feed_entries(b"<rss><channel/></rss>") == []
    (broken,) = M.feed_entries(b"<rss><item>")
    assert broken[:5] == (None,) * 5 and broken[5]


@pytest.mark.parametrize("raw, want", [("Tue, 02 Jan 2024 03:04:05 GMT", 3), ("2024-01-02T04:04:05+01:00", 3), ("2024-01-02 03:04:05", 3), ("soon", None), ("", None), (None, None)])
def test_dates(raw, want):
    found = M.when(raw)
    assert found == (datetime(2024, 1, 2, want, 4, 5, tzinfo=timezone.utc) if want else None)


MIXED = b"""Message-ID: <1@x>
From: =?utf-8?B?S0lULUdyw7xuZGVyc2NobWllZGU=?= <x@kit.edu>
Subject: =?utf-8?Q?=F0=9F=9F=A3_Milliarden?= von hier
Date: Tue, 02 Jan 2024 03:04:05 +0000
Content-Type: multipart/alternative; boundary=b

--b
Content-Type: text/plain

--b
Content-Type: text/html; charset=iso-8859-1

<html><style>p{}</style><p>Gr\xfc\xdfe</p><p>an alle</p></html>
--b--
"""


def test_mail():
    (one,) = M.mail_messages(MIXED)
    assert one[1:5] == ("<1@x>", "KIT-Gründerschmiede <x@kit.edu>", "KIT-Gründerschmiede", "🟣 Milliarden von hier") and one[6] == "Grüße\nan alle" and one[7] is None
    many = M.mail_messages(b"From a@b Tue\nMessage-ID: <1>\nFrom: plain@x.org\n\nfirst\n\nFrom c@d Wed\nMessage-ID: <2>\nSubject: =?bad?X?y?=\nContent-Type: text/plain; charset=no-such\n\nsecond\n")
    assert [(m[0], m[1], m[3], m[6].strip()) for m in many] == [(0, "<1>", "plain@x.org", "first"), (1, "<2>", "", "second")]
    assert M.mail_messages(b"")[0][7] == "no header" and M.mail_messages(MIXED.replace(b"02 Jan", b"99 Foo"))[0][5] is None


def test_sources_read_a_partition_a_file_and_count_broken_ones(spark, tmp_path):
    for name, raw in (("a.xml", RSS), ("sub/b.xml", ATOM), ("c.xml", b"<rss"), ("_hidden", RSS)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    spark.dataSource.register(M.FeedSource)
    got = spark.read.format("entity_feeds").option("entries", 2).load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 3
    assert sorted((r["title"] or "", r["error"] is None) for r in got.collect()) == [("", False), ("A b", True), ("One & two", True), ("Second", True)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    other = M.feed_rows(files, 2).drop("feed")
    assert sorted(map(str, other.collect())) == sorted(map(str, got.drop("feed").collect()))
    (tmp_path / "none").mkdir()
    assert spark.read.format("entity_feeds").load(f"{tmp_path}/none").count() == 0 and shared_dir(spark)


def test_newsletters_are_read_blurb_by_blurb(spark, sf_dir):
    got = {r["message_id"]: (r["blurbs"], r["relevant"], r["characters"]) for r in plans.QUERIES["newsletter_pipeline"](spark, sf_dir).collect()}
    b = _mail(spark, sf_dir).select(F.concat(F.lit("<m"), "file", F.lit("@x.org>")).alias("m"), F.explode_outer(T.blurbs(F.col("body"))).alias("blurb")).where("blurb IS NOT NULL")
    want = b.groupBy("m").agg(F.count(F.lit(1)), F.count_if(T.relevance(F.col("blurb"), GROUPS)["relevant"]), F.sum(F.length("blurb")))
    want = {r[0]: tuple(r)[1:] for r in want.collect()}
    assert {k: v for k, v in got.items() if v[0]} == want and want
    none = M.newsletter_yield(M.mail_rows(spark.createDataFrame([("x", bytearray(MIXED)), ("y", bytearray(b"")), ("z", bytearray(MIXED))], "path string, content binary")), GROUPS, trusted=["@other.org"])
    assert none.count() == 0


def test_sql_functions_are_the_librarys(spark):
    names = register_all(spark)
    assert len(names) == len(set(names)) and register_all(spark) == names  # again is no error
    rows = [("Acme GmbH & Co. KG", "HTTPS://WWW.Acme.de/x"), ("  Über-Öl   AG ", "http://u.v?w"), (None, None), ("Was nun? Ja.", "no scheme"), ("a" * 50, ""), ("Ein Satz hier.", "ftp://x.y")]
    df = spark.createDataFrame(rows, "name string, url string")
    df.createOrReplaceTempView("lode_names")
    sql = spark.sql("SELECT base_domain(url), normalize_name(name), sorted_words(name), file_slug(name), headline_like(name), distance_km(48, 10, length(name), 11), reworded_ratio(name, upper(name)), vector_cosine(array(1D, 2D), array(length(name), 1D)) FROM lode_names")
    n, u = F.col("name"), F.col("url")
    own = df.select(I.base_domain(u), I.normalize_name(n), I.sorted_tokens(n), T.slug(n), Q.headline_like(n), N.haversine_km(F.lit(48.0), F.lit(10.0), F.length(n), F.lit(11.0)), reworded_ratio(n, F.upper(n)), F.when(n.isNotNull(), N.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.length(n).cast("double"), F.lit(1.0)))).otherwise(0.0))
    for a, b in zip(sql.collect(), own.collect(), strict=True):
        assert [round(x, 9) if isinstance(x, float) else x for x in a] == [round(x, 9) if isinstance(x, float) else x for x in b]


def test_table_functions(spark):
    register_all(spark)
    assert [r[0] for r in spark.sql("SELECT token FROM name_tokens('Solar Works GmbH solar') ORDER BY token").collect()] == ["solar", "works"]
    assert [tuple(r) for r in spark.sql("SELECT * FROM text_windows('abcdefg', 4, 3) ORDER BY start").collect()] == [(0, "abcd"), (3, "defg"), (6, "g")]
    assert spark.sql("SELECT * FROM text_windows('', 4, 3)").count() == 0
    got = spark.sql("SELECT t.tag, t.last - t.node AS inside FROM VALUES ('<div><p>a<a href=x>b</a></div>') AS p(html), LATERAL page_elements(html) AS t ORDER BY t.node")
    assert [tuple(r) for r in got.collect()] == [("#page", 3), ("div", 2), ("p", 1), ("a", 0)]


def test_many_files_share_tasks(spark, tmp_path):
    """Hundreds of feeds are read in few tasks, none left out and a broken one counted; messages are written several a file."""
    from lodestrata.plans.interfaces import _files

    for i in range(300):
        (tmp_path / f"{i}.xml").write_bytes(b"<rss" if i == 7 else RSS)
    spark.dataSource.register(M.FeedSource)
    got = spark.read.format("entity_feeds").load(str(tmp_path))
    assert M.OWN_TASK <= got.rdd.getNumPartitions() <= 2 * M.OWN_TASK
    n = len(M.feed_entries(RSS))
    assert got.where("error IS NULL").count() == 299 * n and got.where("error IS NOT NULL").count() == 1
    rows = spark.range(1000).coalesce(1).select(F.concat(F.lit("From c@x.org Mon\nMessage-ID: <m"), "id", F.lit(">\n\ntext\n")).alias("value"))
    read = spark.read.format("binaryFile").load(_files(rows, "mail", each=200))
    assert read.count() == 5 and M.mail_rows(read).where("error IS NULL").select("message_id").distinct().count() == 1000
