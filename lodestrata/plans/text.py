"""Queries over texts: chunks, relevance, language, grounding, overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..session import table
from .registry import query

#: Vocabulary of the test queries; the operator takes any.
GROUPS = {"company": ["the", "and"], "geo": ["der", "von", "für"], "tech": ["token", "licensed?"], "funding": ["les", "est"]}
FOREIGN = ["la", "que"]
_E = r"[^\p{L}\p{N}_]"
_RX = {g: rf"(?i)(^|{_E})(?:{'|'.join(t)})($|{_E})" for g, t in GROUPS.items()}
_RXF = rf"(?i)(^|{_E})(?:{'|'.join(FOREIGN)})($|{_E})"

_CHUNKS = r"""
WITH b AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents),
s AS (SELECT *, unnest(generate_series(0, length(body) - 1, 1550)) AS chunk_start FROM b WHERE length(body) > 0),
e AS (SELECT *, least(chunk_start + 1800, length(body)) AS stop FROM s),
w AS (SELECT *, greatest(chunk_start + 1550, stop - 300) AS back FROM e),
v AS (SELECT *, substring(body, back + 1, stop - back) AS win FROM w),
p AS (SELECT *, CASE WHEN stop < length(body) THEN coalesce(
    CASE WHEN instr(reverse(win), chr(10) || chr(10)) > 0 THEN back + length(win) - instr(reverse(win), chr(10) || chr(10)) + 1 END,
    CASE WHEN instr(reverse(win), chr(10)) > 0 THEN back + length(win) - instr(reverse(win), chr(10)) + 1 END,
    CASE WHEN instr(reverse(win), ' .') > 0 THEN back + length(win) - instr(reverse(win), ' .') + 1 END, stop) ELSE stop END AS cut FROM v),
chunks AS (SELECT doc_id, source, lang, chunk_start, regexp_replace(substring(body, chunk_start + 1, cut - chunk_start), '^\s+|\s+$', '', 'g') AS chunk FROM p)
"""


def _chunks(spark, sf_dir):
    return T.sliding_chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))


@query(_CHUNKS + "SELECT doc_id, CAST(chunk_start AS BIGINT) AS chunk_start, length(chunk) AS n, md5(chunk) AS digest FROM chunks WHERE length(chunk) >= 100")
def chunk_sliding(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", F.col("chunk_start").cast("long").alias("chunk_start"), F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("digest"))


_SCORE = " + ".join(f"CAST(regexp_matches(chunk, '{r}') AS INT)" for r in _RX.values())
_RELEVANT = f"""relevant AS (SELECT *, len(list_filter(string_split_regex(chunk, '\\s+'), lambda w: w <> '')) AS words, {_SCORE} AS score,
    regexp_matches(chunk, '{_RXF}') AND NOT regexp_matches(chunk, '{_RX["geo"]}') AS foreign_only FROM chunks WHERE length(chunk) >= 100)"""


def _relevant(spark, sf_dir):
    return _chunks(spark, sf_dir).withColumn("r", T.relevance(F.col("chunk"), GROUPS, FOREIGN)).select("doc_id", "source", "lang", "chunk_start", "r.*")


@query(_CHUNKS + "," + _RELEVANT + "SELECT doc_id, CAST(chunk_start AS BIGINT) AS chunk_start, words, CAST(score AS BIGINT) AS score, foreign_only, words >= 25 AND NOT foreign_only AND score >= 2 AS relevant FROM relevant")
def relevance_score(spark, sf_dir):
    return _relevant(spark, sf_dir).select("doc_id", F.col("chunk_start").cast("long").alias("chunk_start"), F.col("words").cast("long").alias("words"), F.col("score").cast("long").alias("score"), "foreign_only", "relevant")


@query(_CHUNKS + "," + _RELEVANT + """SELECT source, lang, count(*) AS chunks, count_if(words >= 25 AND NOT foreign_only AND score >= 2) AS kept,
    round(count_if(words >= 25 AND NOT foreign_only AND score >= 2) * 1.0 / count(*), 4) AS yield FROM relevant GROUP BY source, lang""")
def relevance_yield_by_source(spark, sf_dir):
    kept = F.count_if("relevant")
    return _relevant(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("chunks"), kept.alias("kept"), F.round(kept / F.count(F.lit(1)), 4).alias("yield"))


@query(_CHUNKS + "," + _RELEVANT + "SELECT lang, count_if(foreign_only) AS rejected, count(*) AS chunks FROM relevant GROUP BY lang")
def geo_scope_reject(spark, sf_dir):
    return _relevant(spark, sf_dir).groupBy("lang").agg(F.count_if("foreign_only").alias("rejected"), F.count(F.lit(1)).alias("chunks"))


_DE, _EN = (str(x) for x in (C.STOPWORDS_DE, C.STOPWORDS_EN))


@query(f"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS w FROM documents),
n AS (SELECT doc_id, len(list_intersect(w, {_DE})) AS d, len(list_intersect(w, {_EN})) AS e FROM w)
SELECT doc_id, CASE WHEN d > e THEN 'de' WHEN e > d THEN 'en' END AS guess FROM n""")
def language_guess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.language(F.col("text")).alias("guess"))


@query(r"""WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
p AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(a.text, '[0-9]+')) AS x, regexp_extract_all(u.text, '[0-9]+') AS y FROM a JOIN u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1)
SELECT conv_id, turn, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS unsupported FROM p""")
def unsupported_numbers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("t"))
    asked = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("s"))
    return said.join(asked, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join(T.unsupported_numbers(F.col("t"), F.col("s")), ",").alias("unsupported"))


_SHINGLE_ROWS = """{n}w AS (SELECT {k} AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS i FROM {t}),
{n}l AS (SELECT id, w || ' ' || lead(w, 1) OVER (PARTITION BY id ORDER BY i) || ' ' || lead(w, 2) OVER (PARTITION BY id ORDER BY i) AS s FROM {n}w),
{n} AS (SELECT DISTINCT id, s FROM {n}l WHERE s IS NOT NULL), {n}c AS (SELECT id, count(*) AS n FROM {n} GROUP BY id)"""


@query("WITH " + _SHINGLE_ROWS.format(n="d", k="doc_id", t="documents") + ", " + _SHINGLE_ROWS.format(n="b", k="item_id", t="benchmark") + """
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS common, round(count(*) * 1.0 / (dc.n + bc.n - count(*)), 4) AS jaccard
FROM d JOIN b ON d.s = b.s JOIN dc ON dc.id = d.id JOIN bc ON bc.id = b.id GROUP BY d.id, b.id, dc.n, bc.n HAVING count(*) >= 3""")
def shingle_overlap_benchmark(spark, sf_dir):
    """Documents and benchmark items with at least three shingles in common: an equi-join on shingles, pre-filtered to
    those that the items have, and not a comparison of all pairs."""
    common = F.count(F.lit(1))
    items = table(spark, sf_dir, "benchmark").select("item_id", T.shingles(F.col("text")).alias("sh")).filter("sh IS NOT NULL").select("item_id", F.size("sh").alias("m"), F.explode("sh").alias("s"))
    asked = [r["s"] for r in items.select("s").distinct().limit(200_001).collect()]
    # if they are few, others are left out where the texts are read
    docs = T.shingle_rows(table(spark, sf_dir, "documents"), "doc_id", "n", only=set(asked) if len(asked) <= 200_000 else None)
    pairs = docs.join(items, "s").groupBy("doc_id", "item_id", "n", "m").agg(common.alias("common"))
    return pairs.filter("common >= 3").select("doc_id", "item_id", "common", F.round(F.col("common") / (F.col("n") + F.col("m") - F.col("common")), 4).alias("jaccard"))


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def exact_duplicate_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("digest"), "doc_id")
    return d.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query(r"""WITH c AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS site FROM pages),
n AS (SELECT site, page_id, 'page ' || page_id AS name, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS r FROM c)
SELECT site, CAST(r // 6 AS BIGINT) AS batch, 'Names:' || chr(10) || string_agg(name, chr(10) ORDER BY page_id) AS chunk FROM n GROUP BY site, r // 6""")
def chunk_name_batches(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1).alias("site"), F.concat(F.lit("page "), F.col("page_id")).alias("name"))
    return T.name_batches(p, ["site"], "page_id", "name").withColumn("batch", F.col("batch").cast("long"))


@query(r"""WITH o AS (SELECT o_orderkey, 'Order ' || (o_orderkey + 10000000) || CASE WHEN o_orderkey % 3 = 0 THEN ' placed since ' WHEN o_orderkey % 3 = 1 THEN ' dated ' ELSE ' founded long ago, see ' END || year(o_orderdate) || '.' AS src,
    CASE WHEN o_orderkey % 5 = 0 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS y FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 AND o_orderkey % 5 <> 0 THEN y END AS grounded FROM o""")
def grounding_year_context(spark, sf_dir):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    lead = F.when(k % 3 == 0, " placed since ").when(k % 3 == 1, " dated ").otherwise(" founded long ago, see ")
    o = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("Order "), k + 10_000_000, lead, y, F.lit(".")).alias("src"), F.when(k % 5 == 0, y + 1).otherwise(y).cast("long").alias("y"))
    return o.select("o_orderkey", T.grounded_year(F.col("src"), F.col("y")).alias("grounded"))


@query(r"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS b FROM documents)
SELECT doc_id, len(b) AS blocks FROM b""")
def blank_line_blocks(spark, sf_dir):
    blocks = F.filter(F.transform(F.split(T.strip(F.col("text")), r"\n\s*\n"), T.strip), lambda b: b != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(blocks).cast("long").alias("blocks"))


@query()
def blurb_chunks(spark, sf_dir):
    """Blocks folded into blurbs: an order-dependent fold, held against a restatement in tests/test_texts.py."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.blurbs(F.col("text"))).alias("pos", "blurb"))


@query(r"""WITH f AS (SELECT doc_id, text, list_filter(['token', 'license', 'idiot', 'trash', 'apache'], lambda k: contains(lower(text), k)) AS hits FROM documents)
SELECT doc_id, array_to_string(hits, ',') AS hits FROM f WHERE len(hits) > 0""")
def keyword_scan(spark, sf_dir):
    from ..functions.numeric import keyword_hits

    return table(spark, sf_dir, "documents").select("doc_id", keyword_hits(F.col("text"), ["token", "license", "idiot", "trash", "apache"]).alias("h")).filter("size(h) > 0").select("doc_id", F.array_join("h", ",").alias("hits"))


@query(r"""SELECT c_custkey, 'Name: ' || c_name || CASE WHEN c_acctbal < 0 THEN '' ELSE chr(10) || 'Segment: ' || c_mktsegment END AS doc FROM customer""")
def embedding_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.labelled_lines({"Name": F.col("c_name"), "Segment": F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))}).alias("doc"))
