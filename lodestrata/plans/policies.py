"""Queries of rules for single values, and of functions that decide about one record."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions import policy as P
from ..functions import text as T
from ..functions.identity import match_key
from ..functions.quality_signals import card_score
from ..operators import register as R
from ..operators.ranking import evidence_score
from ..operators.reviews import add_new
from ..session import table
from .registry import query

_LIST = lambda xs: "['" + "', '".join(x.replace("'", "''") for x in xs) + "']"
_OR = lambda xs: "|".join(x.replace("'", "''").replace(".", "\\.").replace("$", "\\$") for x in xs)
_EDGE = "[^\\p{L}\\p{N}_]"


def _signal_sql(low: str, signals: list[str]) -> str:
    single, other = [s for s in signals if s.isalpha()], [s for s in signals if not s.isalpha()]
    parts = [f"regexp_matches({low}, '(^|{_EDGE})(?:{_OR(single)})($|{_EDGE})')"] if single else []
    return "(" + " OR ".join([*parts, *(f"contains({low}, '{s}')" for s in other)]) + ")"


#: Pairs of short texts of the parts: the name, and a longer or another one; ratios by the longest common subsequence.
_BT = """WITH RECURSIVE q AS (SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS old, CASE p_size % 4 WHEN 0 THEN ' ' WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' of ' || lower(p_type) ELSE lower(p_type) END AS new FROM part),
t AS (SELECT old, new, trim(old) AS o, trim(new) AS n, array_to_string(list_sort(string_split(lower(trim(old)), ' ')), ' ') AS x, array_to_string(list_sort(string_split(lower(trim(new)), ' ')), ' ') AS y FROM q),
l AS (SELECT old, new, o, n, x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: 0) AS r FROM t
 UNION ALL SELECT old, new, o, n, x, y, i + 1, list_reduce(list_transform(range(1, length(y) + 1), lambda j: [CASE WHEN substring(x, i + 1, 1) = substring(y, j, 1) THEN r[j] + 1 ELSE -1 END, r[j + 1]]), lambda acc, c: list_append(acc, CASE WHEN c[1] >= 0 THEN c[1] ELSE greatest(c[2], acc[-1]) END), [0]) FROM l WHERE i < length(x)),
e AS (SELECT old, new, CASE WHEN n = '' THEN NULL WHEN o = '' THEN n WHEN 200.0 * r[-1] / (length(x) + length(y)) >= 90 THEN NULL WHEN length(n) >= length(o) * 1.2 THEN n ELSE o END AS kept FROM l WHERE i = length(x))
"""


@query(_BT + "SELECT p_partkey, e.kept FROM part JOIN e ON e.old = CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AND e.new = CASE p_size % 4 WHEN 0 THEN ' ' WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' of ' || lower(p_type) ELSE lower(p_type) END")
def better_texts(spark, sf_dir):
    """Which of two texts of a record is kept, if any is to be written."""
    p = table(spark, sf_dir, "part")
    low = F.lower("p_type")
    old = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name"))
    new = F.when(F.col("p_size") % 4 == 0, " ").when(F.col("p_size") % 4 == 1, F.upper("p_name")).when(F.col("p_size") % 4 == 2, F.concat("p_name", F.lit(" of "), low)).otherwise(low)
    return p.select("p_partkey", P.better_text(old, new).alias("kept"))


@query("""SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), '|') AS items FROM documents""")
def torn_lists(spark, sf_dir):
    """Lists of words that were torn into characters, read as the lists they were; whole ones stay."""
    d = table(spark, sf_dir, "documents")
    words = F.split("text", r"[\x20\x09-\x0D]+")
    plain = ~F.col("text").rlike(r"""['"\[\]]""") & (F.length("text") < 2000)
    spelt = F.split(F.concat(F.lit("['"), F.array_join(F.filter(words, lambda w: w != ""), "', '"), F.lit("']")), "")
    torn = F.filter(spelt, lambda c: c != "")
    return d.select("doc_id", F.array_join(P.string_list(F.when(plain, torn).otherwise(words)), "|").alias("items"))


_INST, _INCUMBENT = ["the", "und", "tione"], ["chan", "el la"]


@query(f"""WITH s AS (SELECT conv_id, turn, trim(unnest(string_split_regex(text, '[.]')), ' \t\n') AS name FROM conversations), n AS (SELECT DISTINCT name, lower(name) AS l FROM s)
SELECT name, name <> '' AND ({_signal_sql('l', _INST)} OR {_signal_sql('l', _INCUMBENT)} OR contains(name, ':') OR contains(name, '?') OR length(name) - length(replace(name, ',', '')) > 1 OR regexp_matches(name, '(?i)^(?:a|an|ein|eine) [a-zà-ÿ]+$') OR regexp_matches(name, '(?i)^(?:[0-9]+ )') OR regexp_matches(name, '(?i)(?:ing of )')) AS implausible FROM n""")
def name_gate(spark, sf_dir):
    """Sentences as names of organisations: those that can't be one."""
    c = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "[.]")).alias("name")).select(F.trim("name", F.lit(" \t\n")).alias("name")).distinct()
    return c.select("name", P.implausible_name(F.col("name"), _INST, _INCUMBENT, generic="(?:a|an|ein|eine) [a-zà-ÿ]+$", headline="[0-9]+ ", collective="ing of ").alias("implausible"))


@query(f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/?([^"]*)"', 1)) AS alt FROM pages), s AS (SELECT page_id, alt, lower(trim(alt)) AS s FROM a)
SELECT page_id, alt, count(*) AS n, any_value(length(s) < 2 OR list_contains({_LIST(C.ALT_NOISE)}, s) OR regexp_matches(s, '\\.(png|jpe?g|gif|svg|webp)$|^(img|dsc|image|screenshot)[-_ ]?[0-9]+') OR regexp_matches(s, '^[^ ]+[-_][^ ]+[-_][^ ]+$')) AS junk FROM s GROUP BY page_id, alt""")
def alt_text_junk(spark, sf_dir):
    """Labels of a page's links that name nothing."""
    a = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/?([^"]*)"'), F.lit(1))).alias("alt"))
    return a.groupBy("page_id", "alt").agg(F.count(F.lit(1)).alias("n")).withColumn("junk", P.junk_alt(F.col("alt")))


@query(f"""WITH d AS (SELECT doc_id, source, text, length(text) // 2 + 1 AS mid FROM documents), p AS (SELECT doc_id, source, list_filter(regexp_extract_all(lower(substring(text, greatest(1, mid - 150), 300)), '[a-zà-ÿ]+'), lambda w: true) AS w FROM d),
x AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' WHEN doc_id % 3 = 0 THEN 'ftp' ELSE 'https' END || '://' || source AS url, len(w) >= 6 AND len(list_filter(w, lambda x: list_contains({_LIST([*C.STOPWORDS_DE, *C.STOPWORDS_EN])}, x))) >= 0.1 * len(w) AS legible FROM p)
SELECT doc_id, legible, regexp_extract(url, '^([a-z]+)://', 1) NOT IN ('http', 'https') AS odd_scheme, regexp_extract(url, '^([a-z]+)://', 1) NOT IN ('http', 'https') AND NOT legible AS junk FROM x""")
def ciphered_sources(spark, sf_dir):
    """Records from addresses that are none, unless the text around reads as language."""
    d = table(spark, sf_dir, "documents")
    scheme = F.when(F.col("doc_id") % 7 == 0, "xx").when(F.col("doc_id") % 3 == 0, "ftp").otherwise("https")
    odd, legible = P.ciphered(F.concat(scheme, F.lit("://"), "source")), P.legible(F.col("text"), F.floor(F.length("text") / 2).cast("int") + 1)
    return d.select("doc_id", F.coalesce(legible, F.lit(False)).alias("legible"), odd.alias("odd_scheme")).withColumn("junk", F.col("odd_scheme") & ~F.col("legible"))


@query("SELECT doc_id, contains(lower(concat_ws(' ', text, source)), 'gmbh') OR contains(lower(concat_ws(' ', text, source)), ' ag ') OR contains(lower(concat_ws(' ', text, source)), 'src1') AS flagged FROM documents")
def legal_form_flag(spark, sf_dir):
    """Whether any of a record's fields mentions a legal form."""
    return table(spark, sf_dir, "documents").select("doc_id", P.mentions(["gmbh", " ag ", "src1"], F.col("text"), F.col("source")).alias("flagged"))


@query("""SELECT doc_id, TRY_CAST(nullif(regexp_extract(' ' || text, '[^0-9](1[89][0-9][0-9]|20[0-9][0-9])([^0-9]|$)', 1), '') AS INT) AS year, TRY_CAST(nullif(regexp_extract(text, '-?[0-9]+'), '') AS INT) AS number, CASE WHEN length(text) <= 255 THEN text END AS label FROM documents""")
def column_fit(spark, sf_dir):
    """Values as columns take them: a year, a number, a text that isn't too long."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.fitted(F.col("text"), "year").alias("year"), P.fitted(F.col("text"), "int").alias("number"), P.fitted(F.col("text"), "text").alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0) AS discount, nullif(l_partkey, 0) AS part FROM lineitem")
def null_sentinels(spark, sf_dir):
    """What stands for nothing is NULL."""
    x = table(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"), P.unset(F.col("l_partkey")).alias("part"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'engineering' ELSE c_mktsegment END AS sector, n.n_name AS country, concat_ws(' ', c_name, CASE WHEN c_acctbal > 5000 THEN 'City ' || (c_nationkey % 4) ELSE n.n_name END, 'website') AS question FROM customer JOIN nation n ON n.n_nationkey = c_nationkey")
def search_questions(spark, sf_dir):
    """Usual names of sectors, a look-up of the country, and what to ask a search service."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    city = F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("City "), F.col("c_nationkey") % 4)).otherwise(" ")
    return rows.select("c_custkey", P.aliased(F.col("c_mktsegment"), {"building": "construction", "machinery": "engineering"}).alias("sector"), F.col("n_name").alias("country"), P.search_text(F.col("c_name"), city, F.col("n_name"), "website").alias("question"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'plain' END AS target FROM pages")
def unwrapped_results(spark, sf_dir):
    """Addresses that a search service's redirects carry."""
    p = table(spark, sf_dir, "pages")
    wrapped = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://search.example/l/?k=1&uddg="), F.url_encode("url"), F.lit("&rut=9"))).otherwise("plain")
    return p.select("page_id", P.unwrapped(wrapped).alias("target"))


@query(f"""WITH g AS (SELECT doc_id, lower(text) AS l, text, n_chars FROM documents)
SELECT doc_id, CASE WHEN {_signal_sql('l', C.EMPLOYEE_SIGNALS + ['la', 'the'])} THEN n_chars END AS headcount, CASE WHEN regexp_matches(text, '[0-9]') AND {_signal_sql('l', C.AMOUNT_SIGNALS + ['der'])} THEN n_chars END AS amount,
 CASE WHEN contains(l, 'of the') OR contains(l, 'of-the') OR contains(l, 'ofthe') THEN 'Of The' END AS phrase, array_to_string(list_filter(['Anna The', 'Bo', 'X La'], lambda p: list_contains(regexp_split_to_array(l, '{_EDGE}+'), lower(regexp_extract(p, '[^ ]+$')))), ',') AS people FROM g""")
def grounded_fields(spark, sf_dir):
    """Fields that the text supports: others become NULL, people whose name it doesn't have go."""
    d = table(spark, sf_dir, "documents")
    text, n = F.col("text"), F.col("n_chars")
    people = F.array(*map(F.lit, ("Anna The", "Bo", "X La")))
    return d.select("doc_id", T.grounded_headcount(text, n, C.EMPLOYEE_SIGNALS + ["la", "the"]).alias("headcount"), T.grounded_amount(text, n, C.AMOUNT_SIGNALS + ["der"]).alias("amount"), T.grounded_phrase(text, F.lit("Of The")).alias("phrase"), F.array_join(T.grounded_people(text, people), ",").alias("people"))


@query(f"""WITH g AS (SELECT doc_id, lower(text) AS l, text FROM documents), h AS (SELECT doc_id, {_signal_sql('l', ['la', 'the'])} AS a, regexp_matches(text, '[0-9]') AND {_signal_sql('l', ['der'])} AS b FROM g)
SELECT unnest([CASE WHEN NOT a THEN 'headcount' END, CASE WHEN NOT b THEN 'amount' END]) AS field, count(*) AS n FROM h GROUP BY 1 HAVING field IS NOT NULL""")
def reground_difference(spark, sf_dir):
    """How many records each field would change in, if it were held against its text again."""
    d = table(spark, sf_dir, "documents")
    text, n = F.col("text"), F.lit(1)
    gone = F.array_compact(F.array(F.when(T.grounded_headcount(text, n, ["la", "the"]).isNull(), "headcount"), F.when(T.grounded_amount(text, n, ["der"]).isNull(), "amount")))
    return d.select(F.explode(gone).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, trim(CASE WHEN turn % 2 = 0 THEN text ELSE replace(text, '</think>', '') END, ' \t\n') AS answer, nullif(trim(regexp_replace(CASE WHEN role = 'user' THEN '  ' ELSE text END, '\\s+', ' ', 'g')), '') AS said FROM conversations")
def answers(spark, sf_dir):
    """Answers without what was thought before, and blank texts as NULL."""
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>hm "), F.col("role"), F.lit("</think>\n"), F.col("text"))).otherwise(F.replace("text", F.lit("</think>"), F.lit("")))
    return c.select("conv_id", "turn", T.answer_part(text).alias("answer"), T.blank_to_null(F.when(F.col("role") == "user", "  ").otherwise(F.col("text"))).alias("said"))


#: Consecutive orders of a customer as two records of one thing.
_EV2 = """WITH o AS (SELECT o_orderkey AS id, o_custkey AS g, lag(o_orderkey) OVER w AS other, o_orderstatus AS city, lag(o_orderstatus) OVER w AS city2, o_orderpriority AS land, lag(o_orderpriority) OVER w AS land2, year(o_orderdate) AS y, lag(year(o_orderdate)) OVER w AS y2, o_totalprice AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
s AS (SELECT *, CASE WHEN city = city2 THEN 1.0 WHEN land = land2 THEN 0.6 ELSE 0.0 END AS location, CASE WHEN y = y2 THEN 1.0 WHEN abs(y - y2) = 1 THEN 0.5 ELSE 0.0 END AS yr, (id % 3) / 2 AS founders FROM o WHERE other IS NOT NULL)
"""


@query(_EV2 + "SELECT id, other, location::DOUBLE AS location, yr::DOUBLE AS year, round(0.353::DOUBLE * (y % 10) / 10 + 0.353::DOUBLE * least(1, p / 300000) + 0.118::DOUBLE * yr + 0.176::DOUBLE * founders, 3) AS score FROM s")
def pair_evidence(spark, sf_dir):
    """The weighted evidence of a pair of live records: name, description, place, year, people."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = {c: F.lag(c).over(w) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")}
    o = table(spark, sf_dir, "orders").withColumns({f"b_{k}": v for k, v in before.items()}).filter("b_o_orderkey IS NOT NULL")
    location = N.location_match(F.col("o_orderstatus"), F.col("b_o_orderstatus"), F.col("o_orderpriority"), F.col("b_o_orderpriority"))
    year = N.year_match(F.year("o_orderdate"), F.year("b_o_orderdate"))
    name, people = F.year("o_orderdate") % 10 / 10, F.col("o_orderkey") % 3 / 2
    return o.select(F.col("o_orderkey").alias("id"), F.col("b_o_orderkey").alias("other"), location.alias("location"), year.alias("year"), evidence_score(name, F.col("o_totalprice") / 300_000, location, year, people).alias("score"))


@query("""WITH k AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS known, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT o_custkey AS k, o_orderkey, o_orderpriority AS url, o_orderdate AS at FROM orders WHERE o_orderstatus <> 'F')
SELECT n.o_orderkey, k.last IS NULL OR NOT list_contains(k.known, n.url) OR date_diff('day', k.last, n.at) > 7 AS again FROM n LEFT JOIN k USING (k)""")
def score_refresh(spark, sf_dir):
    """Sightings that trigger a new score: never scored, a new address, or more than a week ago."""
    o = table(spark, sf_dir, "orders")
    k = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("known"), F.max("o_orderdate").alias("last"))
    n = o.filter("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderpriority", "o_orderdate").join(k, "k", "left")
    return n.select("o_orderkey", N.should_rescore(F.col("last"), F.col("o_orderpriority"), F.col("known"), F.col("o_orderdate")).alias("again"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_returnflag = 'R' THEN least(s, 0.15) ELSE s END, 4) AS score FROM (SELECT *, 0.30::DOUBLE * (l_discount * 10) + 0.20::DOUBLE * l_tax + 0.15::DOUBLE * 0.5 + 0.15::DOUBLE * (1 - least(1.0, l_quantity / 50)) + 0.10::DOUBLE * least(1.0, l_linenumber / 12) + 0.10::DOUBLE * 0.25 AS s FROM lineitem)")
def card_scores(spark, sf_dir):
    """How much groups of siblings look like directories of entities."""
    x = table(spark, sf_dir, "lineitem")
    score = card_score(F.col("l_discount") * 10, F.col("l_tax"), F.lit(0.5), F.col("l_quantity") / 50, F.col("l_linenumber").cast("double"), F.lit(0.25), F.col("l_returnflag") == "R")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"))


@query("""SELECT o_orderkey, CASE WHEN NOT coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END, false) THEN 'flagged' WHEN o_orderkey % 5 = 0 THEN 'flagged' WHEN o_orderkey % 3 > 0 THEN 'verified' ELSE 'unverified' END AS verdict,
CASE WHEN o_custkey % 11 = 0 THEN true WHEN o_orderkey % 7 = 0 THEN false ELSE o_orderstatus = 'F' OR o_orderkey % 4 >= 2 OR date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') > 30 END AS probe FROM orders""")
def record_states(spark, sf_dir):
    """What a verdict makes of a record, and which sites are due for a new look."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    identity = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    age = F.datediff(F.lit("2000-01-01").cast("date"), "o_orderdate")
    return o.select("o_orderkey", R.verdict_transition(identity, F.when(k % 5 == 0, 1).otherwise(0), k % 3).alias("verdict"), R.needs_probe(F.col("o_custkey") % 11 != 0, k % 7 == 0, F.col("o_orderstatus") == "F", k % 4, age).alias("probe"))


@query("""WITH w AS (SELECT doc_id, list_slice(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), 1, 6) AS w FROM documents)
SELECT doc_id, array_to_string(list_concat(list_slice(w, 1, 3), list_filter(list_slice(w, 4, 6), lambda x: NOT list_contains(list_transform(list_slice(w, 1, 3), lambda y: lower(y)), lower(x)))), '|') AS items, array_to_string(list_sort(list_distinct(w)), '|') AS tags FROM w""")
def list_unions(spark, sf_dir):
    """Lists of a record with what is new in another, in order; tags as one sorted set."""
    w = F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""), 1, 6)
    a, b = F.slice("w", 1, 3), F.slice("w", 4, 3)
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.array_join(add_new(a, b), "|").alias("items"), F.array_join(F.array_sort(F.array_union(a, b)), "|").alias("tags"))


@query("""WITH p AS (SELECT s_suppkey AS id, 'Supplier ' || (s_suppkey % 37) || CASE WHEN s_suppkey % 2 = 0 THEN ' GmbH' ELSE ' Gruppe AG' END AS name FROM supplier)
SELECT id, 'supplier ' || (id % 37) AS key, min(id) OVER (PARTITION BY id % 37) AS oldest FROM p""")
def match_keys(spark, sf_dir):
    """Keys without any legal form, and the oldest record of each."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("Supplier "), F.col("s_suppkey") % 37, F.when(F.col("s_suppkey") % 2 == 0, " GmbH").otherwise(" Gruppe AG"))
    rows = s.select(F.col("s_suppkey").alias("id"), match_key(name).alias("key"))
    return rows.join(rows.groupBy("key").agg(F.min("id").alias("oldest")), "key").select("id", "key", "oldest")
