"""Queries over names, addresses and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import identity as I
from ..functions import text as T
from ..session import table
from .registry import query

_FORMS = ["GmbH", "AG", "Inc.", "Ltd", "& Co. KG", "SE", "Holding"]


def _names(spark, sf_dir):
    """Part names with a legal form and a web site made of their keys."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("p_partkey") % len(_FORMS) + 1).cast("int"))
    site = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("https://www."), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".de/start?x=1"))).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(".com")))
    return p.select("p_partkey", F.concat_ws(" ", F.initcap("p_name"), form).alias("name"), site.alias("website"))


_N = f"""WITH n AS (SELECT p_partkey, upper(p_name[1]) || substring(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substring(split_part(p_name, ' ', 2), 2) || ' ' || ({_FORMS})[p_partkey % 7 + 1] AS name,
 CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://www.' || replace(p_name, ' ', '-') || '.de/start?x=1' ELSE replace(p_name, ' ', '') || '.com' END AS website FROM part),
k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(' ' || lower(name) || ' ', '([^\\p{{L}}\\p{{N}}_])({'|'.join(C.LEGAL_FORMS)})([^\\p{{L}}\\p{{N}}_])', '\\1\\3', 'g'), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', ' ', 'g')) AS norm,
 CASE WHEN website = '' THEN '' ELSE regexp_replace(lower(regexp_extract(CASE WHEN contains(website, '://') THEN website ELSE 'https://' || website END, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') END AS dom FROM n)
"""


@query(_N + "SELECT p_partkey, name, norm FROM k")
def normalize_names(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", "name", I.normalize_name(F.col("name")).alias("norm"))


@query(_N + "SELECT p_partkey, dom AS domain FROM k")
def extract_domains(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", I.domain(F.col("website")).alias("domain"))


@query(_N + "SELECT p_partkey, substring(sha256(norm || '|' || dom), 1, 32) AS fingerprint FROM k")
def fingerprint_names(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", I.fingerprint(F.col("name"), F.col("website")).alias("fingerprint"))


@query(_N + """, u AS (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(substring(sha256(norm || '|' || dom), 1, 32))) AS h FROM k)
SELECT p_partkey, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', (instr('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS uuid FROM u""")
def stable_uuid(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", I.stable_uuid(F.col("name"), F.col("website")).alias("uuid"))


@query(_N + "SELECT norm, dom AS domain, min(p_partkey) AS first_key, count(*) AS n FROM k GROUP BY norm, dom HAVING count(*) > 1")
def identity_groups(spark, sf_dir):
    n = _names(spark, sf_dir).select("p_partkey", I.normalize_name(F.col("name")).alias("norm"), I.domain(F.col("website")).alias("domain"))
    return n.groupBy("norm", "domain").agg(F.min("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS s FROM pages)
SELECT page_id, CASE WHEN len(s) = 0 THEN '' ELSE '/' || array_to_string(CASE WHEN regexp_full_match(lower(s[-1]), '[0-9]+|[a-z0-9]+(-[a-z0-9]+)+') THEN list_append(s[:-2], '*') ELSE s END, '/') END AS pattern FROM p""")
def path_patterns(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", I.path_pattern(F.col("url")).alias("pattern"))


@query(r"""WITH p AS (SELECT page_id, string_split(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/') AS s FROM pages)
SELECT page_id, list_has_any(s, ['login', 'fr', 'de']) OR list_has_any(flatten(list_transform(s, lambda x: string_split_regex(x, '[-_]'))), ['login', 'fr', 'de']) AS skipped, CASE WHEN list_has_any(s, ['en', 'portfolio']) THEN 0 ELSE 1 END AS priority FROM p""")
def url_skip_priority(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", I.skipped_url(u, ["login", "fr", "de"]).alias("skipped"), I.url_priority(u, ["en", "portfolio"]).alias("priority"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'))) AS folded FROM documents""")
def norm_value_fold(spark, sf_dir):
    """Whole texts without marks and case, one blank between words."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(I.fold(F.col("text"))).alias("folded"))


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1) AS i FROM pages),
a AS (SELECT page_id, i, regexp_replace(CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href[1] = '/' THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || href END, '#.*$', '') AS link FROM l
WHERE NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)'))
SELECT page_id, count(DISTINCT link) AS links, arg_min(link, i) AS first_link FROM a WHERE link IS NOT NULL GROUP BY page_id""")
def page_links(spark, sf_dir):
    from ..functions.html import links

    return links(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.countDistinct("link").alias("links"), F.min_by("link", "position").alias("first_link"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*>(.*?)</a>', 1) AS a, regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS body FROM pages)
SELECT page_id, len(a) AS anchors, round(length(array_to_string(a, '')) * 1.0 / length(body), 4) AS density FROM t""")
def link_density(spark, sf_dir):
    from ..functions.html import link_density as density

    return table(spark, sf_dir, "pages").select("page_id", density(F.col("html")).alias("d")).select("page_id", "d.*")


@query()
def page_text(spark, sf_dir):
    from ..functions.html import page_texts

    return page_texts(table(spark, sf_dir, "pages"))


@query()
def page_strategy(spark, sf_dir):
    from ..functions.html import page_strategies

    return page_strategies(table(spark, sf_dir, "pages"))


@query("""SELECT c_custkey, replace(replace(lower(c_name), '#', '_'), 'customer_', 'customer_') AS slug FROM customer""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.slug(F.col("c_name")).alias("slug"))


@query(r"""WITH s AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') AS d FROM pages)
SELECT d AS domain, upper(split_part(d, '.', 1)[1]) || lower(substring(split_part(d, '.', 1), 2)) AS name FROM s WHERE length(split_part(d, '.', 1)) >= 2 AND split_part(d, '.', 1) NOT LIKE '%-%'""")
def names_from_links(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select(I.base_domain(F.col("url")).alias("domain"), I.name_from_link(F.col("url"), F.lit("https://other.org/")).alias("name")).distinct()
    return d.filter("name IS NOT NULL AND NOT name LIKE '%-%'")
