"""Names, domains and what identifies a record."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import squeeze, strip

_B = r"(?<![\p{L}\p{N}_])"
_E = r"(?![\p{L}\p{N}_])"
_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def normalize_name(c: Column) -> Column:
    """Lower case, without legal forms and punctuation (hyphens stay), one blank between words."""
    s = F.regexp_replace(F.lower(strip(c)), f"{_B}(?:{'|'.join(C.LEGAL_FORMS)}){_E}", "")
    return F.coalesce(squeeze(F.regexp_replace(s, r"[^\p{L}\p{N}_\s-]", "")), F.lit(""))


def core_name(c: Column) -> Column:
    """Lower case, without the wider list of legal forms and without any punctuation."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{_B}(?:{'|'.join(C.LEGAL_FORM_PATTERNS)}){_E}", " ")
    return squeeze(F.regexp_replace(s, r"[^\p{L}\p{N}_\s]", " "))


def match_key(c: Column) -> Column:
    n = normalize_name(c)
    return core_name(F.when(n != "", n).otherwise(c))


def clean_name(c: Column) -> Column:
    """Without a disambiguation in brackets at the end."""
    return squeeze(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?iu)\s*\((?:Unternehmen|Firma|Konzern|Begriffskl[äa]rung)[^)]*\)\s*$", ""))


def authority(url: Column) -> Column:
    """Host, port and user of a URL with a scheme, lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def base_domain(url: Column) -> Column:
    """The authority less one leading ``www.``; empty without a scheme."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def domain(url: Column) -> Column:
    """As ``base_domain``, with https put before a URL that has no scheme."""
    u = F.coalesce(url, F.lit(""))
    return F.when(u == "", "").otherwise(base_domain(F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u))))


def identity_domain(url: Column, shared: Iterable[str] = C.SHARED_DOMAINS) -> Column:
    """The domain, or NULL if there is none or many share it."""
    d = domain(url)
    return F.when((d != "") & ~d.isin(*shared), d)


def fingerprint(name: Column, website: Column) -> Column:
    n = normalize_name(name)
    return F.when(n == "", "").otherwise(F.substring(F.sha2(F.concat_ws("|", n, domain(website)), 256), 1, 32))


def stable_uuid(name: Column, website: Column) -> Column:
    """The version 5 UUID (URL namespace) of the fingerprint; NULL without a name."""
    f = fingerprint(name, website)
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(f, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    u = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    return F.when(f != "", u)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_pattern(url: Column) -> Column:
    """The path, its last segment as ``*`` if it is a number or a hyphenated slug; empty for the root."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    last = F.lower(F.element_at(segments, -1))
    n = F.size(segments)
    star = last.rlike("^[0-9]+$") | last.rlike("^[a-z0-9]+(-[a-z0-9]+)+$")
    head = F.slice(segments, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.when(n == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.when(star, F.concat(head, F.array(F.lit("*")))).otherwise(segments), "/")))


def skipped_url(url: Column, stop: Iterable[str]) -> Column:
    """Whether a path segment, or a part of one between hyphens or underscores, is a stop word."""
    segments = F.split(F.lower(path(url)), "/")
    tokens = F.flatten(F.transform(segments, lambda s: F.split(s, "[-_]")))
    return F.arrays_overlap(F.concat(segments, tokens), F.array(*map(F.lit, stop)))


def url_priority(url: Column, first: Iterable[str]) -> Column:
    """0 if a path segment is among ``first``, else 1."""
    return F.when(F.arrays_overlap(F.split(F.lower(path(url)), "/"), F.array(*map(F.lit, first))), 0).otherwise(1)


def under_pattern(url: Column, pattern: str) -> Column:
    """Whether the path is strictly below a pattern like ``/items/*``."""
    if not pattern.endswith("/*"):
        return F.lit(False)
    p = path(url)
    return p.startswith(pattern[:-1]) & (F.length(p) > len(pattern) - 1)


def name_from_link(href: Column, page: Column) -> Column:
    """A name from an external link's domain; NULL for internal links and useless labels."""
    d = base_domain(href)
    label = F.split(d, r"\.")[0]
    return F.when((d != "") & (d != base_domain(page)) & (F.length(label) >= 2) & (label != "www"), F.initcap(label))


def _plain_letters() -> tuple[str, str]:
    """Characters whose compatibility decomposition without marks is one other character, and that character."""
    pairs = []
    for code in (*range(0xA1, 0x2500), *range(0xFF01, 0xFF5F)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _plain_letters()


def fold(c: Column, synonyms: dict[str, str] = C.SYNONYMS) -> Column:
    """For comparing values: lower case, no accents, one blank between words, known place names as one.

    Characters that decompose into several letters (ligatures) stay as they are."""
    bare = F.regexp_replace(F.translate(F.lower(F.coalesce(c.cast("string"), F.lit(""))), _MARKED, _PLAIN), r"\p{Mn}+", "")
    s = squeeze(bare)
    if not synonyms:
        return s
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.transform(F.array(s), lambda x: F.coalesce(F.try_element_at(table, x), x))[0]  # computes s once


def is_empty(c: Column) -> Column:
    """NULL, the empty string or 0."""
    return F.coalesce(c.cast("string").isin("", "0"), F.lit(True))


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * longest common subsequence / both lengths: the normalised insertion-deletion similarity, 0 to 100.

    One row of the table is folded over the characters of ``a`` (O(|a||b|): for names, after blocking).
    """
    second = F.filter(F.split(b, ""), lambda x: x != "")
    first = F.filter(F.split(a, ""), lambda x: x != "")
    zero = F.transform(second, lambda x: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        cells = F.transform(second, lambda y, j: F.struct((y == x).alias("same"), F.when(j > 0, F.element_at(above, j)).otherwise(0).alias("corner"), F.element_at(above, j + 1).alias("up")))
        step = lambda done, cell: F.concat(done, F.array(F.when(cell["same"], cell["corner"] + 1).otherwise(F.greatest(cell["up"], F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))))))
        return F.aggregate(cells, F.array().cast("array<int>"), step)

    lcs = F.coalesce(F.try_element_at(F.aggregate(first, zero, row), F.lit(-1)), F.lit(0))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * lcs / total)


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))
