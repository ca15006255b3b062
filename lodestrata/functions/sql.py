"""The library's functions for SQL: ``register_all(spark)`` makes them known to a session, for use in ``spark.sql``.

Scalar functions and table functions whose body is SQL run in the JVM, where Catalyst unfolds them into the query; the
similarity of texts and the elements of a page are Arrow and Python functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators.dom import _tree
from ..operators.rewording import _ratios


def _rx(pattern: str) -> str:
    """A pattern as a raw SQL literal."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


_EDGE_BEFORE, _EDGE_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_FORMS = f"{_EDGE_BEFORE}(?:{'|'.join(C.LEGAL_FORMS)}){_EDGE_AFTER}"

#: Name, parameters, result and body of each SQL function, in the order in which they build on one another.
SCALARS = [
    ("stripped_text", "s STRING", "STRING", f"regexp_replace(s, {_rx(r'^\s+|\s+$')}, '')"),
    ("squeezed_text", "s STRING", "STRING", f"stripped_text(regexp_replace(s, {_rx(r'\s+')}, ' '))"),
    ("base_domain", "url STRING", "STRING", f"regexp_replace(lower(regexp_extract(url, {_rx('^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)')}, 1)), {_rx(r'^www\.')}, '')"),
    ("normalize_name", "name STRING", "STRING", f"coalesce(squeezed_text(regexp_replace(regexp_replace(lower(stripped_text(name)), {_rx(_FORMS)}, ''), {_rx(r'[^\p{L}\p{N}_\s-]')}, '')), '')"),
    ("sorted_words", "s STRING", "STRING", f"array_join(array_sort(filter(split(s, {_rx(r'\s+')}), w -> w <> '')), ' ')"),
    ("file_slug", "s STRING", "STRING", f"regexp_replace(regexp_replace(replace(replace(replace(replace(lower(stripped_text(s)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '_'), {_rx('^_+|_+$')}, '')"),
    ("distance_km", "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", "2 * 6371.0D * asin(sqrt(least(1.0D, pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)))) + IF(lat1 IS NULL OR lon1 IS NULL OR lat2 IS NULL OR lon2 IS NULL, NULL, 0.0D)"),
    ("headline_like", "name STRING", "BOOLEAN", f"length(name) > 45 OR size(filter(split(name, {_rx(r'\s+')}), w -> w <> '')) > 6 OR name RLIKE {_rx(r'[?!:;–—]|\.\s')} OR (contains(name, ' ') AND endswith(name, '.'))"),
    ("vector_cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x), sqrt(aggregate(a, 0.0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0.0D, (s, x) -> s + x * x))), 0.0D)"),
]
#: Table functions in SQL: name, parameters, columns and body.
TABLES = [
    ("name_tokens", "name STRING", "token STRING", "SELECT explode(tokens) FROM (SELECT filter(array_distinct(split(normalize_name(name), ' ')), w -> w <> '') AS tokens)"),
    ("text_windows", "s STRING, size INT, step INT", "start INT, part STRING", "SELECT i * step, substr(s, i * step + 1, size) FROM (SELECT explode(sequence(0, greatest(0, (length(s) - 1) div step))) AS i) WHERE length(s) > 0"),
]


class PageElements:
    """The elements of a page: node, last, parent, depth, tag, id, href and the text's place."""

    def eval(self, html: str) -> Iterator[tuple]:
        for r in _tree(html, 0):
            yield r["node"], r["last"], r["parent"], r["depth"], r["tag"], r.get("id"), r.get("href"), r["text_from"], r["text_to"]


def reworded_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    fold = lambda s: s.fillna("").map(lambda x: " ".join(sorted(x.lower().split())))
    return _ratios(fold(a), fold(b))


def register_all(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session, as temporary ones; gives their names."""
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, parameters, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    spark.udf.register("reworded_ratio", F.pandas_udf(reworded_ratio, "double"))
    spark.udtf.register("page_elements", F.udtf(PageElements, returnType="node int, last int, parent int, depth int, tag string, id string, href string, text_from int, text_to int"))
    return [x[0] for x in [*SCALARS, *TABLES]] + ["reworded_ratio", "page_elements"]
