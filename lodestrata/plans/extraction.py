"""Queries that take records out of texts, with a rule in the place of a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from ..session import table
from .registry import query
from .text import FOREIGN, GROUPS


def line_answers(spark, sf_dir):
    """Documents with an answer as services give them: fenced, after thoughts, cut off or with nothing in it, by the event of the
    same number."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    how = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), k.alias("k"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", X.line_answers(F.col("text")).alias("said")).join(how, "doc_id", "left")
    said, k = F.col("said"), F.col("k")
    fenced = F.concat(F.lit("<think>{</think>\n```json\n"), said, F.lit("\n```"))
    answer = F.when(k % 7 == 0, F.left(said, F.ceil(F.length(said) / 2))).when(k % 5 == 0, fenced).when(k % 11 == 0, "{}").otherwise(said)
    return d.select("doc_id", "text", answer.alias("answer"))


@query()
def extracted_records(spark, sf_dir):
    """Every record of every answer, with its state and what of it the text doesn't support."""
    fields = [f for f in X.FIELDS if f in ("name", "website", "founded_year", "contact_info", "founders")]
    return X.records(line_answers(spark, sf_dir), "text").select("doc_id", F.col("pos").cast("long").alias("pos"), "state", *fields, "nulled", "dropped", F.length("source_excerpt").alias("excerpt_length"))


@query()
def article_records(spark, sf_dir):
    """Documents to records by overlapping chunks, those that are relevant, extraction and merging by name."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.to_date(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))).alias("day"))
    ask = lambda chunks: chunks.withColumn("answer", X.line_answers(F.col("chunk")))
    r = X.article_records(d, ask, GROUPS, ["source"], "text", "day", FOREIGN)
    return r.select("source", "name_key", "members", "name", "website", "contact_info", "founded_year", "published_date", "founders")
