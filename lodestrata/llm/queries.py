"""Queries opN_<name> of the training-data operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, encoding, exact_dedup, lexical_search, packing, periodic_runs, pii, quality, simhash, substring_dedup, toxicity, vector_packing
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = quality.fold("doc_id", 4) == 2
    model = toxicity.fit(docs, labels, train=~held_out)
    return toxicity.classify(docs, model, held_out, threshold=0.3)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), window=50)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(documents(spark, sf_dir))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir), width=3, radius=3, seed=42)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(documents(spark, sf_dir), benchmark, window=13, per_hit=20)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = packing.write_packed(documents(spark, sf_dir), packing.packed_path(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return packing.read_packed(manifest)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = quality.fold("doc_id", 5) == 0
    model = quality.fit(docs, labels, train=~held_out)
    return quality.classify(docs, model, held_out, threshold=0.3)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(documents(spark, sf_dir))
    return lexical_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
sizes AS (SELECT k, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
tf AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(w) AS term FROM d) GROUP BY k, term),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
q AS (SELECT item, item_id, term, count(*)::BIGINT AS times FROM (
        SELECT row_number() OVER () AS item, item_id,
            unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY item, item_id, term),
scores AS (SELECT q.item, q.item_id, s.doc_id,
        sum(q.times * weights.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * s.n * whole.docs) // whole.terms))))::BIGINT AS score
    FROM q JOIN weights USING (term) JOIN tf USING (term) JOIN sizes s USING (k), whole GROUP BY q.item, q.item_id, s.k, s.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = vector_packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, tokens=1024, segments=64)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.summary(periodic_runs.find_runs(periodic_runs.with_repeated_tails(documents(spark, sf_dir)), least=12))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op11_lexical_search": OP11_SQL}
