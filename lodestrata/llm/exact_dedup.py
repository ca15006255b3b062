"""Exact deduplication by a log-structured merge index of digests, in DataFrame operations only.

* Rows are logged first: digest and id, once. Each part of the log is a memtable of about MEMTABLE_ROWS rows at most: combined by
  digest (partial sums come before the shuffle, so a digest with a third of all rows is one row a task) and flushed as a
  run, a table in buckets of digests, sorted within them.
* Compaction merges runs two by two, level by level, until one is left: of each digest the smallest id and the number
  of rows. Buckets meet buckets in a sorted merge, so no level shuffles anything. Runs leave the catalog when the index's hits are written.
* A run's files have Bloom filters of their digests, for ``lookup`` of single digests; whole tables are tested by the index's
  filter instead:
* The index's filter has eight bits for each digest of several rows and is broadcast while it has at most FILTER_BITS
  bits; beyond that the digests themselves are joined. Rows that the filter doesn't hold are alone: they are settled
  where they are logged, and neither they nor their texts are shuffled.
* Hits receive byte verification: of a digest's texts the smallest and the largest must be the same bytes. That
  aggregate, too, combines before the shuffle. Digests that fail are grouped anew by their text.
* Hits get their group from the index. Digests with more than a HOT-th of all rows, of which there are fewer than HOT,
  are broadcast, so their rows stay where they are; the others meet theirs in a join.

Defined cases: null text counts as empty; rows with a null id are copies like others, but any id comes before null as
the one to keep; rows that repeat both id and text are the same document and are marked alike (``deduplicate`` leaves
one of them); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, id_text, scratch, written

#: Most bits (as a power of two) of the filter that is broadcast: 32 MB.
FILTER_BITS = 28
#: Rows of a memtable, about: what one flush combines and shuffles.
MEMTABLE_ROWS = 1 << 26
#: A digest with more than this share of all rows (one in so many) is hot.
HOT = 1000


def normalised(text: Column) -> Column:
    """Every run of white space is one blank."""
    return F.regexp_replace(text, SPACE_CLASS, " ")


def _key(text: Column, digest_bytes: int) -> tuple[Column, Column]:
    sha = F.unhex(F.sha2(text, 256))
    return sha, (sha if digest_bytes == 32 else F.substring(sha, 1, digest_bytes))


def log(docs: DataFrame, digest_bytes: int = 32, memtables: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as (digest, sha, doc_id, memtable), a folder a memtable."""
    sha, digest = _key(normalised(F.col("text")), digest_bytes)
    memtable = F.pmod(F.xxhash64("doc_id", "text"), F.lit(memtables)).cast("int")
    rows = id_text(docs, id_col, text_col).select(digest.alias("digest"), sha.alias("sha"), "doc_id", memtable.alias("memtable"))
    path = scratch(docs.sparkSession, "log")
    rows.write.partitionBy("memtable").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _run(entries: DataFrame, most: int, made: list[str]) -> DataFrame:
    """``entries`` (digest, keep_id, group_size; ``most`` rows at most) as a table in sorted buckets, whose name is added to
    ``made``. Each file has a Bloom filter for its share of the digests."""
    spark = entries.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"lodestrata_run_{uuid.uuid4().hex}"
    bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(most * 3 // (2 * buckets) + 64)}
    entries.write.options(**bloom).bucketBy(buckets, "digest").sortBy("digest").option("path", scratch(spark, "run")).saveAsTable(name)
    made.append(name)
    return spark.table(name)


def flush(memtable: DataFrame, made: list[str] | None = None) -> DataFrame:
    """A run of a memtable's rows: digest, keep_id, group_size. The names of tables go to ``made``, for who drops them."""
    made = [] if made is None else made
    return _run(memtable.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), memtable.count(), made)


def merge(a: DataFrame, b: DataFrame, made: list[str]) -> DataFrame:
    """Two runs as one."""
    sizes = F.coalesce(a["group_size"], F.lit(0)) + F.coalesce(b["group_size"], F.lit(0))
    both = a.join(b, "digest", "full").select("digest", F.least(a["keep_id"], b["keep_id"]).alias("keep_id"), sizes.alias("group_size"))
    return _run(both, a.count() + b.count(), made)


def compact(runs: list[DataFrame], made: list[str] | None = None) -> DataFrame:
    """One run of all, level by level."""
    made = [] if made is None else made
    while len(runs) > 1:
        runs = [merge(*runs[i : i + 2], made) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def lookup(run: DataFrame, digest: bytes) -> DataFrame:
    """The entry of a digest; the bucket, the order and the files' Bloom filters let the reader skip the rest."""
    return run.filter(F.col("digest") == F.lit(digest))


def _place(digest: Column, bits: int) -> Column:
    """The leading ``bits`` bits of a digest (short digests count as filled up with zeros)."""
    head = F.conv(F.rpad(F.hex(F.substring(digest, 1, 4)), 8, "0"), 16, 10).cast("long")
    return F.shiftrightunsigned(head, 32 - bits)


def hit_filter(hits: DataFrame, bits: int) -> DataFrame:
    """Bitmap of digests: 2**bits / 8 bytes at most, in rows of 4 kB."""
    marked = hits.select(_place(F.col("digest"), bits).alias("place"))
    return marked.groupBy(F.expr("bitmap_bucket_number(place + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place + 1))").alias("bitmap"))


class Hits:
    """What an index has of digests with several rows, and the filter that tells which rows may be among them."""

    def __init__(self, index: DataFrame, most_bits: int = FILTER_BITS):
        self.hits = written(index.filter("group_size > 1"), "hits")
        n, rows = index.agg(F.count_if(F.col("group_size") > 1), F.sum("group_size")).first()
        self.bits = max(10, (8 * n).bit_length())
        self.filters = written(hit_filter(self.hits, self.bits), "filter") if self.bits <= most_bits else None
        self.hot = self.hits.filter(F.col("group_size") > max(10_000, (rows or 0) // HOT))

    def may_hold(self, rows: DataFrame) -> DataFrame:
        """The rows (with ``digest``) that the index may have others of."""
        if self.filters is None:
            return rows.join(self.hits.select("digest"), "digest", "left_semi")
        return self._tested(rows).filter("lodestrata_hit").drop("lodestrata_hit")

    def _tested(self, rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("place", _place(F.col("digest"), self.bits)).withColumn("bucket", F.expr("bitmap_bucket_number(place + 1)"))
        bit = "bit_get(cast(conv(hex(substring(bitmap, cast(bitmap_bit_position(place + 1) div 8 + 1 as int), 1)), 16, 10) as int), cast(bitmap_bit_position(place + 1) % 8 as int)) = 1"
        return placed.join(F.broadcast(self.filters), "bucket", "left").withColumn("lodestrata_hit", F.coalesce(F.expr(bit), F.lit(False))).drop("bucket", "place", "bitmap")

    def entries(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, digest, sha) with keep_id and group_size."""
        own = (F.coalesce("group_size", F.lit(1)) == 1, F.col("doc_id"))
        columns = ["doc_id", "digest", "sha", F.when(*own).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")]
        hot = F.broadcast(self.hot)  # fewer than HOT rows
        several = rows.join(hot, "digest")
        rest = rows.join(hot.select("digest"), "digest", "left_anti")
        if self.filters is None:
            return several.select(*columns).unionByName(rest.join(self.hits, "digest", "left").select(*columns))
        tested = self._tested(rest)
        alone = tested.filter("NOT lodestrata_hit").select("doc_id", "digest", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        met = tested.filter("lodestrata_hit").join(self.hits, "digest", "left")
        return several.select(*columns).unionByName(alone).unionByName(met.select(*columns))


def find_copies(docs: DataFrame, digest_bytes: int = 32, filter_bits: int = FILTER_BITS, memtables: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, keep_id (smallest id of its equal texts), group_size, kept, text_sha256.

    ``digest_bytes`` is how much of the SHA-256 the index keeps; with fewer bytes more is left to verification, with
    the same result. There are as many memtables as MEMTABLE_ROWS asks for, two at least, unless a number is given.
    """
    memtables = memtables or max(2, -(-docs.count() // MEMTABLE_ROWS))
    made: list[str] = []
    rows = log(docs, digest_bytes, memtables, id_col, text_col)
    index = compact([flush(rows.filter(F.col("memtable") == k), made) for k in range(memtables)], made)
    hits = Hits(index, filter_bits)
    for name in made:  # nothing reads the runs from here on
        docs.sparkSession.sql(f"DROP TABLE {name}")

    texts = id_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("text"))
    sha, digest = _key(F.col("text"), digest_bytes)
    texts = texts.withColumn("sha", sha).withColumn("digest", digest)
    checked = hits.may_hold(texts).groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    clashes = written(checked.filter("low <> high").select("digest"), "clashes")

    rows, columns = rows.select("doc_id", "digest", "sha"), ["doc_id", "keep_id", "group_size", "sha"]
    if clashes.isEmpty():
        out = hits.entries(rows).select(*columns)
    else:
        mixed = texts.join(clashes, "digest", "left_semi")
        groups = mixed.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = hits.entries(rows.join(clashes, "digest", "left_anti")).select(*columns)
        out = out.unionByName(mixed.join(groups, ["digest", "text"]).select(*columns))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the smallest id, once."""
    kept = written(find_copies(docs, id_col=id_col, text_col=text_col).filter("kept").select("doc_id", "text_sha256"), "kept")
    id_name, sha_name = "lodestrata_kept_id", "lodestrata_kept_sha"
    slim = kept.groupBy("doc_id", "text_sha256").count()
    repeated = not slim.filter("count > 1").isEmpty()
    keys = (slim if repeated else kept).select(F.col("doc_id").alias(id_name), F.col("text_sha256").alias(sha_name))
    text = normalised(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    marked = docs.withColumn("lodestrata_sha", F.sha2(text, 256))
    out = marked.join(keys, F.col(id_col).cast("long").eqNullSafe(F.col(id_name)) & (F.col("lodestrata_sha") == F.col(sha_name)), "left_semi")
    if repeated:
        out = out.dropDuplicates([id_col, "lodestrata_sha"])
    return out.drop("lodestrata_sha")
