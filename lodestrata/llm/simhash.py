"""SimHash fingerprints and near duplicates by covering locality-sensitive hashing.

Each of the 64 bits has a non-zero vector of r + 1 bits; table v (1 <= v < 2**(r+1)) keeps the bits whose vector has an
odd product with v. The vectors of at most r differing bits span at most r dimensions, so some v is orthogonal to all
of them: in that table both fingerprints have the same key. No pair within the radius is missed.

Work is on distinct fingerprints, so a group of copies is one. A bucket of a table is compared within one task while it
is small; a large one is cut into blocks, and each pair of blocks is a task's work of fixed size. A task reports a
spanning forest of the links it sees, not all pairs.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and links like any other; a text of fewer
words than a shingle is one shingle; rows with equal ids each have their own row; null ids never name a component unless
it has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import SLICE, id_text, sliced, word_pieces, written

#: Fingerprints of a bucket that are compared as one block.
BLOCK = 4096


def _add(words: list[bytes], width: int, seed: int, ones: np.ndarray) -> int:
    """Adds the bits of the words' shingles to ``ones``; how many shingles there are."""
    n = len(words) - width + 1
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts, ends = (ends - size + 1)[:n], ends[width - 1 :]
    for i in range(0, n, 1 << 14):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[i : i + (1 << 14)].tolist(), ends[i : i + (1 << 14)].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return n


def fingerprint(text: str, width: int = 3, seed: int = 42, piece: int = SLICE) -> int:
    """The SimHash of a text's word shingles, unsigned. A long text is taken piece by piece, so that memory beyond the
    text itself doesn't grow with it."""
    ones, n, carry = np.zeros(64, np.int64), 0, []
    for words in word_pieces(text.encode("utf-8", "surrogatepass").lower(), piece):  # of bytes: only ASCII letters
        words = carry + words
        if len(words) >= width:
            n += _add(words, width, seed, ones)
            words = words[len(words) - width + 1 :]
        carry = words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(carry), seed) if carry else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            fps = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The 2**(radius + 1) - 1 structured masks, as signed integers."""
    vectors = [1 + i * 7 % (2 ** (radius + 1) - 1) for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints, by search from one after another."""
    rest, a, b = np.unique(fps).view(np.uint64), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]).view(np.int64), np.concatenate([none, *b]).view(np.int64)


def _links_of_buckets(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None
        for batch in _and_end(batches):
            if batch is None:
                groups, keep = keep, None
            else:
                now = np.stack([batch.column(i).to_numpy() for i in range(5)])
                now = now if keep is None else np.concatenate([keep, now], 1)
                last = (now[:4] == now[:4, -1:]).all(0)  # the last group may go on
                groups, keep = now[:, ~last], now[:, last]
            if groups is None or not groups.shape[1]:
                continue
            a, b = _pairs(groups, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _and_end(batches):
    yield from batches
    yield None


def _pairs(groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: small ones by comparing neighbours at every distance, large ones by search."""
    fps = groups[4]
    new = np.ones(len(fps), bool)
    new[1:] = (groups[:4, 1:] != groups[:4, :-1]).any(0)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fps)))
    number = np.cumsum(new) - 1
    out_a, out_b = [], []
    small = sizes[number] <= 16
    x, g = fps[small].view(np.uint64), number[small]
    for lag in range(1, 16):
        same = np.flatnonzero(g[lag:] == g[:-lag]) if len(g) > lag else []
        if not len(same):
            break
        near = same[np.bitwise_count(x[same] ^ x[same + lag]) <= radius]
        out_a.append(x[near].view(np.int64))
        out_b.append(x[near + lag].view(np.int64))
    for k in np.flatnonzero(sizes > 16):
        a, b = _forest(fps[starts[k] : starts[k] + sizes[k]], radius)
        out_a.append(a)
        out_b.append(b)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def near_links(distinct: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``radius`` of one another, from distinct ``fp``."""
    masks = F.array(*[F.lit(m) for m in covering_masks(radius)])
    tables = distinct.select("fp", F.posexplode(masks).alias("t", "mask")).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    full = tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = tables.join(full, ["t", "key"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).otherwise(0)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    rows = rows.select(F.col("t").cast("long"), "key", F.least("own", "other").cast("long").alias("p"), F.greatest("own", "other").cast("long").alias("q"), "fp")
    dealt = rows.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q")
    return dealt.mapInArrow(_links_of_buckets(radius), "a long, b long").distinct()


def near_components(docs: DataFrame, width: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    prints = written(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(near_links(distinct.select("fp"), radius, block)).withColumnRenamed("node", "fp")
    classes = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, width: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group stays."""
    found = near_components(docs, width, radius, seed, id_col, text_col)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("lodestrata_kept_id")).distinct()
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("lodestrata_kept_id")), "left_semi")
