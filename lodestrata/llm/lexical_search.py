"""Ranked lexical search: an inverted index in shards of documents, searched one document after another.

Index. A task deals the documents that it reads into shards of a bounded size of text, without a shuffle. In a shard
documents are numbered by ascending doc_id; a term's postings are pairs of (distance to the number before, occurrences),
each number in 7-bit groups. The index is a table: a row for each shard and term, and one row for each shard (its term is null)
with its documents' ids and lengths. It holds every term of every document and is written once.

Search. Items are taken in blocks of a bounded number of words. The terms of a block are joined with the index, which
gives their document frequencies and weights; their postings meet by shard, a group whose size the shard bounds. For each
item, a heap of cursors (next document, term) merges its terms' postings by document: cursors that have reached a
window of documents add up its scores, then the next window begins where the foremost cursor stands. Scores go to
a bounded heap keyed by score, then doc_id; a window that can't beat its least entry is passed over. The best of
each shard are merged by item, again keeping the first k only in every task before the shuffle.

Score, in 64-bit integers: a term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); a document with n of the L terms in N
documents has m = 100 - 25 + (25 n N) div L; the score sums weight * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms,
repeats included.

Defined cases: null text has no terms; a document without terms isn't counted; rows with equal ids are documents of their
own, as are equal items; null ids are found, too, after others of equal score; an item without known terms has no rows;
an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, id_text, written

#: ASCII letters in lower case, digits and bytes of other characters stay; all else parts terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of text in a shard, at most, or one text.
SHARD = 1 << 25
#: Documents whose scores are summed at once.
WINDOW = 1024
_NULL = np.iinfo(np.int64).max
INDEX = "shard long, term string, df long, occurrences long, postings binary"


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def term_pieces(raw: bytes, piece: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a text, in lists from about ``piece`` bytes of it each."""
    start = 0
    while len(raw) - start > piece:
        end = start + piece
        while end < len(raw) and _TABLE[raw[end]] != 32:
            end += 1
        yield terms(raw[start:end])
        start = end
    yield terms(raw[start:])


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers in 7-bit groups, lowest first, the last with its high bit set; and the bytes each takes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >> np.uint64(7 * k) > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        at = size > k
        out[(ends - size)[at] + k] = (values[at] >> np.uint64(7 * k)).astype(np.uint8) & 127
    out[ends - 1] |= 128
    return out, size


def from_bytes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b & 128)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts) if len(ends) else np.zeros(0, np.int64)


class Shard:
    """Documents of one shard while they are read."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.sizes, self.parts, self.bytes = [], [], [np.zeros(0, np.int64)], 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        new = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in term_pieces(raw)]
        if size := sum(map(len, new)):
            self.ids.append(_NULL if doc_id is None else doc_id)
            self.sizes.append(size)
            self.parts += new
            self.bytes += len(raw)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The index rows: the documents', then the terms'."""
        ids, sizes = np.array(self.ids, np.int64), np.array(self.sizes, np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        documents = np.concatenate([ids[order], sizes[order]]).astype("<i8").tobytes()
        n = len(self.number)
        # one number for each (term, document): sorted, equal ones stand together, by term, then document
        pairs, tf = np.unique(np.concatenate(self.parts) * len(ids) + np.repeat(place, sizes), return_counts=True)
        term, doc = np.divmod(pairs, len(ids))
        df = np.bincount(term, minlength=n)
        gap = np.diff(doc, prepend=0)
        first = np.cumsum(df) - df
        gap[first] = doc[first]
        flat, size = to_bytes(np.stack([gap, tf], 1).ravel())
        cuts = np.concatenate([[0], np.cumsum(np.add.reduceat(size, 2 * first))])
        if cuts[-1] >= 1 << 31:
            raise ValueError("a shard's postings exceed 2 GB: lower its bound")
        blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
        names, schema = pa.array(list(self.number), pa.binary()).cast(pa.string()), ["shard", "term", "df", "occurrences", "postings"]
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.nulls(1, pa.string()), pa.array([len(ids)], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([documents], pa.binary())], names=schema)
        whole = [pa.array(np.full(n, shard), pa.int64()), names, pa.array(df, pa.int64()), pa.array(np.add.reduceat(tf, first), pa.int64()), blobs]
        for at in range(0, n, 1 << 16):
            yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 16) for c in whole], names=schema)


def build_index(docs: DataFrame, shard_bytes: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows, written to the shared folder: shard, term, df, occurrences, postings; the row of a shard's
    documents has no term, their number as df and their terms as occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_buffer().to_pybytes())
                if shard.bytes >= shard_bytes:
                    yield from shard.rows(number)
                    number, shard = number + 1, Shard()
        if shard.ids:
            yield from shard.rows(number)

    return written(id_text(docs, id_col, text_col).mapInArrow(run, INDEX), "postings", compression="zstd")


class Cursors:
    """A shard's postings of the wanted terms: documents and what an occurrence there is worth, without the weight."""

    def __init__(self, documents: bytes, names: list[str], dfs: np.ndarray, blobs: list[bytes], weights: np.ndarray, n_docs: int, n_terms: int):
        both = np.frombuffer(documents, "<i8").astype(np.int64)
        self.ids, sizes = both[: len(both) // 2], both[len(both) // 2 :]
        m = 75 + (25 * sizes * n_docs) // n_terms
        pairs = from_bytes(b"".join(blobs)).reshape(-1, 2)
        ends, docs = np.cumsum(dfs), np.cumsum(pairs[:, 0])
        docs -= np.repeat(np.concatenate([[0], docs])[ends - dfs], dfs)  # distances start anew with each term
        worth = (1_000_000_000 * pairs[:, 1]) // (1000 * pairs[:, 1] + 12 * m[docs]) * np.repeat(weights, dfs)
        cut = lambda x: np.split(x, ends[:-1])
        self.lists = {t: (d, v, int(v.max())) for t, d, v in zip(names, cut(docs), cut(worth), strict=True)}

    def best(self, wanted: Counter, k: int, window: int = WINDOW) -> list[tuple[int, int]]:
        """The ``k`` best documents of an item's terms: (score, number), the best first; those of no score aren't found."""
        own = [(*self.lists[t], times) for t, times in wanted.items() if t in self.lists]
        at, result = [0] * len(own), []  # the result heap holds (score, -number): its least entry goes first
        heap = [(int(docs[0]), i) for i, (docs, *_) in enumerate(own)]
        heapq.heapify(heap)
        total = np.zeros(window, np.int64)
        while heap:
            low, high, due, bound = heap[0][0], heap[0][0] + window, [], 0
            while heap and heap[0][0] < high:
                _, i = heap[0]
                docs, worth, most, times = own[i]
                start, at[i] = at[i], int(docs.searchsorted(high))
                due.append((docs[start : at[i]], worth[start : at[i]], times))
                bound += most * times
                if at[i] < len(docs):
                    heapq.heapreplace(heap, (int(docs[at[i]]), i))
                else:
                    heapq.heappop(heap)
            least = result[0][0] if len(result) == k else 0
            if bound <= least:  # documents come in order: an equal score would lose the tie
                continue
            total[:] = 0
            for docs, worth, times in due:
                total[docs - low] += worth * times
            for d in np.flatnonzero(total > least).tolist():
                entry = (int(total[d]), -(low + d))
                if len(result) < k:
                    heapq.heappush(result, entry)
                elif entry > result[0]:
                    heapq.heapreplace(result, entry)
        return [(score, -d) for score, d in sorted(result, reverse=True)]


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Items as (id, their terms' counts), in blocks of at most ``most`` terms each, or one item."""
    block, held = [], 0
    for item_id, text in items.toLocalIterator():
        own = Counter(t.decode("utf-8", "surrogatepass") for t in terms((text or "").encode("utf-8", "surrogatepass")))
        if block and held + len(own) > most:
            yield block
            block, held = [], 0
        block.append((item_id, own))
        held += len(own)
    if block:
        yield block


def _best_of_shards(index: DataFrame, block: list[tuple], first: int, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """The ``k`` best documents of each shard for each item of a block, whose items are numbered from ``first``."""
    wanted = sorted({t for _, own in block for t in own})
    names = index.sparkSession.createDataFrame([(t,) for t in wanted], "term string")
    df = index.select("term", "df").join(F.broadcast(names), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000.0 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weights = df.select("term", weight.alias("weight"))  # no more rows than the block has terms
    rows = index.drop("occurrences").join(F.broadcast(weights), "term", "left").where("term IS NULL OR weight IS NOT NULL")

    def run(t: pa.Table) -> pa.Table:
        own = t.filter(pa.compute.is_valid(t["term"]))
        out: list[list[int]] = [[], [], []]
        if own.num_rows:
            documents = t.filter(pa.compute.is_null(t["term"]))["postings"][0].as_py()
            shard = Cursors(documents, own["term"].to_pylist(), own["df"].to_numpy(), own["postings"].to_pylist(), own["weight"].to_numpy(), n_docs, n_terms)
            for item, (_, counts) in enumerate(block, first):
                for score, d in shard.best(counts, k):
                    for column, x in zip(out, (item, None if (i := int(shard.ids[d])) == _NULL else i, score), strict=True):
                        column.append(x)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["item", "doc_id", "score"])

    return rows.groupBy("shard").applyInArrow(run, "item long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 100_000, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each row of ``items``, those of no score left out: item_id, rank (from 1), doc_id, score.

    Items are the stated query set: the driver holds a block of them at a time (``block_terms`` terms), and each block takes one pass
    over the index rows of its terms.
    """
    spark = index.sparkSession
    items = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    n_docs, n_terms = index.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("occurrences"), F.lit(0))).first()
    found, first = spark.createDataFrame([], f"item long, doc_id long, score long, item_id {kind}"), 0
    for block in _blocks(items, block_terms) if n_docs else ():
        ids = spark.createDataFrame([(first + i, item_id) for i, (item_id, _) in enumerate(block)], f"item long, item_id {kind}")
        best = _best_of_shards(index, block, first, k, int(n_docs), int(n_terms))
        found = found.unionByName(best.join(F.broadcast(ids), "item"))
        first += len(block)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
