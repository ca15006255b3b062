"""Benchmark decontamination as a prefix-filtered set join.

The windows of an item (13 words in a row; a shorter item is one window) are sets of word shingles. A document that
contains a window has all its shingles, so of a window's shingles, ordered by how rare they are in the corpus, the
first alone is the necessary prefix. Documents meet windows on that token; the token's place in the window and the
lengths bound where the window can stand; what is left is compared word by word.

The corpus is read twice, whatever the benchmark's size: once to count how often its shingles occur, once to match. Counts are
kept by a 64-bit hash for at most MOST_TOKENS shingles; beyond, hashes share that many counters, which makes the choice of a
prefix less good, never a result different. For matching the benchmark is dealt into chunks of at most ``chunk_words`` words, each
broadcast by itself, which take turns at a document in one stage: what a larger benchmark costs is workers' time and memory, a
chunk's each. Documents are never shuffled.

Defined cases: null text has no words, no hits and isn't contaminated; items without words or without id are no items;
items with equal ids are one; a window that several items have counts for each; empty tables give empty results or
no hits; repeated rows are judged each.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, id_text, written

#: Words of a benchmark chunk, the bound of what is broadcast.
CHUNK_WORDS = 200_000
#: Words of a shingle.
SHINGLE = 3
#: Shingles of the benchmark that are counted one by one: 32 MB of hashes.
MOST_TOKENS = 1 << 22
#: Words whose hashes a worker keeps.
MOST_WORDS = 500_000
#: Bytes other than word bytes become blanks, A-Z lower case; all bytes of characters from U+0080 on belong to words.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORK = T.StructType([T.StructField("lodestrata_n_words", T.LongType()), T.StructField("lodestrata_hits", T.ArrayType(T.IntegerType())), T.StructField("lodestrata_items", T.ArrayType(T.StringType()))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def word_hashes(own: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, none of them 0."""
    return np.fromiter((xxhash.xxh64_intdigest(w) | 1 for w in own), np.uint64, len(own))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The hash of each row of word hashes; rows of other lengths have others."""
    key = np.full(len(hashes), hashes.shape[1], np.uint64)
    for i in range(hashes.shape[1]):
        key = (key ^ hashes[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


class Hashes(dict):
    """Hashes of words; a blank, which stands between texts, has 0, and so has every word that no item has, if the items' words are few
    enough to be given. Else hashes are made as words come, and kept while they are few."""

    def __init__(self, own: list[bytes] | None):
        super().__init__({} if own is None else zip(own, word_hashes(own).tolist(), strict=True))
        self.whole = own is not None

    def __missing__(self, word: bytes) -> int:
        if self.whole or word == b" ":
            return 0
        if len(self) > MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) | 1
        return h

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        flat = chain.from_iterable((*t, b" ") for t in texts)
        n = sum(map(len, texts)) + len(texts)
        return np.fromiter(map(self.get, flat, repeat(0)) if self.whole else map(self.__getitem__, flat), np.uint64, n)


class Counts:
    """How often shingles occur, by their hash, or by what is left of it where hashes share counters."""

    def __init__(self, tokens: np.ndarray, shared: bool):
        self.tokens, self.shared = tokens, shared
        self.n = np.zeros(len(tokens), np.int64)
        bits = max(10, (16 * len(tokens)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.marks = np.zeros(1 << bits, bool)  # what most shingles of a corpus aren't among is told by one look
        self.marks[tokens * np.uint64(0x9E3779B97F4A7C15) >> self.shift] = True

    def folded(self, keys: np.ndarray) -> np.ndarray:
        return keys % np.uint64(MOST_TOKENS) if self.shared else keys

    def add(self, keys: np.ndarray) -> None:
        keys = self.folded(keys)
        keys = keys[self.marks[keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift]]
        i = np.minimum(np.searchsorted(self.tokens, keys), len(self.tokens) - 1)
        self.n += np.bincount(i[self.tokens[i] == keys], minlength=len(self.tokens))

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.n[np.minimum(np.searchsorted(self.tokens, self.folded(keys)), len(self.tokens) - 1)]


class WindowIndex:
    """Windows of a chunk of the benchmark, found by their rarest shingle."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, own in pieces:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own]
            for i in range(max(1, len(codes) - window + 1)):
                owners[tuple(codes[i : i + window])].add(item)
        self.windows = list(owners)
        self.owners = [sorted(x) for x in owners.values()]
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.codes = np.zeros((len(self.windows), window), np.int64)
        for i, w in enumerate(self.windows):
            self.codes[i, : len(w)] = w
        self.widths = sorted({min(SHINGLE, len(w)) for w in self.windows})

    def _key(self, codes) -> int:
        key = 0
        for c in codes:
            key = key * (len(self.vocabulary) + 1) + c
        return key

    def coded(self, texts: list[list[bytes]]) -> np.ndarray:
        """The words of texts as numbers, 0 for words that no window has and after each text."""
        flat = chain.from_iterable((*t, b" ") for t in texts)
        return np.fromiter(map(self.vocabulary.get, flat, repeat(0)), np.int64, sum(map(len, texts)) + len(texts))

    def keys(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where shingles of ``k`` known words begin, and their keys."""
        n = len(codes) - k + 1
        known = codes != 0
        ok = known[:n].copy()
        for i in range(1, k):
            ok &= known[i : n + i]
        at = np.flatnonzero(ok)
        key = codes[at]
        for i in range(1, k):
            key = key * (len(self.vocabulary) + 1) + codes[at + i]
        return at, key

    def choose(self, counts: "Counts") -> None:
        """Sets each window's prefix token: its rarest shingle, by the corpus counts."""
        names = list(self.vocabulary)
        hashes = np.concatenate([[0], word_hashes(names)]).astype(np.uint64)
        self.prefix = {}
        for k in self.widths:
            at = np.flatnonzero(np.minimum(SHINGLE, self.size) == k)
            places = self.codes.shape[1] - k + 1
            n = np.stack([counts.of(shingles(hashes[self.codes[at, i : i + k]])) for i in range(places)], 1)
            n[np.arange(places) > (self.size[at] - k)[:, None]] = np.iinfo(np.int64).max  # beyond a short window's end
            offset = n.argmin(1)
            key = np.array([self._key(self.windows[w][i : i + k]) for w, i in zip(at.tolist(), offset.tolist(), strict=True)], np.int64)
            order = np.lexsort((at, key))
            self.prefix[k] = (key[order], at[order], offset[order])

    def occurrences(self, codes: np.ndarray, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and the places where they stand in full."""
        for k in self.widths:
            at, key = self.keys(codes, k)
            tokens, window, offset = self.prefix[k]
            low, high = np.searchsorted(tokens, key, "left"), np.searchsorted(tokens, key, "right")
            some = high > low
            at, low, n = at[some], low[some], (high - low)[some]
            ends = np.cumsum(n)
            done = 0
            while done < len(at):
                to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + block, "right")))
                m = n[done:to]
                row = np.repeat(low[done:to] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                w, start = window[row], np.repeat(at[done:to], m) - offset[row]
                fits = (start >= 0) & (start + self.size[w] <= len(codes))  # places before the text or after its end
                w, start = w[fits], start[fits]
                for i in range(self.codes.shape[1]):
                    same = (i >= self.size[w]) | (codes[np.minimum(start + i, len(codes) - 1)] == self.codes[w, i])
                    w, start = w[same], start[same]
                yield w, start
                done = to


def _pieces(benchmark: DataFrame, window: int, piece: int = 4096) -> DataFrame:
    """Items as pieces of bounded length that overlap by a window less a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words(text)
                for i in range(0, max(1, len(own) - window + 1), piece):
                    if own and item is not None:
                        ids.append(item)
                        texts.append(b" ".join(own[i : i + piece + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary()), pa.array([t.count(b" ") + 1 for t in texts], pa.int64())], names=["item", "piece", "n"])

    return benchmark.mapInArrow(run, "item string, piece binary, n long")


def _tokens(pieces: DataFrame) -> Counts:
    """Counters for the shingles of all windows, without counts yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                h = word_hashes(piece.split())
                k = min(SHINGLE, len(h))
                keys = np.unique(shingles(np.lib.stride_tricks.sliding_window_view(h, k)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64), pa.int64()), pa.array(np.full(len(keys), k, np.int32))], names=["key", "k"])

    found = written(pieces.select("piece").mapInArrow(run, "key long, k int").distinct(), "shingles")
    shared = found.count() > MOST_TOKENS
    key = F.expr(f"cast(cast(key AS decimal(20, 0)) + IF(key < 0, 18446744073709551616BD, 0BD) AS decimal(20, 0)) % {MOST_TOKENS}").cast("long") if shared else F.col("key")
    rows = found.select(key.alias("key")).distinct().toPandas()["key"].to_numpy(np.int64)  # MOST_TOKENS at most
    return Counts(np.unique(rows.view(np.uint64)), shared)


def _vocabulary(pieces: DataFrame) -> list[bytes] | None:
    """The items' words, if there are at most MOST_WORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array({w for piece in batch.column(0).to_pylist() for w in piece.split()}, pa.binary())], names=["word"])

    found = pieces.select("piece").mapInArrow(run, "word binary").distinct().limit(MOST_WORDS + 1).collect()
    return [bytes(r[0]) for r in found] if len(found) <= MOST_WORDS else None


def _count(docs: DataFrame, counts: Counts, widths: list[int], own_words: list[bytes] | None) -> Counts:
    """The corpus counts, in one pass: a sum a token and task, then over tasks."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, own_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, own_words = shared.value
        own, hashes = Counts(given.tokens, given.shared), Hashes(own_words)
        for batch in batches:
            for s in byte_slices(pa.compute.binary_length(batch.column(0)).to_pylist(), 1 << 22):
                h = hashes.of([words(t) for t in batch.column(0)[s].to_pylist()])
                known = h != 0
                for k in widths:
                    n = len(h) - k + 1
                    if n > 0:
                        at = np.flatnonzero(np.logical_and.reduce([known[i : n + i] for i in range(k)]))
                        own.add(shingles(np.stack([h[at + i] for i in range(k)], 1)))
        at = np.flatnonzero(own.n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.n[at])], names=["token", "n"])

    for token, n in docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n")).collect():  # MOST_TOKENS at most
        counts.n[token] = n
    return counts


def _step(shared, text_at: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column(text_at)
            hits: list[list[int]] = []
            items: list[list[str]] = []
            sizes: list[int] = []
            for s in byte_slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist(), 1 << 22):
                own = [words(t) for t in texts[s].to_pylist()]
                n = np.array([len(x) for x in own], np.int64)
                codes, starts = index.coded(own), np.cumsum(n + 1) - n - 1
                marks, found = np.zeros(len(codes) + 1, np.int64), [set() for _ in own]
                for w, at in index.occurrences(codes):
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + index.size[w], -1)
                    pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, w]), axis=1)
                    for d, one in pairs.T.tolist():
                        found[d].update(index.owners[one])
                covered = np.flatnonzero(np.cumsum(marks))
                doc = np.searchsorted(starts, covered, "right") - 1
                place = covered - starts[doc] if len(covered) else covered
                cuts = np.searchsorted(doc, np.arange(len(own) + 1))
                hits += [place[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                items += [sorted(x) for x in found]
                sizes += n.tolist()
            columns = batch.columns
            if not first:
                columns, (_, had, owned) = columns[:-3], columns[-3:]
                hits = [sorted({*a, *b}) for a, b in zip(hits, had.to_pylist(), strict=True)]
                items = [sorted({*a, *b}) for a, b in zip(items, owned.to_pylist(), strict=True)]
            columns = [*columns, pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            names = batch.schema.names if not first else [*batch.schema.names, *_WORK.names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = 13, chunk_words: int = CHUNK_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with lodestrata_n_words, lodestrata_hits (places of hit words) and lodestrata_items (ids as strings)."""
    spark = docs.sparkSession
    pieces = _pieces(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")), window)
    total = pieces.agg(F.sum("n")).first()[0] or 0
    chunks = -(-total // chunk_words)
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    at, out = docs.columns.index(text_col), docs
    if not chunks:
        out = docs.withColumns({"lodestrata_n_words": F.lit(0).cast("long"), "lodestrata_hits": F.array().cast("array<int>"), "lodestrata_items": F.array().cast("array<string>")})
        return _word_counts(out, text_col)
    widths = [r[0] for r in pieces.select(F.least(F.col("n"), F.lit(SHINGLE)).alias("k")).distinct().collect()]
    counts = _count(texts, _tokens(pieces), widths, _vocabulary(pieces))
    for k in range(chunks):
        rows = pieces.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(chunks)) == k).collect()  # about chunk_words words
        if not rows and (k < chunks - 1 or out is not docs):
            continue
        index = WindowIndex([(r["item"], bytes(r["piece"]).split()) for r in rows], window)
        index.choose(counts)
        schema = T.StructType([*docs.schema.fields, *_WORK.fields])
        out = out.mapInArrow(_step(spark.sparkContext.broadcast(index), at, out is docs), schema)
    return out


def _word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    split = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    return docs.withColumn("lodestrata_n_words", split.cast("long"))


def _contaminated(per_hit: int) -> Column:
    hit = F.size("lodestrata_hits")
    return (hit > 0) & (per_hit * hit >= F.col("lodestrata_n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, per_hit: int = 20, chunk_words: int = CHUNK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0, per_hit * n_hit >= n_words)."""
    found = annotate(id_text(docs, id_col, text_col), benchmark, window, chunk_words)
    return found.select(
        "doc_id",
        F.col("lodestrata_n_words").alias("n_words"),
        F.size("lodestrata_hits").cast("long").alias("n_hit"),
        F.size("lodestrata_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("lodestrata_items", ","), 256).alias("items_sha256"),
        _contaminated(per_hit).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, per_hit: int = 20, chunk_words: int = CHUNK_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated."""
    return annotate(docs, benchmark, window, chunk_words, text_col).filter(~_contaminated(per_hit)).drop(*_WORK.names)


def items_digest(items: list[str]) -> str:
    """The digest of item ids, as ``contamination`` has it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
