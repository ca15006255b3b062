"""Substring deduplication: passages of ``window`` words that a document with a smaller id has, too.

Shards. A window is assigned to the rarest-looking run of ``gram`` words within it (its anchor: the run with the least
hash), so equal windows have equal anchors wherever they stand. Consecutive windows with one anchor make a segment.
Anchors that stand in one text only can't be of a repeated window; the others' segments go to the shard of their anchor,
equal segments as one. Where an anchor has more different segments than a shard may hold, these are split: a window's new
key is its anchor together with the words around it that all windows share in which the anchor has about the same place,
in five steps down to the window itself. So keys depend on a window's words alone, equal windows stay together, no shard
grows with a group of copies or a common passage, and the shuffle is linear in the repeated text.

Index. Each shard has a compressed FM-index of its segments: the Burrows-Wheeler transform in a wavelet matrix of
packed bits with rank counts, the lengths of common prefixes up to ``window`` in one byte each with a tree of their
minima, and of each class of equal windows the smallest document. Segments are streamed through it right to left:
backward search keeps the interval of the longest match (matching statistics, up to ``window``), all segments of a shard
a word at a time; where the match is a whole window, the interval's class tells the smallest document that has it.

What is compared: the index compares words. Equal segments become one by 128 bits of XXH3, and texts that are copies as
a whole are settled before that by 128 bits of the SHA-256 of their words: of equal ones all but the smallest id lose
every word that a window covers. Neither digest is verified; anchors that differ in hash only cost a row.

Defined cases: null text has no words; a document of fewer words than a window keeps all; a null id counts as larger
than any other; rows with equal ids aren't earlier than one another; rows that repeat id and text have equal results;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, sliced, written

#: Words of a gram, most windows of a segment.
GRAM, SEGMENT = 20, 64
#: Segments that a shard has on average, and the most different ones that a key may have before they are split.
SHARD, MOST = 4000, 4096
#: Words whose grams are hashed at once.
_PIECE = 1 << 18
_LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


class Grams:
    """Hashes of runs of words by a rolling polynomial over their bytes."""

    def __init__(self, gram: int, piece: int = _PIECE):
        self.gram, self.piece = gram, max(piece, gram)
        self.up, self.down = _powers(_BASE, 1 << 12), _powers(_INVERSE, 1 << 12)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        n = len(words) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        if len(words) > self.piece:  # of very long texts piece by piece, which share gram - 1 words
            return np.concatenate([self(words[i : i + self.piece]) for i in range(0, n, self.piece - self.gram + 1)])
        raw = np.frombuffer(b" ".join(words), np.uint8)
        if len(raw) >= len(self.up):
            self.up, self.down = _powers(_BASE, 2 * len(raw)), _powers(_INVERSE, 2 * len(raw))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])[:n]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)])])
        h = (total[ends[self.gram - 1 :]] - total[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h.view(np.int64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def segments(words: list[bytes], grams: Grams, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a document's windows in runs: anchor, first window, end of windows."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none
    least = _least(grams(words), window - grams.gram + 1)
    change = np.flatnonzero(np.diff(least)) + 1
    starts = np.concatenate([none, [0], change])
    ends = np.concatenate([change, [len(least)]])
    parts = -(-(ends - starts) // SEGMENT)
    starts = np.repeat(starts, parts) + SEGMENT * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return least[starts], starts, np.minimum(starts + SEGMENT, np.repeat(ends, parts))


def _anchors(window: int, gram: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(gram, piece)
        for batch in sliced(batches, 2):
            n, sha, s1, s2, found = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                words = text.encode("utf-8", "surrogatepass").split()
                digest = hashlib.sha256(b" ".join(words))
                a, b = struct.unpack("<qq", digest.digest()[:16])
                n.append(len(words))
                sha.append(digest.hexdigest())
                s1.append(a)
                s2.append(b)
                found.append(segments(words, grams, window))
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([x[i] for x in found]), kind)) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), *lists], names=["doc", "tk", "n_words", "sha", "s1", "s2", "anchor", "low", "high"])

    return run, "doc long, tk long, n_words long, sha string, s1 long, s2 long, anchor array<long>, low array<int>, high array<int>"


def _extract(window: int):
    """Segments of documents with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            out: list[list] = [[] for _ in range(7)]
            for doc, tk, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                for span in spans:
                    raw = b" ".join(words[span["low"] : span["high"] + window - 1])
                    for column, x in zip(out, (span["anchor"], *_digest(raw), doc, tk, span["low"], raw), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(),) * 5 + (pa.int32(), pa.binary()), strict=True)], names=["key", "sa", "sb", "doc", "tk", "low", "raw"])

    return run, "key long, sa long, sb long, doc long, tk long, low int, raw binary"


def _digest(raw: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(raw))


def keys(words: list[bytes], grams: Grams, window: int, width: int) -> list[int]:
    """Of each window of a segment a key that only its own words decide: its first anchor and the words around it that
    all windows share whose anchor stands in the same ``width`` places as its own."""
    values, free, out = grams(words), window - grams.gram, []
    for w in range(len(words) - window + 1):
        at = int(np.argmin(values[w : w + free + 1]))
        low = at - at % width
        high = min(free, low + width - 1)
        out.append(xxhash.xxh3_64_intdigest(b" ".join(words[w + at - low : w + at + grams.gram + free - high])) - (1 << 63))
    return out


def _split(window: int, gram: int, width: int):
    """Parts of segments, cut where the keys of their windows change; ``low`` is their place in the segment (sa, sb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(gram, _PIECE)
        for batch in sliced(batches, 4):
            out: list[list] = [[] for _ in range(8)]
            for sa, sb, doc, low, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, start = raw.split(b" "), 0
                found = keys(words, grams, window, width)
                for w in range(1, len(found) + 1):
                    if w == len(found) or found[w] != found[start]:
                        part = b" ".join(words[start : w + window - 1])
                        for column, x in zip(out, (found[start], *_digest(part), doc, part, sa, sb, low + start), strict=True):
                            column.append(x)
                        start = w
            kinds = (pa.int64(),) * 4 + (pa.binary(),) + (pa.int64(),) * 2 + (pa.int32(),)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["key", "ca", "cb", "doc", "raw", "sa", "sb", "low"])

    return run, "key long, ca long, cb long, doc long, raw binary, sa long, sb long, low int"


def _too_many(rows: DataFrame, most: int, *segment: str) -> DataFrame:
    """Keys with more than ``most`` different segments, with the number of these."""
    sizes = rows.select("key", *segment).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("different"))
    return sizes if most < 0 else sizes.filter(F.col("different") > most)


def _refined(segments: DataFrame, window: int, gram: int, most: int) -> DataFrame:
    """Segments (key, ca, cb, doc, raw) of finer keys, with their places ``low`` in the segments (sa, sb) they are of."""
    done, rest = [], segments.select("sa", "sb", "doc", F.lit(0).alias("low"), "raw")
    for width in (16, 8, 4, 2, 1):
        run, schema = _split(window, gram, width)
        rows = written(rest.mapInArrow(run, schema), "refined")
        hot = written(_too_many(rows, most, "ca", "cb").select("key"), "hot-keys") if width > 1 else None
        if hot is None or hot.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(hot, "key", "left_anti"))
        rest = rows.join(hot, "key", "left_semi").select("sa", "sb", "doc", "low", "raw")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class WaveletMatrix:
    """Symbols below 2**levels as packed bits, with ranks by 64-bit words."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels = len(symbols), levels
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.bits.append(words)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place (both ends of an interval by two calls in one: stacked)."""
        start = np.zeros_like(symbol)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            both = np.concatenate([start, at])
            word = both >> 6
            ones = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1)))
            up = np.concatenate([symbol, symbol]) >> level & 1
            both = np.where(up == 1, self.zeros[k] + ones, both - ones)
            start, at = both[: len(symbol)], both[len(symbol) :]
        return at - start


class Marks:
    """Packed bits; ``rank`` is the number of the last mark at or before a place, from 0."""

    def __init__(self, marked: np.ndarray):
        packed = np.zeros((len(marked) // 64 + 1) * 8, np.uint8)
        raw = np.packbits(marked, bitorder="little")
        packed[: len(raw)] = raw
        self.bits = packed.view(np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int32)[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        to = (at & 63).astype(np.uint64)
        upto = self.bits[at >> 6] << (np.uint64(63) - to)
        return self.ranks[at >> 6] + np.bitwise_count(upto) - 1


class Below:
    """Where small integers first fall below a bound, by a binary tree of minima (twice their number of bytes)."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        size = 1 << int(self.n).bit_length()  # more than n: what stands after the last is below any bound
        level = np.zeros(size, values.dtype)
        level[: self.n] = values
        self.tree = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            self.tree.append(level)

    def first(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on (at most n) whose value is below ``bound`` (1 at least)."""
        at = at.copy()
        top = np.full(len(at), len(self.tree))  # level of the block that begins at ``at`` and holds it, once known
        for k, level in enumerate(self.tree):
            for again in (False, True):  # a block, and the one after it if it is the second of one above
                block = at >> k
                look = (top == len(self.tree)) & ((block & 1 == 1) | (not again))
                small = level[np.minimum(block, len(level) - 1)] < bound
                top[look & small] = k
                at[look & ~small] += 1 << k
        for k in range(len(self.tree) - 2, -1, -1):
            go = top > k
            left = np.minimum(at >> k, len(self.tree[k]) - 1)
            skip = go & (self.tree[k][left] >= bound)
            at[skip] += 1 << k
        return at


class FMIndex:
    """FM-index of texts (lists of words) with their documents, for matches of up to ``window`` words."""

    def __init__(self, texts: list[list[bytes]], docs: np.ndarray, window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        code = self.vocabulary
        flat = np.array([code.setdefault(w, len(code) + 1) for t in texts for w in (*t, b" ")], np.int64)  # b" " is no word
        code.pop(b" ", None)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        owner = np.repeat(docs, size)
        stop = np.cumsum(size) - 1
        flat[stop] = 0
        self.levels = max(1, int(max(code.values(), default=1)).bit_length())
        order, lcp = self._sorted(flat)
        self.counts = np.searchsorted(flat[order], np.arange(max(code.values(), default=0) + 2))
        self.bwt = WaveletMatrix(flat[order - 1], self.levels)  # before the first stands the last end
        self.n = len(order)
        self.lcp = lcp.astype(np.min_scalar_type(window))
        self.whole, self.nearly = Marks(lcp < window), Marks(lcp < window - 1)
        first = np.flatnonzero(lcp < window)
        self.smallest = np.minimum.reduceat(owner[order], first) if self.n else np.zeros(0, np.int64)
        self.starts = np.append(np.flatnonzero(lcp < window - 1), self.n).astype(np.int32)
        self.down, self.up = Below(self.lcp), Below(self.lcp[::-1])

    def _sorted(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of their first ``window`` words, by doubling; common prefixes with the row above."""
        n, ranks, have = len(flat), {1: flat}, 1
        pad = lambda r, k: np.concatenate([r[k:], np.zeros(min(k, n), np.int64)])[:n]
        while have < self.window:
            step = min(have, self.window - have)
            key = ranks[have] * (n + 2) + pad(ranks[have], step)
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))[:n]
            have += step
            ranks[have] = rank
        order = np.argsort(ranks[have], kind="stable")
        a, b = order[:-1].copy(), order[1:].copy()
        same = np.zeros(max(0, n - 1), np.int64)
        for k in sorted(ranks, reverse=True):
            for _ in range(2 if k > 1 else 1):
                inside = (a < n) & (b < n) & (same + k <= self.window)
                x, y = np.minimum(a, n - 1), np.minimum(b, n - 1)
                go = inside & (ranks[k][x] == ranks[k][y])
                same += k * go
                a, b = a + k * go, b + k * go
        return order, np.concatenate([[0], same])[:n]

    def _widen(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all rows that share ``depth`` words with those of the given intervals."""
        return self.n - 1 - self.up.first(self.n - 1 - low, depth), self.down.first(high, depth)

    def matching_statistics(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of every place of every text: the longest match that begins there, in words up to the window, and if it is a
        whole window the smallest document that has it (else the largest integer)."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        longest = len(texts[order[0]]) if texts else 0
        words = np.zeros((longest, len(texts)), np.int64)  # from the right; 0: not in the index
        for lane, i in enumerate(order):
            t = texts[i]
            words[: len(t), lane] = [self.vocabulary.get(w, 0) for w in reversed(t)]
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        low, high, depth = np.zeros(len(texts), np.int64), np.full(len(texts), self.n), np.zeros(len(texts), np.int64)
        lengths, docs = np.zeros_like(words), np.full(words.shape, _LAST)
        for step in range(longest):
            lanes = int(np.searchsorted(-sizes, -step, "left"))  # lanes with a word at this place
            a, b, d, c = low[:lanes], high[:lanes], depth[:lanes], words[step, :lanes]
            full = d == self.window
            if full.any():  # the last word goes before another comes
                k = self.nearly.rank(a[full])
                a[full], b[full], d[full] = self.starts[k], self.starts[k + 1], self.window - 1
            todo = np.arange(lanes)
            while len(todo):
                sym = c[todo]
                base = self.counts[sym]
                ranks = self.bwt.rank(np.concatenate([sym, sym]), np.concatenate([a[todo], b[todo]]))
                x, y = base + ranks[: len(todo)], base + ranks[len(todo) :]
                ok = (x < y) & (sym > 0)
                hit = todo[ok]
                a[hit], b[hit], d[hit] = x[ok], y[ok], d[hit] + 1
                todo = todo[~ok]
                lost = todo[(d[todo] == 0) | (c[todo] == 0)]
                a[lost], b[lost], d[lost] = 0, self.n, 0
                todo = todo[(d[todo] > 0) & (c[todo] > 0)]
                if len(todo):  # shorter, until more rows match
                    above = np.where(b[todo] < self.n, self.lcp[np.minimum(b[todo], self.n - 1)], 0).astype(np.int64)
                    d[todo] = np.minimum(d[todo] - 1, np.maximum(self.lcp[a[todo]], above))
                    a[todo], b[todo] = self._widen(a[todo], b[todo], d[todo])
            lengths[step, :lanes] = d
            whole = np.flatnonzero(d == self.window)
            docs[step, whole] = self.smallest[self.whole.rank(a[whole])]
        out: list = [None] * len(texts)
        for lane, i in enumerate(order):
            n = len(texts[i])
            out[i] = lengths[:n, lane][::-1], docs[:n, lane][::-1]
        return out


def _search(window: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        texts = [bytes(x).split(b" ") for x in shard["raw"]]
        index = FMIndex(texts, shard["doc"].to_numpy(np.int64), window)
        docs = []
        for i in range(0, len(texts), 2 * SHARD):
            docs += [d[: len(d) - window + 1] for _, d in index.matching_statistics(texts[i : i + 2 * SHARD])]
        return pd.DataFrame({"ca": shard["ca"], "cb": shard["cb"], "docs": docs})

    return run, "ca long, cb long, docs array<long>"


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            out: list[list] = [[], []]
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                marks = np.zeros(len(words) + 1, np.int64)
                at = np.array(starts, np.int64)
                np.add.at(marks, at, 1)
                np.add.at(marks, at + window, -1)
                gone = np.cumsum(marks)[:-1] > 0
                out[0].append(int(gone.sum()))
                out[1].append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["doc", "tk", "n_removed", "kept"])

    return run, "doc long, tk long, n_removed long, kept binary"


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = GRAM, most: int = MOST, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, piece: int = _PIECE) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one blank); ``with_text`` adds the
    kept words as ``kept_text``, null where nothing was removed."""
    gram = min(gram, window)
    rows = id_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("tk"), "text")
    run, schema = _anchors(window, gram, piece)
    places = written(rows.mapInArrow(run, schema), "anchors")

    slim = places.select("doc", "tk", "n_words", "sha", "s1", "s2")
    # aggregates are written before they are joined, so that a hot key's rows can be split in the join
    first = written(slim.groupBy("s1", "s2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "copies")
    flags = slim.join(first, ["s1", "s2"], "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("first"), F.lit(False))).drop("first", "s1", "s2")

    spans = places.select("doc", "tk", "s1", "s2", F.explode(F.arrays_zip("anchor", "low", "high")).alias("x")).select("doc", "tk", "s1", "s2", "x.*")
    repeated = spans.groupBy("anchor").agg(F.min("s1").alias("a"), F.max("s1").alias("b"), F.min("s2").alias("c"), F.max("s2").alias("d")).filter("a <> b or c <> d").select("anchor")
    found = spans.select("doc", "tk", "anchor", "low", "high").join(written(repeated, "repeated"), "anchor").groupBy("doc", "tk").agg(F.collect_list(F.struct("anchor", "low", "high")).alias("spans"))
    found = found.join(flags.filter(~F.col("copy")).select("doc", "tk").distinct(), ["doc", "tk"])
    texts = written(rows.join(found, ["doc", "tk"]).select("doc", "tk", "text", "spans"), "candidates")

    run, schema = _extract(window)
    parts = written(texts.mapInArrow(run, schema), "segments")
    sizes = written(_too_many(parts, -1, "sa", "sb"), "key-sizes")
    total, largest = sizes.agg(F.sum("different"), F.max("different")).first()
    shards = max(1, (total or 0) // shard)
    distinct = parts.groupBy("key", "sa", "sb").agg(F.min("doc").alias("doc"), F.max("raw").alias("raw"))
    places = parts.select(F.col("sa").alias("ca"), F.col("sb").alias("cb"), "doc", "tk", "low")
    leaves = distinct.select("key", F.col("sa").alias("ca"), F.col("sb").alias("cb"), "doc", "raw")
    if (largest or 0) > most:
        hot = sizes.filter(F.col("different") > most).select("key")
        finer = written(_refined(distinct.join(hot, "key", "left_semi"), window, gram, most), "finer")
        leaves = leaves.join(hot, "key", "left_anti").unionByName(finer.groupBy("key", "ca", "cb").agg(F.min("doc").alias("doc"), F.max("raw").alias("raw")))
        own = parts.join(hot, "key", "left_semi").select("sa", "sb", "doc", "tk", F.col("low").alias("at"))
        own = own.join(finer.select("ca", "cb", "sa", "sb", "low"), ["sa", "sb"]).select("ca", "cb", "doc", "tk", (F.col("at") + F.col("low")).alias("low"))
        places = parts.join(hot, "key", "left_anti").select(*(F.col(x).alias(y) for x, y in zip(("sa", "sb", "doc", "tk", "low"), places.columns, strict=True))).unionByName(own)
    run, schema = _search(window)
    answers = leaves.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInPandas(run, schema)
    hits = places.join(answers, ["ca", "cb"])
    starts = hits.select("doc", "tk", F.expr("filter(transform(docs, (x, i) -> if(x < doc, low + i, -1)), x -> x >= 0)").alias("starts")).filter("size(starts) > 0")
    starts = starts.groupBy("doc", "tk").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    run, schema = _cut(window)
    cut = texts.select("doc", "tk", "text").join(starts, ["doc", "tk"]).mapInArrow(run, schema)
    cut = cut.withColumn("kept_sha", F.sha2("kept", 256))
    cut = (cut if with_text else cut.drop("kept")).dropDuplicates(["doc", "tk"])

    out = flags.join(cut, ["doc", "tk"], "left")
    whole_copy = F.col("copy") & (F.col("n_words") >= window)
    columns = [
        F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"),
        "n_words",
        F.when(whole_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole_copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(whole_copy, F.lit("")).otherwise(F.col("kept").cast("string")).alias("kept_text"))
    return out.select(*columns)
