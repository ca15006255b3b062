"""Periodic runs: stretches of words that repeat with a period, found with a suffix automaton.

A run is a stretch of consecutive words with smallest period q and a length of at least max(``least``, 2 q) that no
neighbouring word extends with period q.

The method, for one text: the automaton's states, from the longest to the shortest, take over the ordered end positions
of the states that link to them, the smaller set into the larger. Whenever a position gets a new neighbour at a distance
d not above the state's length, and the two come from different sets, the words up to the later of the two form a square with period d, the seed of a run:

* to the left the seed ends where the run does: the state where two positions meet for the first time has the length
  of their longest common suffix;
* to the right one comparison decides. If the next word goes on with period d, the run's last pair of positions is
  another pair, which seeds it; else the seed is the whole run.

Each run is found: let j be its last word and q its smallest period. The positions j - q and j meet in a state of length
(length of the run) - q >= q, and a third position between them would give the stretch a period that divides q.
A stretch that is seeded with several periods has the smallest of them, which divides the others.

What can't hold a run is left out before, without loss: all words of a run lie in repeated windows of least / 2 words of
their text (the run is at least that much longer than its period). Windows are compared by hash, where a clash only
makes the automaton larger. Of the states, only those of at least that length can seed a run.

Time is n log n for n words in repeated windows; a worker holds one slice of texts, or one text, and about 0.5 KB a word
of its longest repeating stretch.

Defined cases: null text has no words; a text without words has no runs and collapses to the empty text; rows with equal
ids or texts give one row each; a null id stays null; an empty table gives an empty table; other columns of the caller
aren't touched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, id_text, sliced, word_pieces

Run = tuple[int, int, int]
#: Odd 64-bit factors of the windows' hash (any odd number does).
_STEP, _ROW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state its length and its link, and the state of each prefix. State 0 is the empty word."""
    length, link, steps = [0], [-1], [{}]
    ends, last = [], 0
    for at, word in enumerate(words):
        new = len(length)
        length.append(at + 1)
        link.append(0)
        steps.append({})
        p = last
        while p >= 0 and word not in steps[p]:
            steps[p][word] = new
            p = link[p]
        if p >= 0:
            q = steps[p][word]
            if length[q] != length[p] + 1:  # q's shorter words get a state of their own
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                steps.append(steps[q].copy())
                link[q] = clone
                while p >= 0 and steps[p].get(word) == q:
                    steps[p][word] = clone
                    p = link[p]
                q = clone
            link[new] = q
        ends.append(new)
        last = new
    return length, link, ends


def runs_of(words: list[int], least: int = 12) -> list[Run]:
    """All runs (start, length, period) of a sequence, by start, then period."""
    n, half = len(words), max(1, (least + 1) // 2)
    if n < least:
        return []
    length, link, ends = suffix_automaton(words)
    # positions are kept negated, so that a smaller one, which comes later in repeating text, is appended
    held: dict[int, list[int]] = {s: [-at] for at, s in enumerate(ends) if length[s] >= half}
    found: dict[tuple[int, int], int] = {}

    def meet(later: int, distance: int, size: int) -> None:
        if distance <= size and (later + 1 == n or words[later + 1] != words[later + 1 - distance]):
            key = (later - size - distance + 1, size + distance)
            if key[1] >= least and found.get(key, n) > distance:
                found[key] = distance

    sizes = np.array(length)
    for s in np.argsort(-sizes, kind="stable")[: int((sizes >= half).sum())].tolist():
        up, own = link[s], held.pop(s)
        if (size := length[up]) < half:
            continue
        large, small = held.get(up), own
        if large is None:
            held[up] = own
            continue
        if len(large) < len(small):
            large, small = small, large
        before = 1  # positions are negated: none is 1
        for x in small:
            at = bisect_left(large, x)
            if at and large[at - 1] != before:  # two of one set have met in a longer state
                meet(-large[at - 1], x - large[at - 1], size)
            if at < len(large):
                meet(-x, large[at] - x, size)
            large.insert(at, x)
            before = x
        held[up] = large
    return sorted((start, size, period) for (start, size), period in found.items())


def repeated(ids: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Which words of several texts one after another (``bounds`` are their ends) lie in a window of ``width`` words that
    their text holds twice or more; by hash, so some others may be marked, too."""
    n, out = len(ids) - width + 1, np.zeros(len(ids), bool)
    if n < 2:
        return out
    row = np.searchsorted(bounds, np.arange(len(ids)), "right")
    h, wide = np.zeros(n, np.uint64), ids.astype(np.uint64)
    for k in range(width):
        h = (h + wide[k : k + n] + np.uint64(1)) * _STEP
        h ^= h >> np.uint64(29)
    h += row[:n].astype(np.uint64) * _ROW
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    _, which, count = np.unique(h[at], return_inverse=True, return_counts=True)
    at = at[count[which] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def text_runs(ids: np.ndarray, marked: np.ndarray, least: int) -> list[Run]:
    """The runs of one text, from those of its stretches of marked words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    return [(int(a) + s, n, q) for a, b in edges.reshape(-1, 2) if b - a >= least for s, n, q in runs_of(ids[a:b].tolist(), least)]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay when of each run only the first period does."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def find_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words of each row: doc_id, n_words, runs (array of start, length, period by start, then period) and
    collapsed (the words outside of all runs' later periods, joined by one space). One pass without a shuffle."""
    width = max(1, (least + 1) // 2)
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            parts, sizes = [np.zeros(0, np.int64)], []
            for text in batch.column(1):
                new = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in word_pieces(text.as_buffer().to_pybytes())]
                parts += new
                sizes.append(sum(map(len, new)))
            ids, bounds, words = np.concatenate(parts), np.cumsum(sizes), list(number)
            marked = repeated(ids, bounds, width)
            runs, texts = [], []
            for size, end in zip(sizes, bounds.tolist(), strict=True):
                own, mark = ids[end - size : end], marked[end - size : end]
                runs.append(found := text_runs(own, mark, least) if mark.any() else [])
                texts.append(b" ".join(map(words.__getitem__, (own[kept_words(size, found)] if found else own).tolist())))
            listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), listed, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def summary(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs``: n_runs; start, length, period and exponent_milli of its longest run (ties: the smallest
    start, then period); digests of all its runs and of the collapsed text."""
    r = F.col("runs")
    best = F.array_max(F.transform(r, lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.transform(r, lambda x: F.concat(F.concat_ws(",", *(x[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    length, period = best["length"], -best["period"]
    return found.select(
        "doc_id",
        F.size(r).cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.call_function("div", length * 1000, period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where a tenth of the texts, chosen by the checksum of their id, repeat a stretch from some word
    on to their end: word i >= a becomes word a + (i - a) % p. Rows without an id stay as they are."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    div = lambda a, b: F.call_function("div", a, b)

    def tail(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + div(n - a, 3 + g % 8)
        whole, rest = div(n - a, p), (n - a) % p
        cut = lambda start, size: F.slice(w, start.cast("int"), size.cast("int"))
        return F.array_join(F.concat(cut(F.lit(1), a), F.flatten(F.array_repeat(cut(a + 1, p), whole.cast("int"))), cut(a + 1, rest)), " ")

    words = F.array_remove(F.split("text", SPACE_CLASS), "")
    # the words stand in an array of their own, so that they are made once and only for the chosen texts
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise("")), 1)
    return d.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))
