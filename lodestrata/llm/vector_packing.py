"""Vector bin packing: examples placed into sequences under several limits at once.

Every example is a vector of tokens, segments (one each) and loss-bearing tokens; a sequence has a limit for each of the
three. The dot-product heuristic fills one sequence after another: of the examples that fit in whole, it takes the one
whose vector has the largest dot product with what the sequence has left, both as shares of the limits, so that an
example goes where its own demand meets the room that is there. When none fits, the example of which most fits is cut and
its rest goes back to the pool; a cut costs no padding.

A task packs what it reads, without a shuffle, from a pool of a few hundred examples; an example beyond a limit is cut into
full sequences as it comes in. What a sequence lacks in the end (the last of a task, or one whose segments or loss are used
up) is either padded or, with ``ladder``, the sequence is cut into ones whose lengths are powers of two, which batches of
equal length hold without padding.

Sequence ids are unique, not dense: the number of the task, then of its sequence. A task that is run again reads the same
rows in the same order and so makes the same sequences.

Defined cases: null text is empty, null prompt too, and both together give the end id alone; rows with equal ids are
examples of their own; a null id stays null; an empty table gives no pieces; other columns of the caller aren't touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, sliced
from .encoding import tokenizer_of

#: Bits of a sequence id that count a task's sequences.
TASK_BITS = 33


@dataclass(slots=True)
class Example:
    """A piece of a document: its ids from ``start`` on, the first ``free`` of which bear no loss."""

    doc_id: int | None
    total: int
    start: int
    ids: np.ndarray
    free: int

    def cut(self, n: int) -> tuple["Example", "Example"]:
        head = Example(self.doc_id, self.total, self.start, self.ids[:n], min(self.free, n))
        return head, Example(self.doc_id, self.total, self.start + n, self.ids[n:], max(0, self.free - n))

    @property
    def loss(self) -> int:
        return len(self.ids) - self.free


def powers(n: int) -> list[int]:
    """Powers of two that add up to ``n``, the largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Takes examples and gives sequences, each a list of examples; holds ``pool`` examples at most between two calls."""

    def __init__(self, tokens: int, segments: int, loss: int, pool: int = 512, ladder: bool = True):
        if min(tokens, segments, loss, pool) < 1:
            raise ValueError("limits are at least 1")
        self.limits, self.pool, self.ladder = (tokens, segments, loss), pool, ladder
        self.examples: list[Example] = []
        self.n, self.free = np.zeros(pool, np.int64), np.zeros(pool, np.int64)

    def add(self, example: Example) -> Iterator[list[Example]]:
        """What an example completes: sequences that it fills alone, then those that a full pool gives."""
        tokens, _, loss = self.limits
        while (n := min(tokens, example.free + loss)) < len(example.ids) or n == len(example.ids) == tokens:
            head, example = example.cut(n)
            if n == tokens:
                yield [head]
            else:
                yield from self._hold(head)
        if len(example.ids):
            yield from self._hold(example)

    def _hold(self, example: Example) -> Iterator[list[Example]]:
        k = len(self.examples)
        self.examples.append(example)
        self.n[k], self.free[k] = len(example.ids), example.free
        while len(self.examples) == self.pool:
            yield from self._closed(self._fill())

    def rest(self) -> Iterator[list[Example]]:
        while self.examples:
            yield from self._closed(self._fill())

    def _take(self, k: int, n: int) -> Example:
        """The first ``n`` ids of an example; none of it, or the rest, stays in the pool."""
        example = self.examples[k]
        if n < len(example.ids):
            head, example = example.cut(n)
            self.examples[k], self.n[k], self.free[k] = example, len(example.ids), example.free
            return head
        last = len(self.examples) - 1
        self.examples[k], self.n[k], self.free[k] = self.examples[last], self.n[last], self.free[last]
        self.examples.pop()
        return example

    def _fill(self) -> list[Example]:
        tokens, segments, loss = self.limits
        room, parts, loss_room = tokens, [], loss
        while self.examples and room and len(parts) < segments:
            n, free = self.n[: len(self.examples)], self.free[: len(self.examples)]
            bearing = n - free
            # a segment counts alike in every example: its part of the product changes no order
            product = n * (room / tokens**2) + bearing * (loss_room / loss**2)
            product[(n > room) | (bearing > loss_room)] = -1
            k = int(product.argmax())
            size = int(n[k])
            if product[k] < 0:
                most = np.minimum(n, np.minimum(room, free + loss_room))
                k = int(most.argmax())
                if not (size := int(most[k])):
                    break
            parts.append(part := self._take(k, size))
            room -= size
            loss_room -= part.loss
        return parts

    def _closed(self, parts: list[Example]) -> Iterator[list[Example]]:
        total = sum(len(p.ids) for p in parts)
        if not self.ladder or total == self.limits[0]:
            yield parts
            return
        queue = parts[::-1]
        for size in powers(total):
            out = []
            while size:
                part = queue.pop()
                if len(part.ids) > size:
                    part, rest = part.cut(size)
                    queue.append(rest)
                out.append(part)
                size -= len(part.ids)
            yield out


def pack(
    docs: DataFrame, vocabulary: str, end_id: int | None, tokens: int = 1024, segments: int = 64, loss: int | None = None, prompt_col: str | None = None,
    pool: int = 512, ladder: bool = True, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 22,
) -> DataFrame:
    """Pieces of the rows' ids, placed into sequences of at most ``tokens`` ids, ``segments`` pieces and ``loss``
    loss-bearing ids (by default as many as ids).

    An example is the ids of its prompt, if there is a column for it, those of its text, and ``end_id``. The prompt's ids
    bear no loss. Columns: doc_id, start (ids of the example before the piece), length, ids (little-endian unsigned
    32-bit integers), loss, doc_tokens (ids of the example), sequence_id, offset (ids of the sequence before the piece).
    """
    schema = "doc_id long, start long, length long, ids binary, loss long, doc_tokens long, sequence_id long, offset long"
    limits = (tokens, segments, tokens if loss is None else loss)
    Packer(*limits, pool, ladder)  # a wrong limit is an error here, not in the tasks

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        encoder = tokenizer_of(vocabulary)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in sliced(batches, 1, batch_bytes):  # the encoder looks up each distinct word of a slice once
            own = [encoder.encode(batch.column(c)) for c in range(batch.num_columns - 1, 0, -1)]  # a prompt comes first
            at = [0] * len(own)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                cuts = []
                for k, (flat, sizes) in enumerate(own):
                    cuts.append(flat[at[k] : at[k] + int(sizes[i])])
                    at[k] += int(sizes[i])
                ids = np.concatenate([*cuts, end])
                if len(ids):
                    yield Example(doc_id, len(ids), 0, ids, len(cuts[0]) if prompt_col else 0)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Example]]:
        packer = Packer(*limits, pool, ladder)
        for example in examples(batches):
            yield from packer.add(example)
        yield from packer.rest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << TASK_BITS
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "start", "length", "ids", "loss", "doc_tokens", "sequence_id", "offset"])

        for number, parts in enumerate(sequences(batches)):
            offset = 0
            for p in parts:
                rows.append((p.doc_id, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.loss, p.total, first + number, offset))
                offset += len(p.ids)
            held += 4 * offset
            if held >= batch_bytes:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    d = id_text(docs, id_col, text_col)
    if prompt_col:
        prompt = F.coalesce(F.col(prompt_col).cast("string"), F.lit(""))
        d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), prompt.alias("prompt"))
    return d.mapInArrow(run, schema)
