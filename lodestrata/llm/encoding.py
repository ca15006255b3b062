"""Token counts and byte-level BPE.

Libraries, not own encoders, give the ids. Around them stands one idea: a text is cut at places where the library's
result for the whole text is the concatenation of its results for the parts, so that

* a very long text is never one huge call, and
* parts that recur (words) are encoded once per worker while a bounded memo holds them.

Where the cut isn't provably safe for a text, the text goes to the library whole.

Defined cases: null text counts as empty (0 tokens, empty ids); rows with equal ids or texts give one row each; a null
id stays null; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from .common import byte_slices, id_text, sliced

#: Entries in each of the two generations of a worker's memo, so that memory stays bounded whatever the vocabulary.
MEMO = 250_000
#: Characters after which a long text is encoded in parts.
LONG = 1 << 15
#: The White_Space property, spelt out: Python's own isspace has four control characters more than the tokenizers' has.
_SPACES = ("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


def tiktoken_encoding(rank_file: str, pattern: str):
    """The tiktoken library's encoding for a local rank file, without special tokens."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoding_of(rank_file: str, pattern: str):
    """A worker's encoding, kept from task to task."""
    return tiktoken_encoding(rank_file, pattern)


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> "SentencePieceCounter | TokenizersEncoder":
    """A worker's encoder of a vocabulary file with its memo, kept from task to task."""
    return SentencePieceCounter(path) if path.endswith(".model") else TokenizersEncoder(path)


def long_parts(text: str, pattern: str, limit: int = LONG) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut between matches of ``pattern``.

    A cut comes after a match that ends with no white space. The pattern's only look-ahead may be one after white space,
    as in GPT-2's; then no match before such a place depends on what follows it, and the parts have the matches of the
    whole. One match is never cut, however long.
    """
    start = 0
    if len(text) > limit:
        for m in regex.finditer(pattern, text):
            if m.end() - start >= limit and not text[m.end() - 1].isspace():
                yield text[start : m.end()]
                start = m.end()
    if start < len(text) or not text:
        yield text[start:]


class Memo:
    """Results by key in two generations: what the younger lacks is taken over from the older or made anew."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def get(self, keys: list[str]) -> list:
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        lost = [k for k in keys if k not in young]
        if lost:
            young.update([(k, old[k]) for k in lost if k in old])
            new = list(dict.fromkeys([k for k in lost if k not in old]))
            for s in byte_slices([len(k) for k in new], 1 << 20):
                young.update(zip(new[s], self.make(new[s]), strict=True))
        out = list(map(young.__getitem__, keys))
        for k in lost:  # long keys would make it large
            if len(k) > 100:
                young.pop(k, None)
        return out


class WordTable:
    """Ids of words, found by Arrow without a Python object for each. Of more than ``most`` words those used last stay."""

    def __init__(self, make, most: int = 2 * MEMO):
        self.make, self.most, self.turn = make, most, 0
        self.words, self.flat = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def get(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each of the (distinct) words the place of its first and how many it has."""
        self.turn += 1
        at = pa.compute.index_in(words, value_set=self.words)
        lost = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if lost.any():
            new = words.filter(pa.array(lost))
            made = self.make(new.to_pylist())
            at[lost] = np.arange(len(new)) + len(self.words)
            self.words = pa.concat_arrays([self.words, new])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), np.uint32)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, made), np.int64, len(made)) // 4])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.used[at] = self.turn
        flat, starts, sizes = self.flat, (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]
        if len(self.words) > self.most:
            self.keep(np.argsort(self.used, kind="stable")[-(self.most // 2) :])
        elif lost.any() and pa.compute.max(pa.compute.binary_length(new)).as_py() > 100:
            self.keep(np.arange(len(self.words)))
        return flat, starts, sizes

    def keep(self, at: np.ndarray) -> None:
        at = at[pa.compute.binary_length(self.words).to_numpy()[at] <= 100]  # long words would make it large
        n, starts = self.sizes[at], (np.cumsum(self.sizes) - self.sizes)[at]
        self.flat = self.flat[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self.words, self.sizes, self.used = self.words.take(pa.array(at)), n, self.used[at]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut before every blank: distinct words; for each word which it is, its row, and if it is its text's first."""
    parts = pa.compute.split_pattern(texts, " ")
    rows = pa.compute.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    coded = parts.flatten().dictionary_encode()
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), rows, first


class SentencePieceCounter:
    """Lengths of sentencepiece encodings.

    The pieces of such a model never hold a blank after another character (checked at start), so no merge crosses the
    place before blanks, and what follows the first blank is encoded as at the start of a text, whose dummy blank takes
    that blank's place. Blanks at the end, and those next to the character that stands for a blank, aren't cut.

    A part without such a place that is still long is cut between two characters that no piece has next to one another;
    what follows is encoded behind a line feed, which is a piece of its own, so that no dummy blank touches it.
    """

    _CUT = re.compile("(?<=[^ \u2581]) (?= *[^ \u2581])")
    _ODD = "  |^ | $|\u2581"

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        probe = ["x  y", " x", "x ", "ａ①", "x\ty"]  # white space and characters are kept as they are
        self.safe = all(m.decode(m.encode(t)) == t for t in probe) and not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        bytes_too = sum(m.is_byte(i) for i in range(m.vocab_size())) == 256  # characters without a piece are bytes
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)} if bytes_too and not any("\n" in p for p in pieces) else None
        self.feed = len(m.encode("\n"))
        self.memo = Memo(self.sizes)

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def sizes(self, parts: list[str]) -> list[int]:
        found = iter(self.whole([p for p in parts if len(p) <= LONG]))
        return [next(found) if len(p) <= LONG else self.long(p) for p in parts]

    def long(self, text: str, limit: int = LONG) -> int:
        total = start = 0
        while start < len(text):
            end = min(len(text), start + limit)
            while end < len(text) and (self.pairs is None or not self.safe or text[end - 1 : end + 1] in self.pairs or not {" ", "\u2581"}.isdisjoint(text[end - 1 : end + 1])):
                end += 1
            total += self.whole(["\n" + text[start:end]])[0] - self.feed if start else self.whole([text[:end]])[0]
            start = end
        return total

    def counts(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        odd = pa.compute.match_substring_regex(texts, self._ODD).to_numpy(zero_copy_only=False)
        if not self.safe:
            return np.array(self.whole(texts.to_pylist()), np.int64)
        for i in np.flatnonzero(odd):
            out[i] = sum(self.memo.get(self._CUT.split(texts[int(i)].as_py())))
        if len(at := np.flatnonzero(~odd)):
            words, which, rows, _ = _words(texts.take(pa.array(at)))
            out[at] = np.bincount(rows, np.array(self.memo.get(words.to_pylist()), np.int64)[which], len(at))
        return out


#: A word of Latin letters, then ASCII punctuation: two matches of a byte-level pre-tokenizer.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies have for the bytes of UTF-8, by character up to U+00FF."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    letter = {b: chr(b if b in plain else next(rest)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class TokenizersEncoder:
    """Ids of a tokenizers file; special strings inside a text as by the library's default.

    With a byte-level pre-tokenizer a match ends before any blank, but for one in the midst of white space; texts that
    may have such a blank or an added token's string go to the library whole, as all do with another pre-tokenizer.
    Plain words go straight to the library's model, other words to its whole chain.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.safe = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", False)
        added = [x["content"] for x in spec.get("added_tokens") or []]
        # an added token may hold blanks: of such, any word of theirs counts
        self.odd = "|".join([" [" + "".join(_SPACES) + "]", " $", *(re.sub(r"([^\w ])", r"\\\1", w) for a in added for w in a.split(" ") if w)])
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        self.table, self.marks = WordTable(self.words), Memo(lambda xs: [self.plain(x) for x in xs])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, match: str) -> bytes:
        return array("I", [x.id for x in self.model.tokenize(match.translate(self.letters))]).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """Ids, 4 bytes each, of words as they stand after a blank."""
        tokenize, letter, out, others, marked = self.model.tokenize, self.letters[ord(" ")], [], [], []
        for i, w in enumerate(words):
            if w.isalpha() and w.isascii():  # most: nothing to translate but the blank
                out.append(array("I", [x.id for x in tokenize(letter + w)]).tobytes())
            elif m := _PLAIN.fullmatch(w):
                out.append(self.plain(" " + m[1]))
                if m[2]:
                    marked.append((i, m[2]))
            else:
                out.append(b"")
                others.append(i)
        for (i, _), ids in zip(marked, self.marks.get([x for _, x in marked]), strict=True):
            out[i] += ids
        for i, ids in zip(others, self.whole([" " + words[i] for i in others]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        words, which, rows, first = _words(texts)
        # a blank before white space or the end is no safe place to cut, and an added token may hold blanks: such texts
        # go whole
        whole = pa.compute.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) | (not self.safe)
        keep = ~whole[rows]
        which, rows, first = which[keep], rows[keep], first[keep]
        met = np.zeros(len(words), bool)
        met[which[~first]] = True
        used, place = np.flatnonzero(met), np.cumsum(met) - 1
        known, known_starts, known_sizes = self.table.get(words.take(pa.array(used)))
        own = np.flatnonzero(whole)
        pieces = self.whole(words.take(pa.array(which[first])).to_pylist() + texts.take(pa.array(own)).to_pylist())
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        starts = np.concatenate([known_starts, np.cumsum(sizes) - sizes + len(known)])
        sizes, at = np.concatenate([known_sizes, sizes]), len(used)
        # the pieces of the texts in order: a first word (or the whole text), then the other words
        row = np.concatenate([rows[first], rows[~first], own]).astype(np.int64)
        piece = np.concatenate([np.arange(first.sum()) + at, place[which[~first]], np.arange(len(own)) + at + first.sum()]).astype(np.int64)
        order = np.argsort(row, kind="stable")
        row, piece = row[order], piece[order]
        n = sizes[piece]
        take = np.repeat(starts[piece] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        flat = np.concatenate([known, np.frombuffer(b"".join(pieces), np.uint32)])[take]
        return flat, np.bincount(row, n, len(texts)).astype(np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        return self.encode(texts)[1]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 22) -> DataFrame:
    """Token counts per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``vocabulary`` is a ``.model`` file of sentencepiece or a ``.json`` file of tokenizers. One pass without a shuffle;
    only lengths leave the workers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokenizer_of(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            sizes = pa.compute.binary_length(texts).to_pylist()
            n = [0, *(x for s in byte_slices(sizes, batch_bytes) for x in counter.counts(texts[s]).tolist())][1:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """tiktoken ids of each row and the bytes they decode to, as digests; ``with_ids`` adds both themselves.

    Columns: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 and, if
    asked for, ids (array) and decoded (binary). Decoding joins raw bytes, so ids that split a character are no matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding_of(rank_file, pattern)
        for batch in sliced(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                ids = [i for part in long_parts(text, pattern) for i in enc.encode_ordinary(part)]
                raw = enc.decode_bytes(ids)
                packed = np.array(ids, "<u4")
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(packed.tobytes()).hexdigest())
                out[2].append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    out[3].append(packed)
                    out[4].append(raw)
            cols = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array([x.astype("i8") for x in out[3]], pa.list_(pa.int64())), pa.array(out[4], pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    more = ", ids array<long>, decoded binary" if with_ids else ""
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
