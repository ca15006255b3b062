"""What the contracts say, one document at a time in plain Python; slow, and for tests only."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import public_tokenizers
import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(raw):
    return hashlib.sha256(raw.encode("utf-8", "surrogatepass") if isinstance(raw, str) else raw).hexdigest()


@lru_cache
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@lru_cache
def ranks():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache
def byte_level():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_counts(docs):
    out = []
    for i, t in docs:
        n = len(pieces().encode(t or "", num_threads=1))
        out.append((i, len((t or "").encode()), n, n > 4096))
    return out


def substring(docs, window=50):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[SPACE.sub(" ", t or "")].append(i)
    return [(i, min(g), len(g), i == min(g), sha(t)) for t, g in groups.items() for i in g]


KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(BASE[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]
            if ok():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def personal(docs):
    out = []
    for i, t in docs:
        found = base_spans(t or "")
        listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
        out.append((i, *(sum(x[1] == k for x in found) for k in range(4)), sha(listed)))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text, width=3):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(docs, radius=3):
    prints = [(i, fingerprint(t)) for i, t in docs]
    distinct = sorted({f for _, f in prints})
    up = {f: f for f in distinct}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    low = {}
    for i, f in prints:
        low[root(f)] = min(low.get(root(f), i), i)
    return [(i, f"{f:016x}", low[root(f)]) for i, f in prints]


PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(docs, items, window=13):
    owners = defaultdict(set)
    for item, t in items:
        w = PLAIN.findall(lower(t))
        if w and item is not None:
            for k in range(max(1, len(w) - window + 1)):
                owners[tuple(w[k : k + window])].add(str(item))
    sizes = sorted({len(x) for x in owners})
    out = []
    for i, t in docs:
        w = PLAIN.findall(lower(t))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := owners.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [True] * n
                    found |= own
        h = sum(hit)
        out.append((i, len(w), h, len(found), sha(",".join(sorted(found))), h > 0 and 20 * h >= len(w)))
    return out


def bpe(docs):
    out = []
    for i, t in docs:
        ids = ranks().encode_ordinary(t or "")
        out.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(ranks().decode_bytes(ids))))
    return out


def packed(docs):
    out, start = [], 0
    for i, t in sorted(docs, key=lambda x: x[0]):
        ids = [*byte_level().encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def tail_repeated(i, words):
    """The words of a text after the contract's own repetition of tails."""
    h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def all_runs(words, least=12):
    """Every period in turn: stretches where words q apart are equal; the smallest period of a stretch is its own."""
    import numpy as np

    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    found = {}
    for q in range(1, len(ids) // 2 + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= max(q, least - q)].tolist():
            found.setdefault((a, b - a + q), q)
    return sorted((a, n, q) for (a, n), q in found.items())


def runs(docs):
    out = []
    for i, t in docs:
        words = tail_repeated(i, WORD.findall(t or ""))
        found = all_runs(words)
        gone = [False] * len(words)
        for a, n, q in found:
            gone[a + q : a + n] = [True] * (n - q)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((i, len(found), *shown, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(w for w, g in zip(words, gone, strict=True) if not g))))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=20):
    import math
    from collections import Counter

    own = [(i, Counter(w)) for i, t in docs if (w := TERM.findall(lower(t)))]
    sizes = [sum(c.values()) for _, c in own]
    n_docs, n_terms = len(own), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), n in zip(own, sizes, strict=True):
            m = 75 + 25 * n * n_docs // n_terms
            score = 0
            for t in TERM.findall(lower(text)):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out
