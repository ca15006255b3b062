"""Lexical search, vector packing and periodic runs: parts and limits that the contracts' rows don't show."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import public_tokenizers as P
from lodestrata.llm import lexical_search, periodic_runs, queries, vector_packing
from test_contracts import ITEMS, rows, table

RANKED = ["item_id", "rank", "doc_id", "score"]
BYTES = "byte_bpe_50k.json"


# periodic runs


def words_of_kind(kind, rnd, n):
    """Words with many runs: few letters, Fibonacci and Thue-Morse words, repeated blocks with single changes."""
    if kind == "few":
        return [rnd.randrange(2) for _ in range(n)]
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == "morse":
        return [k.bit_count() % 2 for k in range(n)]
    block = [rnd.randrange(5) for _ in range(rnd.randint(1, 12))]
    out = (block * (n // len(block) + 1))[:n]
    for _ in range(rnd.randrange(4)):
        out[rnd.randrange(n)] = 9
    return out


@pytest.mark.parametrize("kind", ["few", "fibonacci", "morse", "blocks"])
@pytest.mark.parametrize("least", [1, 2, 5, 12])
def test_runs_equal_all_periods_in_turn(kind, least):
    rnd = random.Random(7)
    for _ in range(40):
        words = words_of_kind(kind, rnd, rnd.randint(1, 120))
        assert periodic_runs.runs_of(words, least) == brute.all_runs(words, least), words


def test_repeated_windows_hold_every_run():
    rnd = random.Random(8)
    texts = [words_of_kind("blocks", rnd, rnd.randint(1, 80)) + [100 + k for k in range(rnd.randrange(30))] for _ in range(60)]
    ids, bounds = np.array([w for t in texts for w in t]), np.cumsum([len(t) for t in texts])
    marked = periodic_runs.repeated(ids, bounds, 6)
    for text, end in zip(texts, bounds.tolist(), strict=True):
        own = slice(end - len(text), end)
        assert periodic_runs.text_runs(ids[own], marked[own], 12) == brute.all_runs(text)
        assert all(marked[own][a : a + n].all() for a, n, _ in brute.all_runs(text))


def test_automaton_has_a_state_for_each_substring():
    words = [0, 1, 1, 0, 1, 1, 1, 0, 0, 1]
    length, link, ends = periodic_runs.suffix_automaton(words)
    distinct = {tuple(words[a:b]) for a in range(10) for b in range(a + 1, 11)}
    assert sum(length[s] - length[link[s]] for s in range(1, len(length))) == len(distinct)
    assert [length[s] for s in ends] == list(range(1, 11))


def test_one_long_run_takes_linear_time(spark):
    found = periodic_runs.find_runs(spark.createDataFrame([(1, "a b c " * 100_000)], "doc_id long, text string")).first()
    assert [tuple(r) for r in found["runs"]] == [(0, 300_000, 3)] and found["collapsed"] == "a b c"


def test_tails_repeat_as_stated(edges, edge_rows):
    found = {r["doc_id"]: r["text"] for r in periodic_runs.with_repeated_tails(edges).collect()}
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in edge_rows)
    for i, text in edge_rows:
        words = brute.WORD.findall(text or "")
        assert brute.WORD.findall(found[i] or "") == brute.tail_repeated(i, words) and (found[i] is None) == (text is None)


# vector packing


def check_packing(found, sizes, tokens, segments, loss):
    """Pieces cover every id once, sequences have no gaps and keep all limits; returns sequences' lengths."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        docs[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["loss"] if "loss" in r else 0))
    for i, pieces in docs.items():
        at = 0
        for start, n, total in sorted(pieces):
            assert start == at and n > 0 and total == sizes[i]
            at += n
        assert at == sizes[i]
    assert set(docs) == set(sizes)
    for pieces in sequences.values():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at <= tokens and len(pieces) <= segments and sum(p[2] for p in pieces) <= loss
    return [sum(p[1] for p in pieces) for pieces in sequences.values()]


def test_packing_query_holds_every_id_once(spark, sf_dir):
    docs = dict(table(spark, sf_dir, "documents"))
    ids = {i: [*brute.byte_level().encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs.items()}
    found = [r.asDict() for r in queries.op12_vector_packing(spark, sf_dir).collect()]
    lengths = check_packing(found, {i: len(x) for i, x in ids.items()}, 1024, 64, 1024)
    for r in found:
        raw = b"".join(x.to_bytes(4, "little") for x in ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        assert zlib.crc32(raw) == r["ids_crc32"]
    assert all(n.bit_count() == 1 for n in lengths)  # nothing is padded
    assert sum(n == 1024 for n in lengths) >= sum(lengths) // 1024 - 8


@pytest.mark.parametrize("ladder", [True, False])
def test_packing_of_odd_texts(edges, edge_rows, ladder):
    sizes = {i: len(brute.byte_level().encode(t or "", add_special_tokens=False).ids) + 1 for i, t in edge_rows}
    found = [r.asDict() for r in vector_packing.pack(edges, P.path(BYTES), 0, ladder=ladder, pool=4).collect()]
    lengths = check_packing(found, sizes, 1024, 64, 1024)
    assert not ladder or all(n.bit_count() == 1 for n in lengths)


def test_limits_hold_at_once(spark):
    """Instruction data: prompts bear no loss; segments, loss and tokens all bind, and the loss of each piece is right."""
    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choices(["yes", "no", "maybe", "often"], k=n))
    data = [(i, say(rnd.randrange(60)), say(rnd.choice([0, 3, 30, 400]))) for i in range(300)]
    count = lambda t: len(brute.byte_level().encode(t, add_special_tokens=False).ids)
    sizes, prompts = {i: count(p) + count(t) + 1 for i, p, t in data}, {i: count(p) for i, p, _ in data}
    docs = spark.createDataFrame(data, "doc_id long, prompt string, text string").repartition(3)
    for tokens, segments, loss in ((256, 5, 100), (256, 3, 256), (100, 50, 7), (1, 1, 1)):
        found = [r.asDict() for r in vector_packing.pack(docs, P.path(BYTES), 0, tokens, segments, loss, "prompt", pool=32, ladder=False).collect()]
        check_packing(found, sizes, tokens, segments, loss)
        for r in found:
            assert r["loss"] == max(0, r["start"] + r["length"] - max(r["start"], prompts[r["doc_id"]]))


def test_dot_product_prefers_what_matches_the_room():
    """With loss nearly used up, an example without loss goes in before an equal one with it."""
    packer = vector_packing.Packer(100, 10, 20, pool=8, ladder=False)
    e = lambda i, n, free: vector_packing.Example(i, n, 0, np.zeros(n, np.uint32), free)
    given = [s for x in (e(0, 18, 0), e(1, 30, 30), e(2, 10, 0), e(3, 52, 52)) for s in packer.add(x)]
    first, *others = [*given, *packer.rest()]
    assert {p.doc_id for p in first} == {0, 1, 3} and [[p.doc_id for p in s] for s in others] == [[2]]


def test_packing_of_nothing_and_of_nulls(none, nulls):
    assert vector_packing.pack(none, P.path(BYTES), 0).collect() == []
    found = vector_packing.pack(nulls, P.path(BYTES), 0).collect()
    assert Counter(r["doc_id"] for r in found if r["start"] == 0) == {None: 2, 7: 3, 8: 1}
    with pytest.raises(ValueError):
        vector_packing.pack(nulls, P.path(BYTES), 0, segments=0)


def test_packing_is_the_same_when_a_task_runs_again(edges):
    frame = vector_packing.pack(edges.coalesce(2), P.path(BYTES), 0)
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(map(tuple, frame.collect()), key=str)


# lexical search


def test_numbers_in_seven_bit_groups():
    values = np.array([0, 1, 127, 128, 300, 1 << 40, (1 << 62) + 5])
    raw, size = lexical_search.to_bytes(values)
    assert lexical_search.from_bytes(raw.tobytes()).tolist() == values.tolist() and size.tolist() == [1, 1, 1, 2, 2, 6, 9]
    assert not len(lexical_search.from_bytes(b""))


def test_pieces_have_the_terms_of_the_whole(edge_rows):
    for _, text in edge_rows:
        raw = (text or "").encode()
        assert [t for p in lexical_search.term_pieces(raw, 7) for t in p] == lexical_search.terms(raw) == [t.encode() for t in brute.TERM.findall(brute.lower(text))]


def test_search_query_equals_brute_force(spark, sf_dir):
    want = brute.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    assert rows(queries.op11_lexical_search(spark, sf_dir), RANKED) == sorted(want, key=str)


@pytest.mark.parametrize("shard, block", [(1 << 25, 100_000), (1, 100_000), (3_000, 1)])
def test_search_of_odd_texts(spark, edges, edge_rows, shard, block):
    """Ties, null ids of items, shards of single documents and blocks of single items."""
    items = [*ITEMS, ("i6", edge_rows[6][1]), ("i7", "same same é ä"), ("i7", "unknownterm"), ("i8", "card mail x")]
    index = lexical_search.build_index(edges, shard_bytes=shard)
    for k in (1, 3, 20):
        found = lexical_search.search(index, spark.createDataFrame(items, "item_id string, text string"), k, block)
        assert rows(found, RANKED) == sorted(brute.ranked(edge_rows, items, k), key=str)


def test_windows_and_heaps_lose_nothing(spark):
    """Many documents with equal scores over many windows: the smallest ids stay."""
    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.choice([1, 2, 30])))) for i in range(3_000)]
    rnd.shuffle(docs)
    items = [(k, " ".join(rnd.choices("abcdefghz", k=n))) for k, n in enumerate((1, 2, 4, 9))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    found = lexical_search.search(lexical_search.build_index(frame), spark.createDataFrame(items, "item_id long, text string"), 20)
    assert rows(found, RANKED) == sorted(brute.ranked(docs, items), key=str)
    for window in (1, 7, 64):
        shard = lexical_search.Shard()
        for i, t in docs:
            shard.add(i, t.encode())
        held, *index = [b.to_pydict() for b in shard.rows(0)]
        names, dfs = index[0]["term"], np.array(index[0]["df"])
        weights = np.arange(1, len(names) + 1) * 50
        cursors = lexical_search.Cursors(held["postings"][0], names, dfs, index[0]["postings"], weights, 3_000, held["occurrences"][0])
        assert cursors.best(Counter("abcc"), 20, window) == cursors.best(Counter("abcc"), 20)


def test_search_of_nothing_and_of_nulls(spark, none, nulls):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert lexical_search.search(lexical_search.build_index(none), items).collect() == []
    index = lexical_search.build_index(nulls)
    assert lexical_search.search(index, items.limit(0)).collect() == []
    found = lexical_search.search(index, spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string"))
    docs = [(r["doc_id"], r["text"]) for r in nulls.collect()]
    assert rows(found, RANKED) == sorted(brute.ranked(docs, [(1, "a b"), (2, None)]), key=str)


def test_words_of_a_table_are_encoded_once_and_long_ones_are_not_kept():
    """The memo made a Python object of each known word of every batch: 437 and 430 CPU seconds a GB of 400 (op9, op12)."""
    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from lodestrata.llm.encoding import TokenizersEncoder, WordTable

    encoder = TokenizersEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked = []
    encoder.table = WordTable(lambda words: asked.extend(words) or encoder.words(words), most=8)
    texts = ["one two  three", "", "x " + "Größe" * 50 + " two!", " a b c d e f g h i j k", "é a\tb <|endoftext|> c ", "one two two"]
    for part in (texts, texts[::-1], texts[3:]):
        flat, sizes = encoder.encode(pa.array(part, pa.string()))
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]
        assert len(encoder.table.words) <= 8 and all(len(w) < 100 for w in encoder.table.words.to_pylist())
    encoder.table = WordTable(lambda words: asked.extend(words) or encoder.words(words))
    asked.clear()
    for _ in range(2):
        encoder.encode(pa.array(["x one two", "y two"]))
    assert sorted(asked) == ["one", "two"] and encoder.table.flat.dtype == np.uint32
