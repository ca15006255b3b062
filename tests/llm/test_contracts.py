"""Every query against brute force, over whole tables and over odd texts."""

import brute
import pytest
import public_tokenizers as P
from lodestrata.llm import decontaminate, encoding, exact_dedup, packing, periodic_runs, pii, queries, simhash, substring_dedup
from lodestrata.llm.common import scratch

ITEMS = [("i1", " ".join(f"w{k}" for k in range(20))), ("i2", "short item"), ("i3", None), ("i4", ""), (None, "two words"), ("i5", "card 4111 1111 1111 1111 and 4111-1111")]


def rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def table(spark, sf_dir, name):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*({"documents": ["doc_id", "text"], "benchmark": ["item_id", "text"]}[name])).collect()]


CONTRACTS = {
    "op1_token_counts": (brute.token_counts, ["doc_id", "n_bytes", "n_tokens", "over_limit"], lambda d: encoding.count_tokens(d, P.path("piece_bpe_32k.model"))),
    "op3_substring_dedup": (brute.substring, ["doc_id", "n_words", "n_removed", "kept_sha256"], substring_dedup.remove_repeats),
    "op4_exact_dedup": (brute.exact, ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], exact_dedup.find_copies),
    "op5_personal_data": (brute.personal, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"], pii.find_personal_data),
    "op6_simhash_near_dedup": (brute.near, ["doc_id", "fingerprint", "component_id"], simhash.near_components),
    "op8_byte_bpe": (brute.bpe, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], lambda d: encoding.encode_decode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)),
    "op9_packed_ids": (brute.packed, ["doc_id", "start", "n_tokens", "ids_crc32"], lambda d: packing.read_packed(packing.write_packed(d, scratch(d.sparkSession, "packed"), P.path("byte_bpe_50k.json"), 2))),
    "op13_periodic_runs": (
        brute.runs, ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
        lambda d: periodic_runs.summary(periodic_runs.find_runs(periodic_runs.with_repeated_tails(d))),
    ),
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_query_equals_brute_force(spark, sf_dir, name):
    want, columns, _ = CONTRACTS[name]
    assert rows(queries.queries()[name](spark, sf_dir), columns) == sorted(want(table(spark, sf_dir, "documents")), key=str)


@pytest.mark.parametrize("name", CONTRACTS)
def test_odd_texts_equal_brute_force(edges, edge_rows, name):
    want, columns, run = CONTRACTS[name]
    assert rows(run(edges), columns) == sorted(want(edge_rows), key=str)


@pytest.mark.parametrize("name", CONTRACTS)
def test_empty_table(none, name):
    assert CONTRACTS[name][2](none).collect() == []


@pytest.mark.parametrize("name", CONTRACTS)
def test_null_and_repeated_ids(nulls, name):
    """One row a row, whatever its id; the same rows get the same results but for a place in a file."""
    columns = [c for c in CONTRACTS[name][1] if c != "start"]
    found = rows(CONTRACTS[name][2](nulls), columns)
    assert len(found) == 6
    twice = [r for r in found if r[0] == 7]
    assert len(twice) == 3 and len(set(twice)) == 2


def test_decontamination_query(spark, sf_dir):
    want = brute.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = queries.op7_decontamination(spark, sf_dir)
    assert rows(found, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]) == sorted(want, key=str)


@pytest.mark.parametrize("chunk_words", [200_000, 7])
def test_decontamination_of_odd_texts(spark, edges, edge_rows, chunk_words):
    """A benchmark that takes many steps gives what one step gives."""
    items = [*ITEMS, ("i6", edge_rows[6][1])]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = edge_rows
    if chunk_words == 7:  # some forty steps: fewer documents
        edges, docs = edges.filter("doc_id < 160"), [r for r in edge_rows if r[0] < 160]
        benchmark, items = benchmark.filter("item_id <> 'i6'"), [x for x in ITEMS if x[0]]
    found = decontaminate.contamination(edges, benchmark, chunk_words=chunk_words)
    assert rows(found, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]) == sorted(brute.contaminated(docs, items), key=str)


def test_decontamination_without_items_or_documents(spark, edges, none):
    empty = spark.createDataFrame([], "item_id string, text string")
    assert {(r["n_hit"], r["contaminated"]) for r in decontaminate.contamination(edges, empty).collect()} == {(0, False)}
    assert decontaminate.contamination(none, spark.createDataFrame(ITEMS, "item_id string, text string")).collect() == []


def test_short_digests_are_verified_by_bytes(edges, edge_rows):
    """With one byte of digest texts clash; verification tells them apart."""
    columns = CONTRACTS["op4_exact_dedup"][1]
    assert rows(exact_dedup.find_copies(edges, digest_bytes=1, filter_bits=8), columns) == sorted(brute.exact(edge_rows), key=str)


def test_index_merges_and_looks_up_runs(edges, capsys):
    logged = exact_dedup.log(edges, memtables=3)
    runs = [exact_dedup.flush(logged.filter(f"memtable = {k}")) for k in range(3)]
    merged = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.compact(runs).collect()}
    assert merged == {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.flush(logged).collect()}
    one = next(iter(merged))
    assert [(r["keep_id"], r["group_size"]) for r in exact_dedup.lookup(exact_dedup.compact(runs), one).collect()] == [merged[one]]
    capsys.readouterr()
    runs[0].join(runs[1], "digest", "full").explain()  # buckets meet without a shuffle
    assert "Exchange" not in capsys.readouterr().out


def test_index_without_a_filter(edges, edge_rows):
    """Beyond the filter's bound the digests are joined."""
    columns = CONTRACTS["op4_exact_dedup"][1]
    assert rows(exact_dedup.find_copies(edges, filter_bits=3), columns) == sorted(brute.exact(edge_rows), key=str)


def test_hot_digests_stay_where_they_are(spark):
    rows_ = [(i, "same  text") for i in range(10_050)] + [(20_000 + i, f"text {i % 7}") for i in range(30)]
    found = exact_dedup.find_copies(spark.createDataFrame(rows_, "doc_id long, text string"))
    assert rows(found, CONTRACTS["op4_exact_dedup"][1]) == sorted(brute.exact(rows_), key=str)


def test_large_buckets_are_cut_into_blocks(spark):
    """Many fingerprints in few buckets, in blocks of eight, still link as all pairs do."""
    import random

    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(3)]
    prints = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 5))) % (1 << 64) for b in base for _ in range(40)})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 3, block=8).collect()
    own = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links}
    assert all((a ^ b).bit_count() <= 3 for a, b in own)

    def classes(pairs):
        up = {x: x for x in prints}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[root(a)] = root(b)
        groups = {}
        for x in prints:
            groups.setdefault(root(x), set()).add(x)
        return {frozenset(g) for g in groups.values()}

    assert classes(own) == classes([(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3])


def test_every_pair_within_the_radius_collides():
    from itertools import combinations

    masks = [m % (1 << 64) for m in simhash.covering_masks(3)]
    assert all(any(not m & (1 << a | 1 << b | 1 << c) for m in masks) for a, b, c in combinations(range(64), 3))


def test_split_keys_lose_nothing(edges, edge_rows):
    """Anchors of more segments than a key may have are split down to single windows, and then."""
    columns = CONTRACTS["op3_substring_dedup"][1]
    for most in (0, 1, 2):
        assert rows(substring_dedup.remove_repeats(edges, most=most, shard=2), columns) == sorted(brute.substring(edge_rows), key=str)


def test_split_keys_of_a_common_passage(spark):
    """A passage in many surroundings, some of which are shared by few."""
    import random

    rnd = random.Random(6)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(60))
    passage, near = [word() for _ in range(90)], [[word() for _ in range(40)] for _ in range(6)]
    docs = [(i, " ".join([*(rnd.choice(near) if i % 3 else [word() for _ in range(40)]), *passage, *(rnd.choice(near) if i % 2 else [word() for _ in range(40)])])) for i in range(60)]
    docs += [(100 + i, "na " * rnd.randrange(40, 300)) for i in range(10)]
    columns = CONTRACTS["op3_substring_dedup"][1]
    assert rows(substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), most=3), columns) == sorted(brute.substring(docs), key=str)


def test_first_below_and_ranks():
    import numpy as np

    rnd = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 8, 9, 64, 130):
        values, at, bound = rnd.integers(0, 6, n).astype(np.uint8), rnd.integers(0, n + 1, 50), rnd.integers(1, 6, 50)
        assert substring_dedup.Below(values).first(at, bound).tolist() == [next((j for j in range(a, n) if values[j] < x), n) for a, x in zip(at, bound, strict=True)]
        marks, at = rnd.random(n) < 0.4, rnd.integers(0, n, 50)
        assert substring_dedup.Marks(marks).rank(at).tolist() == (np.cumsum(marks) - 1)[at].tolist()


@pytest.mark.parametrize("piece", [20, 21, 64, 300])
def test_pieces_of_long_texts_have_the_hashes_of_the_whole(piece):
    words = [str(k * k % 997).encode() for k in range(1000)]
    whole = substring_dedup.Grams(20)(words)
    assert len(whole) == 981 and (substring_dedup.Grams(20, piece)(words) == whole).all()


def test_texts_beyond_a_piece():
    """More words than are hashed at once, at the size that queries use."""
    words = [b"%d" % (k * 7919 % 104729) for k in range(substring_dedup._PIECE + 100)]
    grams = substring_dedup.Grams(20)
    found = grams(words)
    assert len(found) == len(words) - 19 and (found[-200:] == grams(words[-219:])).all()


def test_pieces_lose_no_removals(edges, edge_rows):
    columns = CONTRACTS["op3_substring_dedup"][1]
    assert rows(substring_dedup.remove_repeats(edges, piece=64), columns) == sorted(brute.substring(edge_rows), key=str)


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17])
def test_packing_round_trip(bits):
    import io

    import numpy as np

    rnd = np.random.default_rng(1)
    sizes = np.array([0, 5, 1, 300, 0, 77])
    flat = rnd.integers(0, 1 << bits, sizes.sum()).astype(np.uint32)
    out = io.BytesIO()
    writer = packing.PackedWriter(out, bits, block=64)
    writer.add(np.arange(6), np.zeros(6, bool), flat, sizes)
    writer.close()
    reader = packing.PackedReader(out)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    assert all((reader.document(k) == flat[cuts[k] : cuts[k + 1]]).all() for k in range(6))
    assert (reader.range(60, 200) == flat[60:200]).all()


def test_contexts_discover_unseen_identifiers(spark):
    """Strings of a seed's shape that no base pattern takes are found where patterns of seeds introduce them."""
    seeds = [(i, f"login from host 10.0.0.{i} was seen") for i in range(40)]
    docs = spark.createDataFrame([*seeds, (100, "login from host 999.1.2.3 was seen"), (101, "see the section 999.4.5.6 of it")], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert found[0] == "ip:16:24" and found[100] == "ip:16:25" and found[101] == ""


LURES = [
    ("call office at", "+49 30 12345{:02d}0", "030 1234567", "phone"),
    ("call office at", "+49 30 12345{:02d}0", "(030) 765-4321", "phone"),
    ("call office at", "+49 30 12345{:02d}0", "0301234567", "phone"),
    ("charged to card", None, "4111 1111 1111 1112", "card"),
    ("please write to", "user{}@example.org", "anna at example dot org", "email"),
    ("please write to", "user{}@example.org", "anna(at)example.org", "email"),
    ("please write to", "user{}@example.org", "anna7@localhost", "email"),
]


def _valid_card(i):
    head = f"41111111111{i:04d}"
    return next(head + str(d) for d in range(10) if sum(int(c) if (15 - k) % 2 == 0 else (2 * int(c) - 9 * (c > "4")) for k, c in enumerate(head + str(d))) % 10 == 0)


@pytest.mark.parametrize("words, seed, unseen, kind", LURES)
def test_discovery_adds_every_kind(spark, words, seed, unseen, kind):
    """Identifiers of other separators than the seeds', in one token or several."""
    seeds = [(i, f"{words} {seed.format(i) if seed else _valid_card(i)} today") for i in range(40)]
    docs = spark.createDataFrame([*seeds, (100, f"{words} {unseen}, today"), (101, f"nothing leads to {unseen[:5]} here")], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert found[0].startswith(kind) and found[100] == f"{kind}:{len(words) + 1}:{len(words) + 1 + len(unseen)}" and found[101] == ""


def test_discovery_goes_on_from_what_it_found(spark):
    """A chain of seven patterns: each shares instances only with the one before it, the first with the seeds."""
    texts = [f"address stepz 10.0.0.{i} end" for i in range(60)]
    for k in range(7):
        texts += [f"address step{'abcdefgh'[k]} 999.{k}.{k}.{i} end" for i in range(4)]
        before = "stepz" if k == 0 else f"step{'abcdefgh'[k - 1]}"
        texts += [f"address {before} 999.{k}.{k}.{i} end" for i in range(3)] if k == 0 else []
        texts += [f"address step{'abcdefgh'[k]} 999.{k + 1}.{k + 1}.{i} end" for i in range(3)] if k < 6 else []
        texts += [f"address step{'abcdefgh'[k]} 999.{k}.{k}.{i} end" for i in range(3) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = pii.find_personal_data(docs).collect()
    assert len(spans) == len(texts) and all(r["spans"].startswith("ip:") for r in spans), [r for r in spans if not r["spans"]][:3]


def test_patterns_are_the_two_whole_words_before_a_token(spark):
    """Other matches in between, matches within a token and long words don't change them."""
    long = "w" * 100
    texts = ["user 42 login 10.0.0.1", "user 43 login 999.1.2.3", "to a@x.de, b@y.de", "see now <a@b.c>", "or say tel:+49 30 1234567", f"by {long} 10.0.0.2", "one\n two\t10.0.0.3", "two 10.0.0.4"]
    want = [{"00 login"}, {"00 login"}, {"to a@x.de,", ""}, {"see now"}, {"or say"}, {f"by {long}"}, {"one two"}, {""}]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: {x["l"] for x in [*r["base"], *r["loose"]] if len(x["m"]) > 5 or "@" in x["m"]} for r in pii.base_spans(docs).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_numbers_in_a_context_hide_no_instance(spark):
    docs = spark.createDataFrame([*((i, f"user 4{i} login 10.0.0.{i} ok") for i in range(40)), (100, "user 42 login 999.1.2.3 ok")], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}[100] == "ip:14:23"


def test_long_texts_reach_no_library_in_one_call():
    """Double, leading and trailing blanks, text without blanks: parts of bounded length, results of the whole."""
    import random

    import pyarrow as pa

    rnd = random.Random(2)
    counter = encoding.SentencePieceCounter(P.path("piece_bpe_32k.model"))
    calls, whole = [], counter.whole

    def spy(texts):
        calls.extend(map(len, texts))
        return whole(texts)

    counter.whole = spy
    for text in ("word " * 60_000 + " x", " " + "word " * 60_000, "line of text\n" * 20_000, "".join(rnd.choices("中文字日本語国会的是", k=200_000))):
        calls.clear()
        assert counter.counts(pa.array([text])).tolist() == [len(counter.model.encode(text))]
        assert max(calls) <= encoding.LONG + 100
    assert max(map(len, encoding.long_parts("1234 5678\n" * 30_000, P.PATTERN))) <= encoding.LONG + 100


def test_parts_have_the_ids_of_the_whole():
    import random

    rnd = random.Random(3)
    some = ["a", "the", " ", "  ", "\n", "\t", "▁", "中", "文", "é", "🙂", ".", "23", "'s", "'", "\r\n"]
    enc, counter = encoding.encoding_of(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), encoding.SentencePieceCounter(P.path("piece_bpe_32k.model"))
    for _ in range(500):
        text = "".join(rnd.choices(some, k=rnd.randint(0, 60)))
        assert [i for p in encoding.long_parts(text, P.PATTERN, 5) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
        assert counter.long(text, 5) == len(counter.model.encode(text))


@pytest.mark.parametrize("piece", [1, 7, 40])
def test_pieces_have_the_fingerprint_of_the_whole(edge_rows, piece):
    for _, text in edge_rows:
        if text and len(text) < 5000:
            assert simhash.fingerprint(text, piece=piece) == simhash.fingerprint(text)


def test_no_run_stays_in_the_catalog(spark, edges):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.find_copies(edges, memtables=3).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_shared_counters_change_no_result(spark, edges, edge_rows, monkeypatch):
    """With eight counters for all shingles, and hashes made as words come, the prefixes are poor, the results the same."""
    monkeypatch.setattr(decontaminate, "MOST_TOKENS", 8)
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 4)
    docs = [r for r in edge_rows if r[0] < 160]
    items = [x for x in ITEMS if x[0]]
    found = decontaminate.contamination(edges.filter("doc_id < 160"), spark.createDataFrame(items, "item_id string, text string"), chunk_words=30)
    assert rows(found, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]) == sorted(brute.contaminated(docs, items), key=str)


def test_benchmark_of_many_chunks_is_counted_in_one_pass(spark, edges, monkeypatch):
    calls = []
    whole = decontaminate._count
    monkeypatch.setattr(decontaminate, "_count", lambda *a: calls.append(1) or whole(*a))
    decontaminate.contamination(edges.filter("doc_id < 60"), spark.createDataFrame([x for x in ITEMS if x[0]], "item_id string, text string"), chunk_words=7).collect()
    assert calls == [1]
