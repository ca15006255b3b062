"""Inbox, profiles and register: what tables of the test data don't hold."""

import glob

from lodestrata.functions import policy as P
from lodestrata.operators import browse as B
from lodestrata.operators import inbox as I
from lodestrata.operators import profiles as R
from lodestrata.sources import formats
from pyspark.sql import functions as F

REVIEWS = "review long, master string, created string, risk string"
CHANGES = "review long, field string, new string, source string"


def tables(spark):
    reviews = [(1, "m", "2026-01-01", "low"), (2, "m", "2026-01-03", "high"), (3, "m", "2026-01-02", "low"), (4, "gone", "2026-01-02", None), (5, "bare", None, "low"), (6, None, "2026-01-09", "low")]
    changes = [(1, "city", "Ulm", "a"), (1, "year", "2011", "a"), (2, "city", "Ulm", "b"), (3, "city", "Bonn", None), (4, "city", None, "c")]
    return spark.createDataFrame(reviews, REVIEWS), spark.createDataFrame(changes, CHANGES), spark.createDataFrame([("m", "Köln", None), ("bare", "Ulm", 3)], "master string, city string, size int")


def test_candidates_show_the_live_value_and_come_newest_first(spark):
    reviews, changes, live = tables(spark)
    rows = I.candidates(reviews, changes, "master", "review", "created", live, ["city", "size"]).collect()
    got = {(r.master, r.field, r.place): (r.value, r.votes, r.newest, r.sources, r.current) for r in rows}
    assert got == {
        ("m", "city", 1): ("Ulm", 2, 2, ["a", "b"], "Köln"), ("m", "city", 2): ("Bonn", 1, 3, [], "Köln"),
        ("m", "year", 1): ("2011", 1, 1, ["a"], None), ("gone", "city", 1): (None, 1, 4, ["c"], None),
    }


def test_entries_take_the_worst_risk_and_mark_records_that_are_gone(spark):
    reviews, changes, live = tables(spark)
    got = {r.master: tuple(r)[1:] for r in I.entries(reviews, changes, "master", "review", "created", "risk", live).collect()}
    assert got["m"] == (3, "high", "2026-01-01", "2026-01-03", 2, 4, 2, 3, False)
    assert got["gone"] == (1, None, "2026-01-02", "2026-01-02", 4, 1, 1, 1, True)
    assert got["bare"] == (1, "low", None, None, 5, 0, 0, 0, False)
    assert got[None][-1] is True and got[None][0] == 1


def test_picks_approve_only_reviews_that_agree_in_all_fields(spark):
    reviews, changes, _ = tables(spark)
    picks = spark.createDataFrame([("m", "city", "Ulm"), ("m", "year", None), ("bare", "city", "x")], "master string, field string, value string")
    statuses, applied, suppressed = I.settle(reviews, changes, picks, "master", "review")
    assert {r.review: r.status for r in statuses.collect()} == {1: "rejected", 2: "approved", 3: "rejected", 5: "rejected"}
    assert {tuple(r) for r in applied.collect()} == {("m", "city", "Ulm"), ("bare", "city", "x")}
    assert {tuple(r) for r in suppressed.collect()} == {("m", "city", "Ulm"), ("m", "year", "2011"), ("m", "city", "Bonn")}
    none = [x.limit(0) for x in (reviews, changes, picks)]
    assert [x.count() for x in I.settle(*none, "master", "review")] == [0, 0, 0]


def test_broken_evidence_has_no_level(spark):
    d = spark.createDataFrame([(1, '{"evidence_level": "strong"}', "Acme"), (2, "{broken", "acme"), (3, None, None), (4, '{"evidence_level": "strong"}', None)], "id int, evidence string, name string")
    ids = lambda **k: [r.id for r in d.where(I.review_filter(evidence=F.col("evidence"), names=[F.col("name"), F.lit(None).cast("string")], **k)).orderBy("id").collect()]
    assert ids(evidence_level="strong") == [1, 4] and ids(q="ACM") == [1, 2] and ids(evidence_level="strong", q="acm") == [1]
    assert ids() == [1, 2, 3, 4] and ids(equal={"id": None}) == [1, 2, 3, 4] and ids(equal={"id": 2}) == [2]


def test_histories_keep_the_keepers_entries_and_add_new_addresses(spark):
    e = "g string, id int, entries array<struct<url:string,day:int>>"
    rows = [("a", 1, [("u", 1), ("u", 2), (None, 3)]), ("a", 2, [("v", 4), ("u", 5), (None, 6)]), ("a", 3, [("v", 7), ("w", 8)]), ("b", 4, []), ("b", 5, None), ("c", 6, [("x", 1), ("x", 2)])]
    d = spark.createDataFrame(rows, e)
    got = {r.g: [tuple(x) for x in r.entries] for r in I.merged_histories(d, "g", F.col("id").isin(1, 4), ["id"], "entries").collect()}
    assert got == {"a": [("u", 1), ("u", 2), (None, 3), ("v", 4), ("w", 8)], "b": [], "c": [("x", 1)]}


def test_guesses_fill_gaps_and_never_replace(spark):
    s = "site string, pattern string, expected int, probed_at string, shape string"
    p = spark.createDataFrame([("a", None, 9, "day", "grid"), ("a", "/x", 3, None, None)], s)
    g = spark.createDataFrame([("a", None, 1, "x", "guess"), ("b", "/y", 2, "x", "one"), ("b", "/y", 2, "x", "two"), (None, None, 4, "x", "no")], s)
    got = {(r.site, r.pattern): (r.expected, r.probed_at, r["shape"]) for r in R.with_guesses(p, g, ["site", "pattern"]).collect()}
    assert got == {("a", None): (9, "day", "grid"), ("a", "/x"): (3, None, None), ("b", "/y"): (0, None, "one"), (None, None): (0, None, "no")}


def test_site_guards(spark):
    rows = ["https://www.acme.de/x", "https://de.linkedin.com/in/acme", "https://notlinkedin.com", "http://TechCrunch.com", "acme.de", "", None, "https://"]
    d = spark.createDataFrame([(u,) for u in rows], "u string")
    got = [tuple(r) for r in d.select(P.official_site(F.col("u")), P.unlisted_site(F.col("u"))).collect()]
    assert got == [(True, True), (False, False), (True, False), (False, True), (False, True), (False, False), (False, False), (False, True)]


def test_junk_needs_the_domain_and_no_evidence(spark):
    d = spark.createDataFrame([("http://Bad.example/1", None, ""), ("http://bad.example/2", "text", None), ("http://bad.example/3", "", "w"), (None, None, None), ("http://good", None, None)], "u string, d string, w string")
    assert [r[0] for r in d.select(R.domain_junk(F.col("u"), "bad.example", F.col("d"), F.col("w"))).collect()] == [True, False, False, False, False]


def test_sort_menu_clamps_and_puts_unknown_last(spark):
    d = spark.createDataFrame([(1, None, 5, 1, "b"), (2, 2.0, None, 2, "a"), (3, 1.0, 9, None, None), (4, 1.0, 9, 1, "c")], "id int, d double, e int, t int, n string")
    ids = lambda **k: [r.id for r in B.register_page(d, {"distance": "d", "employees": "e", "tier": "t", "name": "n"}, "id", **k).collect()]
    assert ids() == [3, 4, 2, 1] == ids(sort="no such") and ids(sort="employees", descending=True) == [3, 4, 1, 2]
    assert ids(sort="tier") == [4, 1, 2, 3] and ids(sort="name") == [2, 1, 4, 3] and ids(sort="name", descending=True) == [4, 1, 2, 3]
    assert ids(limit=0) == [3] and ids(limit=5000, offset=-3) == [3, 4, 2, 1] and ids(limit=2, offset=1) == [4, 2]


def test_export_is_marked_ordered_and_read_back(spark, tmp_path):
    d = spark.createDataFrame([(k, f"Fırma ö {k}" if k % 3 else None, float(100 - k)) for k in range(40)], "id int, name string, km double").repartition(5)
    path = f"file://{tmp_path}/out"
    formats.export_register(d, path, {"id": "Nr", "name": "Firma"}, [F.col("km").asc_nulls_last()], F.col("id") > 9)
    files = sorted(glob.glob(f"{tmp_path}/out/part-*.csv"))
    lines = []
    for f in files:
        raw = open(f, "rb").read()
        assert raw.startswith(b"\xef\xbb\xbfNr;Firma\n")
        lines += raw.decode("utf-8-sig").splitlines()[1:]
    assert lines == [f"{k};Fırma ö {k}" if k % 3 else f"{k};" for k in range(39, 9, -1)]
    back = formats.sheet(spark, path, "Nr;Firma\n1;a", required="nr")
    assert back.columns == ["nr", "firma"] and back.count() == 30


def test_groups_are_counted_without_repeating_rows(spark):
    """Distinct things a key, NULLs too, row by row; no row is copied for each count."""
    from lodestrata.operators import reviews

    rows = [(i % 3 or None, [1, 2, None, 2][i % 4], i % 7, ["low", "mid", "high"][i % (2 if i % 3 else 3)], ["a", "b", None][i % 3 - i % 2], ["x", "y", None][i % 5 % 3]) for i in range(60)]
    found = reviews.grouped(spark.createDataFrame(rows, "k int, review int, at int, risk string, field string, new string"), "k", "review", "at", "risk")
    got = {r["k"]: (r["reviews"], r["fields"], r["values"], r["first_seen"], r["last_seen"]) for r in found.collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        seen = [r[2] for r in own]
        want = (len({r[1] for r in own} - {None}), len({r[4] for r in own} - {None}), len({r[4:] for r in own if None not in r[4:]}), min(seen), max(seen))
        assert got[k] == want
    assert len(got) == 3 and "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
