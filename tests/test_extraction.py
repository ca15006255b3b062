"""Records read answer by answer in Python against the plan over all documents, and what extractors do wrong."""

import json
import re
from collections import Counter

import pytest
from lodestrata import plans
from lodestrata import config as C
from lodestrata.operators import extraction as X
from lodestrata.plans.extraction import line_answers
from pyspark.sql import functions as F

CHUNKS = "id long, chunk string, answer string"
PLAIN = [f for f, k in X.FIELDS.items() if k == "text"]


def near_signal(text, year):
    for m in re.finditer(rf"(?<!\w){year}(?!\w)", text):
        low = text[max(0, m.start() - 60) : m.end() + 60].lower()
        if any(re.search(rf"(?<!\w){re.escape(s)}(?!\w)", low) if s.isalpha() else s in low for s in C.YEAR_SIGNALS):
            return True
    return False


def read(text, answer):
    said = (answer or "").strip()
    said = said.split("</think>", 1)[-1].strip()
    said = re.sub(r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", r"\1", said)
    try:
        found = json.loads(said).get("records", [])
    except ValueError:
        return [(None, "corrupt", None, None, None, None, None, [], [])]
    rows = []
    for pos, r in enumerate(found):
        name, people, year = r["name"] or None, r["founders"], r["founded_year"] or None
        tokens = set(re.split(r"\W+", (text or "").lower()))
        kept = [p for p in people if p.strip() and p.split()[-1].lower() in tokens]
        sure = year if year and near_signal(text, year) else None
        bad = name and (":" in name or "?" in name or name.count(",") > 1)
        state = "unnamed" if not name or not name.strip() else "implausible" if bad else "kept"
        rows.append((pos, state, name, r["website"] or None, sure, r["contact_info"] or None, kept, ["founded_year"] if year and not sure else [], [p for p in dict.fromkeys(people) if p.strip() and p not in kept]))
    return rows or [(None, "empty", None, None, None, None, None, [], [])]


def test_extracted_records_as_read_one_by_one(spark, sf_dir):
    want = {(r.doc_id, x[0]): x[1:] for r in line_answers(spark, sf_dir).collect() for x in read(r.text, r.answer)}
    rows = plans.QUERIES["extracted_records"](spark, sf_dir).collect()
    got = {(r.doc_id, r.pos): (r.state, r.name, r.website, r.founded_year, r.contact_info, r.founders, r.nulled, r.dropped) for r in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    for k, x in got.items():
        y = want[k]
        assert x[:5] == y[:5] and x[6:] == y[6:] and (y[5] is None or x[5] == y[5]), (k, x, y)
    states = Counter(x[0] for x in got.values())
    assert {"kept", "corrupt", "empty"} <= set(states)
    assert any(x[7] for x in got.values()) and any(x[5] for x in got.values())


def test_answers_of_all_kinds(spark):
    text = "Acme was founded in 2019 by Jane Doe with a Seed-Runde of 2 million; its team of 12 employees sits in Ulm."
    record = {"name": "Acme", "founded_year": 2019, "funding_stage": "Seed Runde", "funding_amount": "2 million", "employee_count": "12", "founders": ["Jane Doe", "John Roe"], "city": "", "tags": "ai"}
    rows = [
        (1, text, json.dumps({"records": [record]})),
        (2, "nothing of it", json.dumps({"records": [record]})),
        (3, text, json.dumps({"records": [{"name": "A: b"}, {"name": ""}, {}, "Acme", 7, {"name": "One, Two, Three"}]})),
        (4, text, '{"records": [{"name": "Ac'),
        (5, text, None), (6, None, json.dumps({"records": [record]})), (7, text, "[]"), (8, text, '{"records": "Acme"}'), (9, text, "{}"),
        (10, text, json.dumps({"records": [{"name": "Acme", "founded_year": "soon", "employee_count": 12, "founders": "Jane Doe"}]})),
        (11, text, json.dumps({"records": [{"name": "Acme", "founders": list("['Jane Doe']"), "founded_year": 0}]})),
    ]
    got = {}
    for r in X.records(spark.createDataFrame(rows, CHUNKS)).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r)
    r = got[1][0]
    assert (r.founded_year, r.funding_stage, r.funding_amount, r.employee_count, r.founders, r.city, r.tags) == (2019, "Seed Runde", "2 million", "12", ["Jane Doe"], None, ["ai"])
    assert (r.nulled, r.dropped, r.source_excerpt) == ([], ["John Roe"], text)
    for k in (2, 6):
        r = got[k][0]
        assert r.state == "kept" and r.founders == [] and r.dropped == ["Jane Doe", "John Roe"]
        assert r.nulled == ["founded_year", "funding_stage", "funding_amount", "employee_count"]
    assert [x.state for x in got[3]] == ["implausible", "unnamed", "unnamed", "not_a_record", "not_a_record", "implausible"]
    assert [[x.state for x in got[k]] for k in (4, 5, 7, 8, 9)] == [["corrupt"], ["corrupt"], ["corrupt"], ["corrupt"], ["empty"]]
    r = got[10][0]
    assert (r.state, r.founded_year, r.employee_count, r.founders) == ("kept", None, "12", ["Jane Doe"])
    assert got[11][0].founders == ["Jane Doe"] and got[11][0].nulled == []


def test_extractor_that_fails_is_asked_again_and_then_text_by_text(spark):
    def ask(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    rows = [(k, t) for k, t in enumerate(["a", None, "bad", "b"])]
    d = spark.createDataFrame(rows, "id long, chunk string").coalesce(1)
    got = [(r.id, r.answer, r.error) for r in X.asked(d, ask).orderBy("id").collect()]
    assert got == [(0, "A", None), (1, None, None), (2, None, "RuntimeError: no"), (3, "B", None)]
    short = X.asked(d.where("chunk <> 'bad'"), lambda texts: texts[:1] if len(texts) > 1 else texts).orderBy("id").collect()
    assert [r.answer for r in short] == ["a", "b"]
    assert X.asked(d.where("false"), ask).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_merge_keeps_the_first_that_is_not_empty(spark, parts):
    rows = [("s", 2, "Acme GmbH", None, "Ulm", ["b", "a"]), ("s", 1, "acme", "", "Bonn", ["c"]), ("s", 3, "ACME AG", "x.de", None, None), ("s", 4, " ", "y", "z", ["q"]), (None, 1, "Acme", "n", None, []), ("t", 1, "Beta", None, None, ["d"])]
    d = spark.createDataFrame(rows, "source string, at int, name string, website string, city string, tags array<string>").repartition(parts)
    got = {(r.source, r.name_key): (r.members, r.name, r.website, r.city, r.tags) for r in X.merge_by_name(d, ["source"], "name", ["at"], ["name", "website", "city"], ["tags"]).collect()}
    assert got == {("s", "acme"): (3, "acme", "x.de", "Bonn", ["a", "b", "c"]), (None, "acme"): (1, "Acme", "n", None, []), ("t", "beta"): (1, "Beta", None, None, ["d"])}


def test_articles_are_chunked_judged_read_and_merged(spark):
    line = "Acme GmbH builds token tools and the team of Ulm, write to info@acme.de, founded 2011 says the founder Doe"
    filler = " ".join(["and the token der von"] * 20)
    docs = spark.createDataFrame([(1, f"{line}\n{filler}\nAcme token the und weiter"), (2, "short"), (3, None), (4, "")], "doc_id long, text string").withColumn("day", F.lit("2024-05-01"))
    ask = lambda c: X.asked(c, lambda texts: [json.dumps({"records": [{"name": "Acme GmbH", "website": "acme.de", "founded_year": 2011, "tags": ["x"]}, {"name": "ACME", "city": "Ulm", "tags": ["w"]}]}) for _ in texts])
    got = X.article_records(docs, ask, {"a": ["token"], "b": ["the"]}, ["doc_id"], published="day").collect()
    assert [(r.doc_id, r.name_key, r.members, r.name, r.website, r.city, r.published_date, r.tags) for r in got] == [(1, "acme", 2, "Acme GmbH", "acme.de", "Ulm", "2024-05-01", ["w", "x"])]


def test_articles_are_asked_about_once_for_all_lists(spark):
    """Fields and lists were each merged from an extraction of their own (F11)."""
    docs = spark.createDataFrame([(1, "the token " * 40)], "doc_id long, text string")
    ask = lambda chunks: X.asked(chunks, lambda texts: ['{"records": [{"name": "Token", "tags": ["b", "a"], "founders": []}]}'] * len(texts))
    got = X.article_records(docs, ask, {"a": ["token"], "b": ["the"]}, ["doc_id"])
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["name"], r["tags"], r["members"]) for r in got.collect()] == [("Token", ["a", "b"], 1)]
