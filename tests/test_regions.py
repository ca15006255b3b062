"""Articles by a walk over the blocks of each page, as one would do it by hand, against windows and joins."""

import random

import pytest
from lodestrata.operators import dom, regions
from lodestrata.plans.pages import WATCHED
from lodestrata.session import table

BLOCKS = "page_id long, block int, x0 double, y0 double, x1 double, y1 double, text string"


def fits(upper, lower, gap=22, inside=2, share=0.3):
    narrow = min(upper[4] - upper[2], lower[4] - lower[2])
    wide = max(0.0, min(upper[4], lower[4]) - max(upper[2], lower[2]))
    return -inside <= lower[3] - upper[5] <= gap and narrow > 0 and wide / narrow >= share


def walk(blocks, x, y, reach=6, pad=12):
    """Region around a place: grow up, then down, block by block, until one doesn't fit."""
    rows = sorted(blocks, key=lambda b: (b[3], b[1]))
    page = [min(b[2] for b in rows), min(b[3] for b in rows), max(b[4] for b in rows), max(b[5] for b in rows)]
    at = next((i for i, b in enumerate(rows) if b[2] - 2 <= x <= b[4] + 2 and b[3] - 2 <= y <= b[5] + 2), None)
    if at is None:
        return 0, page
    taken, i = [at], at
    while i > 0 and at - i < reach and fits(rows[i - 1], rows[i]):
        i -= 1
        taken.append(i)
    i = at
    while i + 1 < len(rows) and i - at < reach and fits(rows[i], rows[i + 1]):
        i += 1
        taken.append(i)
    box = [min(rows[k][2] for k in taken) - pad, min(rows[k][3] for k in taken) - pad, max(rows[k][4] for k in taken) + pad, max(rows[k][5] for k in taken) + pad]
    return len(taken), [max(box[0], page[0]), max(box[1], page[1]), min(box[2], page[2]), min(box[3], page[3])]


def clusters(found):
    out = []
    for term, r in found:
        for c in out:
            if max(c[1][0], r[0]) < min(c[1][2], r[2]) and max(c[1][1], r[1]) < min(c[1][3], r[3]):
                c[0].append(term)
                c[1] = [min(c[1][0], r[0]), min(c[1][1], r[1]), max(c[1][2], r[2]), max(c[1][3], r[3])]
                break
        else:
            out.append([[term], r])
    return out


def by_page(rows):
    pages = {}
    for r in rows:
        if r[0] is not None:
            pages.setdefault(r[0], []).append(tuple(r))
    return pages


def places(blocks, terms):
    for k, t in enumerate(terms):
        for b in sorted(blocks, key=lambda b: b[1]):
            if b[6] and (at := b[6].lower().find(t.lower())) >= 0:
                yield k, t, (b[2] + b[4]) / 2, b[3] + (b[5] - b[3]) * (at + 0.5) / len(b[6])
                break


def expected(rows, terms):
    grown, merged = {}, {}
    for page, blocks in by_page(rows).items():
        hits = [(k, t, *walk(blocks, x, y)) for k, t, x, y in places(blocks, terms)]
        grown |= {(page, k): (t, n, box) for k, t, n, box in hits}
        for m, (names, box) in enumerate(clusters([(t, box) for _, t, _, box in hits]), 1):
            inside = [b for b in sorted(blocks, key=lambda b: (b[3], b[1])) if box[0] <= (b[2] + b[4]) / 2 <= box[2] and box[1] <= (b[3] + b[5]) / 2 <= box[3]]
            merged[page, m] = (names, box, "\n".join(b[6] for b in inside if b[6] is not None))
    return grown, merged


def check(spark, rows, terms):
    b = spark.createDataFrame(rows, BLOCKS).cache()
    r = regions.regions(b, regions.first_hits(b, terms))
    got = {(x.page_id, x.place): (x.term, x.blocks, pytest.approx([x.x0, x.y0, x.x1, x.y1])) for x in r.collect()}
    want, merged = expected(rows, terms)
    assert want == got
    found = {(x.page_id, x.match): (x.terms, pytest.approx([x.x0, x.y0, x.x1, x.y1]), x.excerpt) for x in regions.excerpts(regions.matches(r), b).collect()}
    assert merged == found
    return want, merged


def test_random_pages(spark):
    rng, rows, words = random.Random(7), [], ["avia", "Startup", "nord", "süd", "x"]
    for page in range(60):
        y = 0
        for k in range(rng.randint(1, 40)):
            x = rng.choice([0, 0, 0, 110, 220])
            high = rng.choice([0, 10, 10, 30, 90])
            y += rng.choice([0, 5, 5, 12, 22, 23, 40, -3])
            rows.append((page, k, float(x), float(y), float(x + rng.choice([100, 100, 60, 0])), float(y + high), rng.choice([None, "", " ".join(rng.choices(words, k=3))])))
            y += high * rng.choice([0, 1, 1, 1])
    rng.shuffle(rows)
    want, merged = check(spark, rows, words[:4])
    assert any(n > 3 for _, n, _ in want.values()) and any(len(t) > 1 for t, _, _ in merged.values())
    assert len({p for p, m in merged if m > 1}) > 5


def test_two_articles_on_one_page_stay_apart_and_two_terms_in_one_are_one_match(spark):
    column = lambda y, text: (0, len(text), 0.0, float(y), 100.0, float(y + 20), text)
    rows = [column(0, "Avia grows"), column(30, "and hires"), column(200, "A startup of the town, far below"), column(230, "with Avia's rival Reisacher beside")]
    _, merged = check(spark, rows, ["avia", "startup", "reisacher"])
    assert [t for t, *_ in merged.values()] == [["avia"], ["startup", "reisacher"]]


def test_growth_ends_at_six_blocks_a_gap_and_another_column(spark):
    rows = [(1, k, 0.0, 20.0 * k, 100.0, 20.0 * k + 10, "needle" if k == 10 else f"b{k}") for k in range(21)]
    rows += [(2, 0, 0.0, 0.0, 100.0, 10.0, "head"), (2, 1, 0.0, 33.0, 100.0, 43.0, "needle"), (2, 2, 200.0, 45.0, 300.0, 60.0, "other column")]
    want, merged = check(spark, rows, ["needle"])
    assert want[1, 0][1] == 13 and want[2, 0][1] == 1
    assert merged[2, 1][2] == "needle"


def test_place_outside_all_blocks_gives_the_whole_page(spark):
    b = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, "a"), (1, 1, 0.0, 500.0, 10.0, 510.0, "b")], BLOCKS)
    h = spark.createDataFrame([(1, "t", 0, 300.0, 300.0)], "page_id long, term string, place int, x double, y double")
    r = regions.regions(b, h).first()
    assert (r.blocks, r.x0, r.y0, r.x1, r.y1) == (0, 0.0, 0.0, 10.0, 510.0)


def test_empty_tables_and_null_pages(spark):
    none = spark.createDataFrame([], BLOCKS)
    assert regions.matches(regions.regions(none, regions.first_hits(none, ["a"]))).count() == 0
    check(spark, [(None, 0, 0.0, 0.0, 1.0, 1.0, "a"), (3, 0, 0.0, 0.0, 1.0, 1.0, None), (4, 0, 0.0, 0.0, 1.0, 1.0, "A")], ["a"])


def test_blocks_hold_all_text_of_pages(spark, sf_dir):
    e = dom.elements(table(spark, sf_dir, "pages"))
    rows = [tuple(r) for r in regions.page_blocks(e).collect()]
    texts = {r.page_id: r.text for r in e.where("node = 0").select("page_id", "text").collect() if r.text}
    pages = by_page(rows)
    assert set(pages) == set(texts)
    for page, blocks in pages.items():
        assert " ".join(b[6] for b in sorted(blocks, key=lambda b: b[1])) == texts[page]
        for side in (0.0, 420.0):
            below = sorted((b for b in blocks if b[2] == side), key=lambda b: b[1])
            assert all(a[5] < b[3] for a, b in zip(below, below[1:], strict=False))
    want, merged = check(spark, rows, WATCHED)
    assert want and any(len(t) > 1 for t, *_ in merged.values())


def test_blocks_of_odd_pages(spark):
    html = "<body>loose<nav><ul><li>a<li>b</ul></nav><div>one <b>bold</b> two<p>three<br>four</div>tail"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p></p><div> </div>")], "page_id long, html string")
    rows = sorted(tuple(r) for r in regions.page_blocks(dom.elements(pages)).collect())
    assert [(r[0], r[6], r[2]) for r in rows] == [(1, t, 420.0 if t in "ab" else 0.0) for t in ("loose", "a", "b", "one bold two", "three", "four", "tail")]
