"""The table of intervals against a tree that is walked node by node."""

import re
from collections import Counter
from html.parser import HTMLParser
from statistics import mean, median, pstdev
from urllib.parse import urldefrag, urljoin, urlparse

import pytest
from lodestrata import config as C
from lodestrata import plans
from lodestrata.functions import html as H
from lodestrata.operators import dom
from pyspark.sql import functions as F

VOID = "area base br col embed hr img input link meta param source track wbr".split()


class Node:
    def __init__(self, tag, attrs, up):
        self.tag, self.up, self.kids, self.attrs = tag, up, [], {}
        for k, v in attrs:
            self.attrs.setdefault(k, v or "")
        self.classes = self.attrs.get("class", "").split()

    def elements(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.elements()

    def own(self):
        return [k for k in self.kids if isinstance(k, Node)]

    def strings(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.strings() if k.tag not in ("script", "style", "template") else ()
            elif k.strip():
                yield k.strip()

    def first(self, test):
        return next((k for k in self.elements() if test(k)), None)


class Builder(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = self.at = Node("#page", [], None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.up and node.tag != tag:
            node = node.up
        self.at = node.up or self.at

    def handle_data(self, data):
        self.at.kids.append(data)


def build(html):
    b = Builder()
    b.feed(html or "")
    b.close()
    return b.root


def junk(text):
    s = text.strip().lower()
    file = re.search(r"\.(?:png|jpe?g|gif|svg|webp)$|^(?:img|dsc|image|screenshot)[-_ ]?\d+", s)
    return len(s) < 2 or s in C.ALT_NOISE or bool(file) or bool(re.search(r"^\S+[-_]\S+[-_]\S+$", s))


def headline(name):
    return len(name) > 45 or len(name.split()) > 6 or bool(re.search(r"[?!:;–—]|\.\s", name)) or (" " in name and name.endswith("."))


def name_of(node):
    tight = lambda n: "".join(n.strings())
    tries = [n for k in range(1, 7) if (n := node.first(lambda x, k=k: x.tag == f"h{k}"))]
    tries += [n for n in node.elements() if re.search("(?i)title|name|heading|label|company", " ".join(n.classes))][:3]
    texts = [tight(n) for n in tries]
    for test, attr in ((lambda x: x.tag == "a" and "title" in x.attrs, "title"), (lambda x: x.tag == "img" and "alt" in x.attrs, "alt")):
        if n := node.first(test):
            texts.append(n.attrs[attr])
    if n := node.first(lambda x: x.tag == "a"):
        texts.append(tight(n))
    if len(whole := " ".join(node.strings())) <= 60:
        texts.append(whole)
    return next((t.strip() for t in texts if 2 <= len(t.strip()) <= 120 and not junk(t)), None)


def chrome(node):
    named = " ".join(filter(None, [" ".join(node.classes), node.attrs.get("id"), node.attrs.get("role")])) if node.up else ""
    return node.tag in C.CHROME_TAGS or bool(re.search(C.CHROME_HINTS, named))


def groups(root, least=4):
    out = []
    for at, parent in enumerate([root, *root.elements()]):
        kids = parent.own()
        if len(kids) < least:
            continue
        counts = Counter(c for k in kids for c in set(k.classes))
        by_class = lambda k: ".".join([k.tag, *sorted(c for c in set(k.classes) if counts[c] >= 2)])  # noqa: E731, B023
        by_kids = lambda k: ">".join([k.tag, *[x.tag for x in k.own()][:3]])
        for shape_of in (by_class, by_kids):
            made = [(s, [k for k in kids if shape_of(k) == s]) for s in dict.fromkeys(map(shape_of, kids))]
            made = [(s, m) for s, m in made if len(m) >= least]
            if made:
                break
        for shape, members in made:
            n = len(members)
            hrefs = [a.attrs["href"] for m in members if (a := m.first(lambda x: x.tag == "a" and "href" in x.attrs))]
            names = [x for m in members if (x := name_of(m))]
            texts, sizes = [len(" ".join(m.strings())) for m in members], [len(list(m.elements())) for m in members]
            heads = [any(re.fullmatch("h[1-6]", x.tag) for x in m.elements()) or name_of(m) is not None for m in members]
            identity = max(len(set(hrefs)) / n, len({x.lower() for x in names}) / n)
            cv = pstdev(sizes) / mean(sizes) if mean(sizes) else 0
            images = sum(m.first(lambda x: x.tag == "img") is not None for m in members)
            score = 0.3 * identity + 0.2 * len(hrefs) / n + 0.15 * sum(heads) / n + 0.15 * (1 - min(1, cv)) + 0.1 * min(1, n / least) + 0.1 * images / n
            up, framed = parent, False
            for _ in range(6):
                framed = framed or (up is not None and up.up is not None and chrome(up))
                up = up.up if up else None
            if framed:
                score = min(score, 0.15)
            if int(median(texts)) < 3 and identity < 0.5:
                score -= 0.3
            only = sum(t <= 24 for t in texts) / n >= 0.8
            headed = sum(map(headline, names)) / len(names) if names else 0
            out.append((at, shape, n, framed, only, round(headed, 6), int(median(texts)), round(max(0, score), 6)))
    return out


CARDS = "".join(f'<div class="card{" big" if k == 2 else ""}"><img src=x alt="logo"><h3>Firm {k}</h3><p>We make things of kind {k}.</p><a href="/firms/f-{k}">more</a></div>' for k in range(6))
DEEP = "".join("<div>" for _ in range(10)) + "".join(f'<span><b class="name">N{k} Co</b></span>' for k in range(5)) + "</div>" * 4 + "<p>after" * 3
ODD = [
    None, "", "plain text", f"<html><body><nav><ul>{'<li><a href=/x>x</a>' * 5}</ul></nav><main>{CARDS}</main><footer>Foot <a href='/y'>why</a></footer></body></html>",
    DEEP, f"<div class='partner-list'>{CARDS}</div><p>12 startups, founded", f"<section>{CARDS}</section><script>if (a<b) {{}}</script><template><p>no</p></template>",
    "<ul>" + "".join(f'<li><img alt="Firm number {k}"></li>' for k in range(7)) + "</ul><button>Show <i>more</i> firms</button>",
    "<table>" + "".join(f"<tr><td><a href='/news-items/{k}'>Title: what {k} did and why it did. All of it</a></td><td>{k}</td></tr>" for k in range(5)),
    "</p></div><p>a</b><br/>b</p>" + "<a href='?p=1'>1</a><a href='?p=2'>2</a><a rel='NEXT x' href=z>next</a>", "<div id=cookie-bar><div><div><div><div><div>" + "<i></i>" * 6,
    "<p title='x>y'>&lt;b&gt; &amp; <![CDATA[x]]><!-- <p>no --><unknown-tag a=1 a=2>z</unknown-tag>",
]


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    own = {r["page_id"]: (r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    own |= {1_000_000 + k: ("http://www.a.b/list/", h) for k, h in enumerate(ODD)}
    frame = spark.createDataFrame([(k, u, h) for k, (u, h) in own.items()], "page_id long, url string, html string").repartition(3)
    return own, frame, dom.elements(frame)


def test_intervals_texts_and_ancestors(pages):
    own, _, e = pages
    rows = {}
    for r in e.collect():
        rows.setdefault(r["page_id"], []).append(r)
    assert set(rows) == set(own)
    for k, (_, source) in own.items():
        found, root = sorted(rows[k], key=lambda r: r["node"]), build(source)
        tree = [root, *root.elements()]
        place = {id(n): i for i, n in enumerate(tree)}
        assert [(r["tag"], r["parent"], r["last"]) for r in found] == [(n.tag, place[id(n.up)] if n.up else None, i + len(list(n.elements()))) for i, n in enumerate(tree)]
        text = found[0]["text"]
        for r, n in zip(found, tree, strict=True):
            if not {"script", "style", "template"} & {n.tag, *(u.tag for u in iter_up(n))}:
                assert text[r["text_from"] : r["text_to"]] == " ".join(n.strings())


def test_groups_of_cards(pages):
    own, _, e = pages
    found = {}
    for r in dom.card_groups(e).collect():
        found.setdefault(r["page_id"], []).append((r["parent"], r["shape"], r["n"], r["in_chrome"], r["name_only"], round(r["headlines"], 6), r["median_text"], round(r["score"], 6)))
    for k, (_, source) in own.items():
        want = sorted(groups(build(source)))
        assert len(want) == len(found.get(k, []))
        for a, b in zip(sorted(found.get(k, [])), want, strict=True):
            assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], abs=2e-6), (k, a, b)


def test_primary_group_of_cards_and_what_it_names(pages):
    _, _, e = pages
    best = {r["page_id"] - 1_000_000: r for r in dom.primary_groups(dom.card_groups(e)).collect() if r["page_id"] >= 1_000_000}
    assert best[3]["shape"] == "div.card" and [m["name"] for m in best[3]["members"]] == [f"Firm {k}" for k in range(6)]
    assert [m["href"] for m in best[6]["members"]] == [f"/firms/f-{k}" for k in range(6)]
    assert 5 not in best  # partners' lists are chrome
    assert best[7]["name_only"] and best[4]["n"] == 5


def test_share_of_chrome(pages):
    own, _, e = pages
    found = {r["page_id"]: r for r in dom.chrome_share(e).collect()}
    for k, (_, source) in own.items():
        root = build(source)
        outer = [n for n in root.elements() if chrome(n) and not any(chrome(u) for u in iter_up(n))]
        assert found[k]["chrome_length"] == sum(len(" ".join(n.strings())) for n in outer if n.tag not in ("script", "style"))
        assert found[k]["chrome_elements"] == sum(1 + len(list(n.elements())) for n in outer) and found[k]["elements"] == len(list(root.elements()))


def iter_up(node):
    while (node := node.up) and node.up:
        yield node


def test_signals(pages):
    own, _, e = pages
    found = {r["page_id"]: r for r in dom.signals(e).collect()}
    for k, (_, source) in own.items():
        root = build(source)
        text, links = " ".join(root.strings()), [n for n in root.elements() if n.tag == "a"]
        alts = {a.lower(): a for n in root.elements() if n.tag == "img" and len(a := n.attrs.get("alt", "").strip()) >= 2}
        labels = [" ".join(n.strings()).lower() for n in root.elements() if n.tag in ("a", "button")]
        kind = "load_more" if any(p.lower() in x for p in C.LOAD_MORE for x in labels) else "rel_next" if any("next" in n.attrs.get("rel", "").lower().split() for n in links) else "numbered" if sum(bool(re.fullmatch("[0-9]{1,3}", "".join(n.strings()))) for n in links) >= 2 else None
        said = re.search(C.COUNT_TEXT, text)
        r = found[k]
        assert (r["text_length"], r["alts"], r["clean_alts"], r["pagination"], r["self_reported"]) == (len(text), len(alts), sum(not junk(a) for a in alts.values()), kind, int(said[1]) if said else 0), k
        assert r["link_density"] == pytest.approx(sum(len(" ".join(n.strings())) for n in links) / len(text) if text else 0)


def test_plans_follow_the_evidence(pages):
    _, frame, _ = pages
    lists = '<script type="application/ld+json">{"@type": "ItemList", "numberOfItems": 40}</script>'
    more = frame.sparkSession.createDataFrame([(2_000_000, "http://a.b/", lists + "<p>text"), (2_000_001, "http://a.b/x", "<a href=/y>only a link</a>")], frame.schema)
    found = {r["page_id"]: r for r in dom.page_plans(frame.where("page_id >= 1000000").unionByName(more)).collect()}
    plan = lambda k: (found[k]["shape"], found[k]["chunking"], found[k]["expected"])
    assert plan(1_000_003) == ("card_directory", "per_card", 6) and found[1_000_003]["pattern"] == "/firms/*" and found[1_000_003]["coverage"] == 1
    assert plan(1_000_007) == ("logo_grid", "name_batch", 7) and found[1_000_007]["pagination"] == "load_more"
    assert plan(1_000_008) == ("article_feed", "sliding_window", 0)
    assert plan(2_000_000) == ("card_directory", "per_card", 40) and plan(2_000_001) == ("unknown", "sliding_window", 0)
    assert plan(1_000_002) == ("prose_listing", "sliding_window", 0) and plan(1_000_000) == ("unknown", "sliding_window", 0)


def test_links_in_any_form(spark):
    html = "<a href='x'>1</a><A class=q HREF=\"y\">2</A><a\n href=z>3</a><a href=\"w?a=1&amp;b=2\">4</a><a data-href='no'>5</a><area href='no'><a href = 'v' >6</a>"
    frame = spark.createDataFrame([(1, "http://h.i/", html)], "page_id long, url string, html string")
    got = [r["link"] for r in H.links(frame).orderBy("position").collect()]
    assert got == [f"http://h.i/{x}" for x in ("x", "y", "z", "w?a=1&b=2", "v")]


def test_links_of_all_pages(spark, sf_dir, pages):
    own, frame, e = pages
    found = {}
    for r in H.links(frame).collect():
        found.setdefault(r["page_id"], set()).add(r["link"])
    for k, (url, source) in own.items():
        hrefs = [n.attrs["href"] for n in build(source).elements() if n.tag == "a" and "href" in n.attrs]
        want = {urldefrag(urljoin(url, h))[0] for h in hrefs if not re.match("#|mailto:|tel:|javascript:", h)}
        assert found.get(k, set()) == {u for u in want if urlparse(u).scheme in ("http", "https")}, k


def test_queries_cover_all_pages(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(plans.QUERIES[q](spark, sf_dir).count() == n for q in ("chrome_share", "page_signals", "page_plans"))
    assert plans.QUERIES["page_card_groups"](spark, sf_dir).where(F.col("score") > 0).count() > 0
