"""Order-dependent folds and page parsing against restatements."""

import random
import time
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

from lodestrata import plans
from lodestrata.functions import html as H
from lodestrata.functions import text as T
from pyspark.sql import functions as F


def blurbs(text, least=40, most=3000):
    import re

    out, carry = [], ""
    for block in [b.strip() for b in re.split(r"\n\s*\n", text.strip()) if b.strip()]:
        block = f"{carry}\n{block}" if carry else block
        if len(block) < least:
            carry = block
            continue
        carry = ""
        out += sliding(block) if len(block) > most else [block]
    if carry:
        out = [*out[:-1], f"{out[-1]}\n{carry}"] if out else [carry]
    return out


def sliding(text, size=1800, overlap=250, least=100):
    found = []
    for start in range(0, len(text), size - overlap):
        end = min(start + size, len(text))
        if end < len(text):
            back = max(start + size - overlap, end - 300)
            window = text[back:end]
            for sep in ("\n\n", "\n", ". "):
                if (at := window.rfind(sep)) >= 0:
                    end = back + at + len(sep)
                    break
        found.append(text[start:end].strip())
    return [c for c in found if len(c) >= least]


def test_blurbs(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcde", k=rnd.randint(2, 8)))
    block = lambda n: "".join(word() + rnd.choice([" ", " ", ". ", "\n"]) for _ in range(n)).strip()
    texts = ["\n\n".join(block(rnd.choice([1, 3, 20, 700, 1200])) for _ in range(rnd.randint(0, 8))) for _ in range(30)] + ["", " \n\n ", "short"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for i, found in rows.select("i", T.blurbs(F.col("t"))).collect():
        assert found == blurbs(texts[i]), i


def test_links_are_resolved_as_a_browser_does(spark):
    bases = ["http://a.b/c/d.html?x=1#y", "https://a.b", "http://a.b/", "http://a.b/c/d/"]
    hrefs = ["e", "./e", "../e", "../../e/f", "/g?h", "//x.y/z", "?q=1", "#top", "http://o.p/q#r", "ftp://f.g", "e/../f", "e/.", "..", "mailto:a@b", " k "]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for base, href, got in rows.select("b", "h", H.resolved(F.col("b"), F.col("h"))).collect():
        want = urldefrag(urljoin(base, href.strip()))[0]
        assert got == (want if want.startswith("http") else None), (base, href, got, want)


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.off, self.images, self.heads = [], 0, 0, 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in H._DROP
        self.images += tag == "img" and bool((dict(attrs).get("alt") or "").strip())
        self.heads += tag in ("h1", "h2", "h3", "h4")

    def handle_endtag(self, tag):
        self.off -= tag in H._DROP and self.off > 0

    def handle_data(self, data):
        if not self.off and data.split():
            self.out.append(" ".join(data.split()))


def test_pages_as_text_and_signals(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    shapes = {r["page_id"]: r for r in plans.QUERIES["page_strategy"](spark, sf_dir).collect()}
    texts = {r["page_id"]: r["text"] for r in H.page_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    assert len(texts) == len(shapes) == len(pages)
    for k, source in pages.items():
        p = Plain()
        p.feed(source)
        p.close()
        assert texts[k].split("\n\nNames shown as images:")[0] == "\n".join(p.out)
        assert (shapes[k]["images"], shapes[k]["headings"]) == (p.images, p.heads)


def test_words_in_capitals_beyond_ascii(spark):
    """A capital umlaut is the letter of its pattern, as in the SQL."""
    import duckdb
    from lodestrata.plans.text import _RX

    texts = ["! ERLICH!! FÜR!! DIE!!", "für uns", "FÜRST", "Fur", "GEFÜR", "der", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.relevance(F.col("t"), {"geo": ["der", "für"]}, ["die"]).alias("r")).orderBy("i").collect()
    assert [r["r"]["score"] for r in got] == [1, 1, 0, 0, 0, 1, None] and not got[0]["r"]["foreign_only"]
    assert [duckdb.execute("SELECT regexp_matches(?, ?)", [t, _RX["geo"]]).fetchone()[0] for t in texts[:5]] == [True, True, False, False, False]


def test_page_texts_are_made_a_few_pages_at_a_time(spark, sf_dir):
    """However many pages a batch has, a task holds the texts of some; all come out, in order."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in H.page_texts(pages).collect()}
    table = pages.select("page_id", "html").toArrow().combine_chunks()

    class Held:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

        mapInPandas = mapInArrow  # noqa: N815

    import pyarrow as pa

    (batch,) = pa.concat_tables([table] * 12).combine_chunks().to_batches()
    parts = list(H.page_texts(Held())(iter([batch])))
    assert len(parts) > 1 and max(p.num_rows for p in parts) <= H.PAGES
    assert [found[i] for p in parts for i in p.column(0).to_pylist()] == [t for p in parts for t in p.column(1).to_pylist()]
    assert sum(p.num_rows for p in parts) == 12 * len(found)


def test_rows_of_shingles_are_those_of_the_column(spark):
    """Texts' shingles left out where they are read, not after each was a row (F16)."""
    texts = ["a b c d a b c", "A-B c\nİK one", "x y", "", None, "İstanbul K 3 4 Straße 5"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = sorted(tuple(r) for r in df.select("id", T.shingles(F.col("text")).alias("x")).select("id", F.size("x").alias("n"), F.explode("x").alias("s")).collect())
    assert want and sorted(map(tuple, T.shingle_rows(df, "id", "n").collect())) == want
    assert sorted(map(tuple, T.shingle_rows(df, "id", "n", only={"b c d", "none such here"}).collect())) == [r for r in want if r[2] == "b c d"]


def test_a_chunk_is_computed_once(spark, sf_dir):
    """White space is taken from each text once and from each chunk once: no filter repeats what it looks at."""
    from lodestrata.plans.text import GROUPS
    from lodestrata.streaming import jobs

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = jobs.chunk_yield(docs, GROUPS, ["source"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(.*\\S)?") == 2 and plan.count("substring_index(") <= 6


def test_white_space_goes_from_the_ends_alone(spark):
    """As in the SQL; a long run inside is walked once, not from each of its characters."""
    import duckdb

    texts = ["  a b \n", "", " \t\n", "a \u2028", "a \x85", "\n a\n\nb\r\n", "𝐀 ", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.strip(F.col("t"))).collect()]
    assert got == [duckdb.execute(r"SELECT regexp_replace(?, '^\s+|\s+$', '', 'g')", [t]).fetchone()[0] for t in texts]
    long = "a" + " " * 400_000 + "b"
    start = time.perf_counter()
    assert spark.createDataFrame([(f" {long} ",)], "t string").select(F.md5(T.strip(F.col("t"))) == F.md5(F.lit(long))).first()[0]
    assert time.perf_counter() - start < 10


def test_plain_words_are_found_as_their_pattern_finds_them(spark):
    texts = ["The", "other", "bathe, the", "LICENSED", "licenſed", "lıcense", "lİcense.", "toKen", "to\u212aen", "a token_", "𝐀the", "the𝐀", "the\u2028", "FÜR", "für-", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for body in ("the|and", "token|licensed?", "für", "FÜR|the", "^the", "the$", r"t\w+", "(?:the)", "the|", "to ken", "a?"):
        by_pattern = F.col("t").rlike(T.word_regex(body))
        assert df.filter(~T.has_word(F.col("t"), body).eqNullSafe(by_pattern)).collect() == [], body


def test_at_least_so_many_words(spark):
    df = spark.createDataFrame([(t,) for t in ("", "  ", "a", " a\tb\n", "a b c", "a  b", None)], "t string")
    for n in (-1, 0, 1, 2, 3):
        assert df.filter(~T.has_words(F.col("t"), n).eqNullSafe(F.size(T.words(F.col("t"))) >= n)).collect() == [], n
    assert spark.createDataFrame([("w " * 50_000,)], "t string").select(T.has_words(F.col("t"), 50_000), T.has_words(F.col("t"), 50_001)).first() == (True, False)
