"""Text as columns: trimming, words, chunks, relevance, language, grounding. All built from Spark's own functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C

#: What isn't part of a word, for boundaries that hold beside letters of any alphabet.
_EDGE = r"[^\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` takes blanks only)."""
    # found from both ends, so that long runs of white space inside aren't tried from each of their characters
    return F.regexp_extract(c, r"(?s)^\s*+(.*\S)?", 1)


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def word_regex(body: str) -> str:
    """A Java regex for ``body`` as whole words in any case, of letters beyond ASCII too, as RE2 reads ``(?i)``."""
    return rf"(?iu)(^|{_EDGE})(?:{body})($|{_EDGE})"


def _literals(body: str) -> list[str]:
    """What a text must have one of to match alternatives that are plain words, their last letter optional or not; none if
    they are anything else."""
    letter = "[0-9A-Za-zÀ-ÖØ-Þà-öø-ÿ]"
    found = [re.fullmatch(rf"({letter}+?)(?:{letter}\?)?", term) for term in body.split("|")]
    return [m[1].lower() for m in found if m] if all(found) else []


def has_word(c: Column, body: str) -> Column:
    """Whether a text matches ``word_regex(body)``. Plain words are first looked for as bytes, which few texts pass for rare ones."""
    literals = _literals(body)
    if not literals:
        return c.rlike(word_regex(body))
    low = F.lower(c)
    for other, letter in (("ſ", "s"), ("ı", "i"), ("i\u0307", "i")):  # what lower case leaves of the letters in any case
        low = F.replace(low, F.lit(other), F.lit(letter))
    return reduce(or_, (low.contains(x) for x in literals)) & F.concat(F.lit(" "), c, F.lit(" ")).rlike(rf"(?iu){_EDGE}(?:{body}){_EDGE}")


def usable(patterns: Iterable[str]) -> str | None:
    """An alternation of the patterns, or None if there is none or it doesn't compile."""
    body = "|".join(str(p) for p in patterns)
    try:
        re.compile(body)
    except re.error:
        return None
    return body or None


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def has_words(c: Column, n: int) -> Column:
    """Whether a text has ``n`` words; it is read no further than that."""
    return c.rlike(rf"^\s*+(?:\S++\s++){{{n - 1}}}+\S") if n > 0 else F.length(c) >= 0


def _last(window: Column, sep: str) -> Column:
    """How many characters of ``window`` end with its last ``sep``; NULL if it has none."""
    return F.nullif(F.length(window) - F.length(F.substring_index(window, sep, -1)), F.lit(0))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _pieces(body: Column, step: int) -> Column:
    """A text walked once and cut every ``step`` characters; all else looks at a chunk's own characters."""
    return F.regexp_extract_all(body, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))


def _chunks(pieces: Column, full: Column, size: int, overlap: int) -> Column:
    """The chunk that begins with each piece of a text of ``full`` characters, short ones too."""
    step = max(1, size - overlap)
    more = range(1, -(-overlap // step) + 1)

    def chunk(p: Column, i: Column) -> Column:
        span = F.substring(F.concat(p, *[F.coalesce(F.get(pieces, i + k), F.lit("")) for k in more]), 1, size)
        return _named(span, lambda s: cut(s, i * step + F.length(s) < full))

    def cut(span: Column, goes_on: Column) -> Column:
        end = F.length(span)
        back = F.greatest(F.lit(step), end - 300)
        snapped = _named(F.substring(span, back + 1, end - back), lambda w: F.coalesce(*[_last(w, s) for s in ("\n\n", "\n", ". ")]))
        return strip(F.substring(span, F.lit(1), F.coalesce(F.when(goes_on, back + snapped), end)))

    return F.transform(pieces, chunk)


def sliding_chunks(df: DataFrame, text: str = "text", size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, least: int = C.CHUNK_MIN) -> DataFrame:
    """``df`` with a row per chunk: chunk_start and chunk.

    Chunks begin every ``size - overlap`` characters and end at the last paragraph, line or sentence end within the
    part that the next chunk repeats; chunks under ``least`` characters are left out. Starts don't depend on where
    chunks end, so chunks are exploded, not folded, and whole: a filter on a later column would compute it twice.
    """
    step = max(1, size - overlap)
    rows = df.withColumn("lode_body", strip(F.col(text)))
    rows = rows.select(*df.columns, F.length("lode_body").alias("lode_full"), _pieces(F.col("lode_body"), step).alias("lode_pieces"))
    rows = rows.select(*df.columns, F.posexplode(_chunks(F.col("lode_pieces"), F.col("lode_full"), size, overlap)).alias("lode_i", "chunk"))
    return rows.filter(F.length("chunk") >= least).select(*df.columns, (F.col("lode_i") * step).alias("chunk_start"), "chunk")


def sliding_parts(body: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, least: int = C.CHUNK_MIN) -> Column:
    """The chunks of ``sliding_chunks`` of one (stripped) text, as an array."""
    parts = _named(_pieces(body, max(1, size - overlap)), lambda p: _chunks(p, F.length(body), size, overlap))
    return F.filter(parts, lambda c: F.length(c) >= least)


def blurbs(text: Column, least: int = C.BLURB_MIN, most: int = C.BLURB_MAX) -> Column:
    """Blank-line blocks of a text; short ones go to the next block, a short last one to the block before. Blocks of more
    than ``most`` characters are cut as sliding chunks."""
    state = F.struct(F.lit("").alias("carry"), F.array().cast("array<string>").alias("out"))
    blocks = F.filter(F.transform(F.split(strip(text), r"\n\s*\n"), strip), lambda b: b != "")

    def add(s: Column, b: Column) -> Column:
        joined = F.when(s["carry"] != "", F.concat(s["carry"], F.lit("\n"), b)).otherwise(b)
        return F.transform(F.array(joined), lambda j: after(s, j))[0]

    def after(s: Column, joined: Column) -> Column:
        short = F.length(joined) < least
        new = F.when(short, F.array().cast("array<string>")).when(F.length(joined) > most, sliding_parts(joined)).otherwise(F.array(joined))
        return F.struct(F.when(short, joined).otherwise("").alias("carry"), F.concat(s["out"], new).alias("out"))

    def end(s: Column) -> Column:
        n = F.size(s["out"])
        last = F.concat(F.slice(s["out"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(s["out"], F.greatest(n, F.lit(1))), F.lit("\n"), s["carry"])))
        return F.when(s["carry"] == "", s["out"]).when(n == 0, F.array(s["carry"])).otherwise(last)

    return F.aggregate(blocks, state, add, end)


def name_batches(df: DataFrame, keys: list[str], position: str, name: str, n: int = C.NAMES_PER_CHUNK, header: str = "Names:") -> DataFrame:
    """Names of each key in batches of ``n`` lines in their order, under a header: keys, batch, chunk."""
    from pyspark.sql import Window

    kept = df.filter(strip(F.col(name)) != "")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(position)) - 1
    rows = kept.withColumn("batch", F.floor(rank / n)).groupBy(*keys, "batch")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, name))), lambda x: x[name]), "\n")
    return rows.agg(F.concat(F.lit(header + "\n"), lines).alias("chunk"))


def group_hits(c: Column, groups: Mapping[str, Iterable[str]]) -> dict[str, Column]:
    """For each group of patterns whether any occurs as a word; groups whose patterns don't compile are left out."""
    return {g: has_word(c, body) for g, terms in groups.items() if (body := usable(terms))}


def relevance(c: Column, groups: Mapping[str, Iterable[str]], foreign: Iterable[str] = (), geo_group: str = "geo", priority: Iterable[str] = (), boost: int = 1, min_words: int = C.RELEVANCE_MIN_WORDS, min_score: int = C.RELEVANCE_MIN_SCORE) -> Column:
    """struct(words, score, foreign_only, relevant): the number of groups hit, and the gate on it."""
    hits = group_hits(c, groups)
    score = sum((h.cast("int") for h in hits.values()), F.lit(0))
    if body := usable(re.escape(p) for p in priority):
        score = score + F.when(has_word(c, body), boost).otherwise(0)
    body = usable(foreign)
    outside = has_word(c, body) & ~hits.get(geo_group, F.lit(False)) if body else F.lit(False)
    return F.struct(F.size(words(c)).alias("words"), score.alias("score"), outside.alias("foreign_only"), (has_words(c, min_words) & ~outside & (score >= min_score)).alias("relevant"))


def language(c: Column, de: Iterable[str] = C.STOPWORDS_DE, en: Iterable[str] = C.STOPWORDS_EN) -> Column:
    """'de' or 'en' by which has more different stopwords in the text; NULL if neither."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-zà-ÿ]+"), F.lit(0)))
    d = F.size(F.array_intersect(found, F.array(*map(F.lit, de))))
    e = F.size(F.array_intersect(found, F.array(*map(F.lit, en))))
    return F.when(d > e, "de").when(e > d, "en")


def signal(low: Column, signals: Iterable[str]) -> Column:
    """Whether a signal occurs in a lower-case text: single words as words, others anywhere."""
    single = [re.escape(s) for s in signals if s.isalpha()]
    found = F.lit(False)
    if single:
        found = low.rlike(rf"(^|{_EDGE})(?:{'|'.join(single)})($|{_EDGE})")
    for s in signals:
        if not s.isalpha():
            found = found | low.contains(s)
    return found


def grounded_year(source: Column, year: Column, signals: Iterable[str] = C.YEAR_SIGNALS, context: int = C.YEAR_CONTEXT) -> Column:
    """``year`` if it stands in the text within ``context`` characters of a signal, else NULL."""
    digits = year.cast("string")
    parts = F.split(source, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), digits, F.lit(r"(?![\p{L}\p{N}_])")))
    near = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.right(F.element_at(parts, i), F.lit(context)), digits, F.left(F.try_element_at(parts, i + 1), F.lit(context))))
    return F.when((F.size(parts) > 1) & F.exists(near, lambda x: signal(F.lower(x), signals)), year)


def grounded_phrase(source: Column, value: Column) -> Column:
    """``value`` if the text has it with blanks, hyphens or neither between its words, else NULL."""
    v, low = F.lower(strip(value)), F.lower(source)
    forms = [v, F.replace(v, F.lit(" "), F.lit("-")), F.replace(v, F.lit("-"), F.lit(" ")), F.replace(v, F.lit(" "), F.lit(""))]
    found = F.lit(False)
    for f in forms:
        found = found | (F.length(f) > 0) & F.contains(low, f)
    return F.when(found, value)


def grounded_amount(source: Column, value: Column, signals: Iterable[str] = C.AMOUNT_SIGNALS) -> Column:
    return F.when(source.rlike("[0-9]") & signal(F.lower(source), signals), value)


def grounded_headcount(source: Column, value: Column, signals: Iterable[str] = C.EMPLOYEE_SIGNALS) -> Column:
    return F.when(signal(F.lower(source), signals), value)


def grounded_people(source: Column, names: Column) -> Column:
    """The names whose last word the text has as a word."""
    tokens = F.split(F.lower(source), rf"{_EDGE}+")
    return F.filter(names, lambda n: F.array_contains(tokens, F.lower(F.element_at(F.split(strip(n), r"\s+"), -1))))


def unsupported_numbers(text: Column, source: Column) -> Column:
    """Runs of digits in ``text`` that ``source`` doesn't have."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(numbers(text)), numbers(source)))


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` words of a-z and 0-9; NULL if the text has fewer words."""
    w = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    runs = w  # the words zipped with those after them, not sliced word by word: linear in the text
    for i in range(1, n):
        runs = F.zip_with(runs, F.slice(w, i + 1, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(w) >= n, F.array_distinct(F.filter(runs, lambda r: r.isNotNull())))


def shingle_rows(df: DataFrame, key: str, size: str, n: int = 3, only: set[str] | None = None, text: str = "text") -> DataFrame:
    """(key, ``size``, s): a row for each of ``shingles`` (or of those in ``only``) of a text, and how many it has in all."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    asked = None if only is None else df.sparkSession.sparkContext.broadcast(frozenset(only))
    word = re.compile("[a-z0-9]+")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, sizes, found = [], [], []
            for i, body in enumerate(batch.column(1)):
                w = word.findall((body.as_py() or "").lower())
                own = set(map(" ".join, zip(*(w[k:] for k in range(n)))))
                some = own if asked is None else own & asked.value
                rows += [i] * len(some)
                sizes += [len(own)] * len(some)
                found += some
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(found, pa.string())], names=[key, size, "s"])

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, StructType([df.schema[key], StructField(size, LongType()), StructField("s", StringType())]))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))).cast("double")


def text_overlap(a: Column, b: Column, n: int = 3) -> Column:
    """Share of shingles in common; NULL, not 0, if a side has none."""
    return jaccard(shingles(a, n), shingles(b, n))


def slug(c: Column) -> Column:
    """A file name: umlauts spelt out, other characters as one underscore."""
    s = F.lower(strip(c))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def header_key(c: Column) -> Column:
    """A column header as a key: umlauts without dots, letters only."""
    s = F.translate(F.lower(strip(c)), "äöü", "aou")
    return F.regexp_replace(F.replace(s, F.lit("ß"), F.lit("ss")), "[^a-z]", "")


def answer_part(c: Column, tag: str = "</think>") -> Column:
    """What follows the first closing tag, or all of it."""
    p = F.instr(c, tag)
    return strip(F.when(p > 0, F.substring(c, p + len(tag), F.length(c))).otherwise(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(squeeze(c), F.lit(""))


def labelled_lines(parts: Mapping[str, Column]) -> Column:
    """``label: value`` lines of the values that aren't empty."""
    lines = F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in parts.items()])
    return F.array_join(F.array_compact(lines), "\n")
