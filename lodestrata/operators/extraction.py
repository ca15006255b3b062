"""Records out of text: asking whatever extracts them, reading its answers, and making one record of those that share a name.

An extractor answers with JSON, by intent; what it says is text, and nothing in it is believed. An answer is parsed as VARIANT, so a
field of another type is lost alone and not the record; a record's name must be plausible, and what is often made up (year,
stage, amount, headcount, founders) must stand in the text that was asked about. Every answer leaves a row: answers that
don't parse have the state ``corrupt``, those without records ``empty``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import config as C
from ..functions import text as T
from ..functions.identity import normalize_name
from ..functions.policy import implausible_name, string_list
from ..scratch import written

#: What a record has, and as what it is read.
FIELDS: dict[str, str] = {
    "name": "text", "one_liner": "text", "description": "text", "website": "text", "industry": "text", "country": "text", "city": "text",
    "founded_year": "year", "funding_stage": "text", "funding_amount": "text", "employee_count": "text", "contact_info": "text",
    "published_date": "text", "founders": "list", "tags": "list",
}
def supported_people(text: Column, words: Column, names: Column) -> Column:
    """The names whose last word the text has as a word."""
    return F.filter(names, lambda n: F.contains(words, F.concat(F.lit(" "), F.lower(F.element_at(F.split(T.strip(n), r"\s+"), -1)), F.lit(" "))))


#: Which fields must be supported by the text, and how: by a rule of the text, its words in lower case between blanks, and the value.
Rule = Callable[[Column, Column, Column], Column]
SUPPORTED: dict[str, Rule] = {
    "founded_year": lambda text, words, v: T.grounded_year(text, v), "funding_stage": lambda text, words, v: T.grounded_phrase(text, v),
    "funding_amount": lambda text, words, v: T.grounded_amount(text, v), "employee_count": lambda text, words, v: T.grounded_headcount(text, v),
    "founders": supported_people,
}


def asked(chunks: DataFrame, ask: Callable[[list[str]], list[str | None]], text: str = "chunk", retries: int = 1) -> DataFrame:
    """``chunks`` with answer and error: ``ask`` gets the texts of a batch and returns an answer for each.

    A batch that fails is tried again ``retries`` times, then its texts one by one; a text that fails alone has a NULL answer and
    the error's text. Null texts are not asked about. A task that is repeated asks again.
    """
    schema = StructType([*chunks.schema, StructField("answer", StringType()), StructField("error", StringType())])
    at = chunks.columns.index(text)

    def tried(texts: list[str]) -> list[tuple[str | None, str | None]]:
        said = ""
        for _ in range(retries + 1):
            try:
                found = ask(texts)
                if len(found) == len(texts):
                    return [(a, None) for a in found]
                said = f"{len(found)} answers to {len(texts)} texts"
            except Exception as e:  # whatever an extractor raises is an answer that failed
                said = f"{type(e).__name__}: {e}"
        return [(None, said)] if len(texts) == 1 else [x for t in texts for x in tried([t])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            given = iter(tried([t for t in texts if t is not None]) if any(t is not None for t in texts) else [])
            out = [(None, None) if t is None else next(given) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=[*batch.schema.names, "answer", "error"])

    return chunks.mapInArrow(run, schema)


def _read(item: Column, field: str, kind: str) -> Column:
    said = F.try_variant_get(item, f"$.{field}", "string")
    if kind == "list":
        return string_list(F.coalesce(F.try_variant_get(item, f"$.{field}", "array<string>"), F.when(said.isNotNull() & ~F.startswith(said, F.lit("[")), F.array(said)), F.array().cast("array<string>")))
    if kind == "year":
        return F.nullif(F.try_variant_get(item, f"$.{field}", "int"), F.lit(0))
    return F.nullif(said, F.lit(""))


def records(
    answers: DataFrame, text: str = "chunk", answer: str = "answer", root: str = "records", fields: Mapping[str, str] = FIELDS,
    supported: Mapping[str, Rule] = SUPPORTED, implausible: Callable[[Column], Column] = implausible_name, excerpt: int = 2000,
) -> DataFrame:
    """Answers as records: the columns of ``answers`` but text and answer, and pos, state, the fields, nulled, dropped, source_excerpt.

    state is kept, unnamed, implausible or not_a_record, or, for a whole answer, corrupt or empty (pos is NULL). ``nulled``
    names the fields that had a value without support, ``dropped`` lists the members of lists that had none.
    """
    said = F.regexp_replace(T.answer_part(F.col(answer)), r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", "$1")
    keys = [c for c in answers.columns if c not in (text, answer)]
    v = F.try_parse_json("lode_said")
    found = answers.withColumn("lode_said", said).withColumn("lode_v", v)
    listed = F.try_variant_get("lode_v", f"$.{root}", "array<variant>")
    absent = F.try_variant_get("lode_v", f"$.{root}", "string").isNull() & F.startswith(F.schema_of_variant("lode_v"), F.lit("OBJECT"))
    found = found.withColumn("lode_items", F.coalesce(listed, F.when(absent & F.col("lode_v").isNotNull(), F.array().cast("array<variant>"))))
    # a text's words are made once for all its records
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    found = found.withColumn("lode_words", spaced)
    rows = found.select(*keys, F.col(text).alias("lode_text"), "lode_words", F.col("lode_items").isNull().alias("lode_corrupt"), F.posexplode_outer("lode_items").alias("pos", "lode_item"))

    source = F.coalesce("lode_text", F.lit(""))
    rows = rows.withColumn("lode_object", F.startswith(F.schema_of_variant("lode_item"), F.lit("OBJECT")))
    item = F.when(F.col("lode_object"), F.col("lode_item"))
    rows = rows.select("*", *[_read(item, f, kind).alias(f"lode_{f}") for f, kind in fields.items()])
    state = (
        F.when(F.col("pos").isNull() & F.col("lode_corrupt"), "corrupt").when(F.col("pos").isNull(), "empty").when(~F.coalesce("lode_object", F.lit(False)), "not_a_record")
        .when(F.coalesce(T.strip(F.col("lode_name")), F.lit("")) == "", "unnamed").when(implausible(F.col("lode_name")), "implausible").otherwise("kept")
    )

    def checked(f: str, kind: str) -> Column:
        v = F.col(f"lode_{f}")
        if f not in supported:
            return v
        return F.when(F.size(v) > 0 if kind == "list" else v.isNotNull(), supported[f](source, F.col("lode_words"), v)).otherwise(v)

    rows = rows.select("*", state.alias("state"), *[checked(f, kind).alias(f) for f, kind in fields.items()])
    nulled = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.col(f"lode_{f}").isNotNull() & F.col(f).isNull(), F.lit(f)) for f in supported if fields.get(f) not in (None, "list")]))
    dropped = F.flatten(F.array(F.array().cast("array<string>"), *[F.array_except(f"lode_{f}", f) for f in supported if fields.get(f) == "list"]))
    return rows.select(*keys, "pos", "state", *fields, nulled.alias("nulled"), dropped.alias("dropped"), F.left(source, F.lit(excerpt)).alias("source_excerpt"))


def merge_by_name(found: DataFrame, by: Sequence[str], name: str, order: Sequence[str], fields: Sequence[str], lists: Sequence[str] = (), key: Callable[[Column], Column] = normalize_name) -> DataFrame:
    """One row for each name within ``by``: ``by``, name_key, members, the fields and the lists.

    Of each field the first value, by ``order``, that isn't empty stays; lists are united and sorted. Rows without a key fall
    out. All but the lists are aggregated before the shuffle; of a list only its distinct members travel.
    """
    rows = found.withColumn("name_key", key(F.col(name))).where(F.coalesce("name_key", F.lit("")) != "")
    at = F.struct(*order)
    full = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) != ""
    keys = [*by, "name_key"]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), *[F.min_by(f, F.when(full(f), at)).alias(f) for f in fields])
    for c in lists:
        # null keys are equal to one another in a grouping, so they must be in the join
        members = rows.select(*keys, F.explode(c).alias("m")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_set("m")).alias(f"lode_{c}"))
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        out = out.alias("a").join(members.alias("b"), same, "left").select("a.*", F.coalesce(f"lode_{c}", F.array().cast("array<string>")).alias(c))
    return out


def article_records(
    docs: DataFrame, ask: Callable[[DataFrame], DataFrame], groups: Mapping[str, Sequence[str]], by: Sequence[str], text: str = "text", published: str | None = None,
    foreign: Sequence[str] = (), min_words: int = C.RELEVANCE_MIN_WORDS, min_score: int = C.RELEVANCE_MIN_SCORE, **rules,
) -> DataFrame:
    """Articles to records: overlapping chunks, those that look relevant, what an extractor says of them, one record a name.

    ``by`` identifies an article; ``ask`` gets rows with ``chunk`` and returns them with ``answer`` (as ``asked`` does). A record
    without a date takes the article's.
    """
    kept = [*by, *([published] if published else [])]
    chunks = T.sliding_chunks(docs.select(*kept, text), text).where(T.relevance(F.col("chunk"), groups, foreign, min_words=min_words, min_score=min_score)["relevant"])
    found = records(ask(chunks.drop(text)).select(*kept, "chunk_start", "chunk", "answer"), **rules).where("state = 'kept'")
    if published:
        found = found.withColumn("published_date", F.coalesce("published_date", F.col(published).cast("string")))
    plain = [f for f, kind in FIELDS.items() if kind != "list"]
    # the merge reads them once for the fields and once for each list, so they are extracted before it
    found = written(found.select(*by, "chunk_start", "pos", *FIELDS), "records")
    return merge_by_name(found, by, "name", ["chunk_start", "pos"], plain, [f for f, kind in FIELDS.items() if kind == "list"])


def line_answers(text: Column, root: str = "records") -> Column:
    """A rule that needs no model: each line of a text as a record, in the JSON that an extractor would give.

    The first word is the name, an e-mail address gives contact and website, the first number of four digits the year (else
    0, which stands for none), the line's second word and its last are taken for a founder's name.
    """
    def parts(line: Column) -> Column:
        mail = F.regexp_extract(line, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0)
        return F.struct(line.alias("line"), T.words(line).alias("words"), F.when(F.contains(line, F.lit("@")), mail).otherwise("").alias("mail"))

    def record(p: Column) -> Column:
        words = p["words"]
        person = F.concat_ws(" ", F.get(words, 1), F.element_at(words, -1))
        return F.struct(
            F.regexp_replace(F.element_at(words, 1), r"[.,;]+$", "").alias("name"), p["line"].alias("description"), p["mail"].alias("contact_info"),
            F.substring_index(p["mail"], "@", -1).alias("website"), F.coalesce(F.regexp_extract(p["line"], "(?<![0-9])[0-9]{4}(?![0-9])", 0).try_cast("int"), F.lit(0)).alias("founded_year"),
            F.when(F.size(words) > 1, F.array(person)).otherwise(F.array().cast("array<string>")).alias("founders"),
        )

    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != "")
    return F.to_json(F.struct(F.transform(F.transform(lines, parts), record).alias(root)))
