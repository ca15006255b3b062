"""Personal data: base patterns, then bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the base patterns' spans. The two whole words before a seed's token are a lexical pattern. Patterns and instances
(identifier-like strings of one or several tokens and the spans found so far) form a graph that is scored round by round: a pattern's confidence
in a kind is the share of all its occurrences in the corpus that introduce a known instance of that kind, given enough
different ones; an unseen instance's score is the noisy-or of the confidences of its patterns, those below ``trust`` left out. Instances that score high
enough and have the form of the kind (its characters and number of digits, whatever the separators, or the shape of some
seeds) become known; every round takes the patterns from all instances known by then, and the rounds end when no instance
is new. All their occurrences are spans, too, but for those within others.

Candidates are single tokens of 6 to 64 characters with '@' or 4 digits, runs of digit groups with blanks (7 to 19 digits,
as long as they go on) and addresses in words ('name at host', 6 to 64 characters). Identifiers of other makes aren't found.

The regular expressions are possessive, so long runs cost no backtracking and no deep recursion; they match what the
plain ones match, leftmost and without overlap. One pass over the texts finds base spans and candidate instances, a
pass a round counts the patterns that have found support in it (a bitmap of fixed size, broadcast, singles them out before the
shuffle, and sums are made before it). All else works on spans.

Defined cases: null text is empty and has no spans; n_email to n_phone count base spans; rows with equal ids are judged
each (rows that repeat id and text alike); spans of the method that overlap a base span aren't added; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, written

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
_REGEX = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + CASE WHEN (length({_DIGITS}) - i) % 2 = 0
    THEN cast(substr({_DIGITS}, i, 1) AS int)
    ELSE 2 * cast(substr({_DIGITS}, i, 1) AS int) - IF(substr({_DIGITS}, i, 1) > '4', 9, 0) END) % 10 = 0"""
_VALID = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND coalesce(try_cast(trim(LEADING '0' FROM p) AS int), 0) <= 255)",
    "card": _LUHN,
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
#: Matches of a text that are folded as one chunk.
_CHUNK = 500
_SPAN = "struct<s: int, k: int, e: int, m: string, l: string>"
#: Tokens that may be identifiers, with what surrounds their core.
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_CORE = r"(?:\+|\+?\((?=[0-9]++\)[0-9./-]))?[\p{L}0-9](?:.*[\p{L}0-9])?"
#: Groups of digits in several tokens, such as cards and phones with blanks, as long as they go on.
_RUN = r"""(?<![\p{L}0-9+./-])(?:\+?+\((?=[0-9]++\))|\+)?+[0-9][0-9()./-]*+(?:[ \t]++(?:[-/][ \t]++)?+\(?+[0-9][0-9()./-]*+(?=[\s,;!?"'>\]]|\z))++"""
_RUN_CORE = ".*[0-9]"
#: Addresses in words: name at host, name(at)host, with dots as such or in words.
_AT = r"(?i)(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++(?:[ \t]++at[ \t]++|[ \t]*+(?:\(at\)|\[at\]|\{at\})[ \t]*+)(?=[0-9-]*+\p{L})[\p{L}0-9-]++(?:(?:\.|[ \t]++dot[ \t]++|[ \t]*+(?:\(dot\)|\[dot\]|\{dot\})[ \t]*+)[\p{L}0-9-]++)*+(?![ \t]++at[ \t])"
#: The last two whole words of what precedes a place, and what of a third touches it.
_LAST = r"(?<!\S)(?:\S++\s++){0,2}+\S*+\z"
#: SQL for an instance with runs of digits and of letters as one character each.
_SHAPE = "regexp_replace(regexp_replace(instance, '[0-9]+', '0'), '\\\\p{L}+', 'a')"
_QUAD = "^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$"
#: SQL for the kinds that an instance may be of by its characters and number of digits, whatever its separators.
_FORMS = f"""filter(array(
    IF(instance RLIKE '[^ @]@[^ @]|[(\\[{{]at[)\\]}}]| at ' AND instance RLIKE '\\\\p{{L}}', 0, -1), IF(instance RLIKE '{_QUAD}', 1, -1),
    IF(instance RLIKE '^[0-9+()./ -]+$' AND NOT instance RLIKE '{_QUAD}' AND length(regexp_replace(instance, '[^0-9]', '')) BETWEEN 12 AND 19, 2, -1),
    IF(instance RLIKE '^[0-9+()./ -]+$' AND NOT instance RLIKE '{_QUAD}' AND length(regexp_replace(instance, '[^0-9]', '')) BETWEEN 7 AND 15, 3, -1)), x -> x >= 0)"""
#: SQL for the instance that a string is.
_INSTANCE = "regexp_replace(lower({}), '\\\\s+', ' ')"


def _sql(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _flat(text: str) -> str:
    """SQL for a text in lower case with all digits alike."""
    return f"translate(lower({text}), '123456789', '000000000')"


def _before(context: str) -> str:
    """SQL for the two whole words before the token that follows or ends a context; empty if there are fewer."""
    words = f"regexp_extract({_flat(context)}, {_sql(r'(?<!\S)(\S++\s++\S++)\s++\S*+\z')}, 1)"
    return f"regexp_replace({words}, {_sql(r'\s+')}, ' ')"


def _matches(regex: str, kind: int, valid: str, core: str | None = None) -> str:
    """SQL for the spans of ``regex`` in ``text``: start, kind, end, string and the two words before its token, in one
    fold over the matches and what lies between them, which carries the last words along."""
    rx, last = _sql(regex), _sql(_LAST)
    at = f"regexp_instr(x.m, {_sql(core)}) - 1" if core else "0"
    m = f"regexp_extract(x.m, {_sql(core)}, 0)" if core else "x.m"
    span = f"""transform(filter(array({m}), m -> {valid}), m -> struct(a.pos + length(x.g) + {at} AS s, {kind} AS k, a.pos + length(x.g) + {at} + length(m) AS e, m, {_before("c")} AS l))"""
    step = f"""struct(a.pos + length(x.g) + length(x.m) AS pos, regexp_extract(concat(c, x.m), {last}, 0) AS tail, concat(a.out, {span}) AS out)"""
    # in chunks, as each step copies what it has found so far
    fold = f"""element_at(transform(array(zip_with(split(text, {rx}, -1), regexp_extract_all(text, {rx}, 0), (g, m) -> struct(g, m))), z -> aggregate(
        sequence(0, (size(z) - 1) div {_CHUNK}), struct(0 AS pos, '' AS tail, cast(array() AS array<array<{_SPAN}>>) AS outs),
        (o, i) -> aggregate(slice(z, i * {_CHUNK} + 1, {_CHUNK}), struct(o.pos AS pos, o.tail AS tail, cast(array() AS array<{_SPAN}>) AS out),
            (a, x) -> IF(x.m IS NULL, a, element_at(transform(array(regexp_extract(concat(a.tail, x.g), {last}, 0)), c -> {step}), 1)),
            a -> struct(a.pos AS pos, a.tail AS tail, concat(o.outs, array(a.out)) AS outs)),
        o -> flatten(o.outs))), 1)"""
    return f"CASE WHEN text RLIKE {rx} THEN {fold} ELSE cast(array() AS array<{_SPAN}>) END"


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tk (hash of the text), base (spans, unordered) and loose (other strings that may be identifiers)."""
    rows = id_text(docs, id_col, text_col)
    base = "concat(" + ", ".join(_matches(_REGEX[k], i, _VALID[k]) for i, k in enumerate(KINDS)) + ")"
    like = "length(m) BETWEEN 6 AND 64 AND (m LIKE '%@%' OR length(regexp_replace(m, '[^0-9]', '')) >= 4)"
    digits = f"length({_DIGITS}) BETWEEN 7 AND 19 AND NOT m RLIKE '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+ '"
    several = f"concat({_matches(_RUN, -1, digits, core=_RUN_CORE)}, {_matches(_AT, -1, 'length(m) BETWEEN 6 AND 64')})"
    found = rows.withColumn("base", F.expr(base)).withColumn("several", F.expr(several)).withColumn("tokens", F.expr(_matches(_TOKEN, -1, like, core=_CORE)))
    # of candidates with one start only the longer, so that no occurrence of a pattern counts twice
    one = "concat(filter(tokens, t -> NOT exists(several, x -> x.s = t.s)), several)"
    apart = F.expr(f"filter({one}, t -> NOT exists(base, b -> b.s < t.e AND t.s < b.e))")
    return found.select("doc_id", F.xxhash64("text").alias("tk"), "base", apart.alias("loose"))


def _pattern_counts(docs: DataFrame, patterns: DataFrame, bits: int, id_col: str, text_col: str) -> DataFrame:
    """How often each of ``patterns`` occurs in the corpus, followed by whatever."""
    place = lambda h: F.pmod(h, F.lit(1 << bits))
    marked = patterns.select(place(F.xxhash64("pattern")).alias("p"))
    filters = marked.groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("bitmap"))
    words = F.filter(F.split(F.expr(_flat("text")), r"\s+"), lambda w: w != "")
    rows = id_text(docs, id_col, text_col).select(words.alias("w"))
    pairs = rows.select(F.explode(F.expr("zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> concat(a, ' ', b))")).alias("pattern"))
    pairs = pairs.withColumn("p", place(F.xxhash64("pattern"))).withColumn("bucket", F.expr("bitmap_bucket_number(p + 1)"))
    bit = "bit_get(cast(conv(hex(substring(bitmap, cast(bitmap_bit_position(p + 1) div 8 + 1 as int), 1)), 16, 10) as int), cast(bitmap_bit_position(p + 1) % 8 as int)) = 1"
    some = pairs.join(F.broadcast(filters), "bucket").filter(F.expr(bit))
    counts = some.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(patterns.select("pattern"), "pattern", "left_semi")


def discover(docs: DataFrame, spans: DataFrame, support: int = 3, confidence: float = 0.9, trust: float = 0.3, filter_bits: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Instances that the graph makes known beyond the seeds: (instance, kind); None if there is none."""
    every = spans.select("tk", F.explode(F.concat("base", "loose")).alias("x")).select("tk", "x.*")
    every = every.select("k", F.expr(_INSTANCE.format("m")).alias("instance"), F.col("l").alias("pattern")).filter("pattern <> ''")
    edges = written(every.groupBy("pattern", "instance", "k").agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    seeds = edges.filter("k >= 0").withColumn("shape", F.expr(_SHAPE))
    shapes = written(seeds.groupBy("k", "shape").agg(F.countDistinct("instance").alias("d")).filter(F.col("d") >= support).select(F.col("k").alias("kind"), "shape"), "pii-shapes")
    kinds = seeds.groupBy(F.col("k").alias("kind")).agg(F.countDistinct("instance").alias("d")).filter(F.col("d") >= support).select("kind")
    unseen = edges.filter("k < 0").select("instance").distinct()
    formed = unseen.select("instance", F.explode(F.expr(_FORMS)).alias("kind")).join(F.broadcast(kinds), "kind").select("instance", "kind")
    shaped = unseen.withColumn("shape", F.expr(_SHAPE)).join(shapes, "shape").select("instance", "kind")
    may = written(formed.unionByName(shaped).distinct(), "pii-may")
    known = written(seeds.select("instance", F.col("k").alias("kind")).distinct(), "pii-known")
    found = partial = totals = None
    # what a part of the rows has of a pattern is no more than its total: many patterns are ruled out by that alone
    part = docs.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(8)) == 0)
    while True:
        met = written(edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("n").alias("n"), F.countDistinct("instance").alias("d")).filter(F.col("d") >= support).drop("d"), "pii-met")
        # only patterns that stand before an unseen instance of a kind's form can make one known: no other is counted
        hopeful = edges.filter("k < 0").join(may, "instance").join(known.select("instance"), "instance", "left_anti").select("pattern", "kind")
        met = written(met.join(hopeful, ["pattern", "kind"], "left_semi"), "pii-hopeful")
        fresh = met.select("pattern").distinct()
        fresh = written(fresh if partial is None else fresh.join(partial, "pattern", "left_anti"), "pii-patterns")
        if not fresh.isEmpty():
            some = fresh.join(_pattern_counts(part, fresh, filter_bits, id_col, text_col), "pattern", "left").select("pattern", F.coalesce("total", F.lit(0)).alias("some"))
            some = written(some, "pii-partial")
            partial = some if partial is None else partial.unionByName(some)
        if partial is None:
            return None
        likely = met.join(partial, "pattern").filter(F.col("n") >= trust * F.col("some")).select("pattern").distinct()
        likely = written(likely if totals is None else likely.join(totals, "pattern", "left_anti"), "pii-likely")
        if not likely.isEmpty():
            counts = written(_pattern_counts(docs, likely, filter_bits, id_col, text_col), "pii-totals")
            totals = counts if totals is None else totals.unionByName(counts)
        if totals is None:
            return None
        scored = met.join(totals, "pattern").select("pattern", "kind", F.least(F.lit(0.999), F.col("n") / F.col("total")).alias("c")).filter(F.col("c") >= trust)
        new = edges.filter("k < 0").join(known, "instance", "left_anti").join(scored, "pattern").join(may, ["instance", "kind"])
        new = new.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("c"))))).alias("score")).filter(F.col("score") >= confidence)
        new = new.groupBy("instance").agg(F.min_by("kind", F.struct(-F.col("score"), F.col("kind"))).alias("kind"))
        new = written(new, "pii-new")
        if new.isEmpty():
            return found
        known = known.unionByName(new)
        found = new if found is None else found.unionByName(new)


def _listed(spans: str) -> str:
    """SQL for spans as ``kind:start:end`` in order, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(array_sort(transform({spans}, x -> struct(x.s, x.k, x.e))), x -> concat_ws(':', element_at({names}, x.k + 1), x.s, x.e)), ',')"


def find_personal_data(docs: DataFrame, support: int = 3, confidence: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all spans, listed)."""
    spans = written(base_spans(docs, id_col, text_col), "pii-spans")
    found = discover(docs, spans, support, confidence, id_col=id_col, text_col=text_col)
    if found is None:
        full = spans.withColumn("all", F.col("base"))
    else:
        loose = spans.filter("size(loose) > 0").select("doc_id", "tk", F.explode("loose").alias("x")).select("doc_id", "tk", "x.s", "x.e", F.expr(_INSTANCE.format("x.m")).alias("instance"), "x.m", "x.l")
        more = loose.join(found, "instance").select(F.col("doc_id").alias("d2"), F.col("tk").alias("t2"), F.struct("s", F.col("kind").alias("k"), "e", "m", "l").alias("x"))
        more = more.groupBy("d2", "t2").agg(F.collect_set("x").alias("more"))
        more = more.withColumn("more", F.expr("filter(more, x -> NOT exists(more, y -> y.s <= x.s AND x.e <= y.e AND y.e - y.s > x.e - x.s))"))
        full = spans.join(more, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("tk") == F.col("t2")), "left").withColumn("all", F.expr("concat(base, coalesce(more, array()))"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return full.select("doc_id", *counts, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed("all")).alias("spans"))
