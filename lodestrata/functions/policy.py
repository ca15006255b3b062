"""Rules for single values: which text is better, lists that were torn apart, names that can't be one, column limits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .identity import fold, sorted_tokens, indel_ratio
from .text import language, signal, squeeze, strip

_EDGE = r"[^\p{L}\p{N}_]"


def better_text(old: Column, new: Column, reword: float = C.TRIVIAL_REWORD, margin: float = C.LENGTH_MARGIN) -> Column:
    """The more informative of two texts; NULL where nothing is to be done.

    An empty new one, or a mere rewording, changes nothing; an empty old one is filled; texts of different languages
    aren't compared; a new one that is longer by the margin wins, else the old one stays.
    """
    o, n = (strip(F.coalesce(c.cast("string"), F.lit(""))) for c in (old, new))
    ratio = indel_ratio(sorted_tokens(F.lower(o)), sorted_tokens(F.lower(n)))
    apart = language(o) != language(n)
    # lengths bound the ratio: texts that can't reach it aren't aligned
    bound = F.least(F.length(o), F.length(n)) * 200.0 / (F.length(o) + F.length(n))
    same = F.when(bound >= reword, ratio >= reword).otherwise(F.lit(False))
    return F.when(n == "", F.lit(None)).when(o == "", n).when(same, F.lit(None)).when(F.coalesce(apart, F.lit(False)), o).when(F.length(n) >= F.length(o) * margin, n).otherwise(o)


def string_list(items: Column) -> Column:
    """A list of words as it was meant: blank items go, and one of single characters that spell a list is put together
    and read as that list."""
    joined = F.array_join(items, "")
    torn = (F.size(items) > 2) & F.forall(items, lambda x: F.length(x) == 1) & joined.rlike(r"^\s*\[.*\]\s*$")
    inner = F.regexp_extract_all(joined, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0))
    whole = F.transform(inner, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.coalesce(F.filter(F.when(torn, whole).otherwise(items), lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def implausible_name(name: Column, institutions: Iterable[str] = (), incumbents: Iterable[str] = (), generic: str | None = None, headline: str | None = None, collective: str | None = None, title: str | None = None, commas: int = 1) -> Column:
    """Whether a name can't be that of one organisation: an institution or a well-known incumbent, a generic phrase, a
    heading (colon, question mark, number at the start), a list of several, a group of a region, a person with a title."""
    s = strip(F.coalesce(name, F.lit("")))
    low = F.lower(s)
    bad = signal(low, institutions) | signal(low, incumbents) | F.contains(s, F.lit(":")) | F.contains(s, F.lit("?"))
    bad = bad | (F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))) > commas)
    for pattern, start in ((generic, True), (headline, True), (collective, False), (title, False)):
        if pattern:
            bad = bad | s.rlike(f"(?iu){'^' if start else ''}(?:{pattern})")
    return (s != "") & bad


def junk_alt(alt: Column, noise: Iterable[str] = C.ALT_NOISE) -> Column:
    """Whether an image's text is no name: a noise word, a file name of a content system, or a slug of three and more."""
    s = F.lower(strip(F.coalesce(alt, F.lit(""))))
    file = s.rlike(r"\.(?:png|jpe?g|gif|svg|webp)$|^(?:img|dsc|image|screenshot)[-_ ]?\d+")
    return (F.length(s) < 2) | s.isin(*noise) | file | s.rlike(r"^\S+[-_]\S+[-_]\S+$")


def ciphered(url: Column, allowed: Iterable[str] = ("http", "https")) -> Column:
    """Whether an address has a scheme that is none."""
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return (scheme != "") & ~scheme.isin(*allowed)


def legible(text: Column, at: Column, around: int = 150, share: float = 0.1, words: int = 6) -> Column:
    """Whether the text around a place reads as language: enough words, enough of them stopwords."""
    part = F.lower(F.substring(text, F.greatest(F.lit(1), at - around), 2 * around))
    tokens = F.regexp_extract_all(part, F.lit("[a-zà-ÿ]+"), F.lit(0))
    stop = F.array(*map(F.lit, [*C.STOPWORDS_DE, *C.STOPWORDS_EN]))
    n = F.size(tokens)
    return (n >= words) & (F.size(F.filter(tokens, lambda w: F.array_contains(stop, w))) >= share * n)


def mentions(words: Iterable[str], *fields: Column) -> Column:
    """Whether any of the words occurs anywhere in the fields."""
    text = F.lower(F.concat_ws(" ", *fields))
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def fitted(value: Column, kind: str, most: int = 255) -> Column:
    """A value as its column takes it, else NULL: year (the first of four digits from 1800 to 2099), int (the first
    number) or text of at most ``most`` characters."""
    s = value.cast("string")
    if kind == "year":
        return F.regexp_extract(s, r"(?<!\d)(1[89]\d\d|20\d\d)(?!\d)", 1).try_cast("int")
    if kind == "int":
        return F.regexp_extract(s, r"-?\d+", 0).try_cast("int")
    return F.when(F.length(s) <= most, s)


def unset(c: Column) -> Column:
    """NULL for what stands for nothing: the empty string and zero."""
    return F.when(~c.cast("string").isin("", "0"), c)


def aliased(c: Column, aliases: dict[str, str]) -> Column:
    """A value by its usual name, compared by folded form."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, fold(c, {})), c)


def search_text(name: Column, city: Column, country: Column, suffix: str = "") -> Column:
    """What to ask a search service for: the name, its city or else its country, and a suffix."""
    place = F.coalesce(F.nullif(squeeze(city), F.lit("")), F.nullif(squeeze(country), F.lit("")))
    return squeeze(F.concat_ws(" ", name, place, F.lit(suffix)))


def unwrapped(url: Column, parameter: str = "uddg") -> Column:
    """The address that a redirecting one carries in a parameter, else itself."""
    inner = F.regexp_extract(url, rf"[?&]{parameter}=([^&#]+)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(url)


def official_site(url: Column, shared: Iterable[str] = C.SHARED_DOMAINS, others: Iterable[str] = C.REPORTING_DOMAINS) -> Column:
    """Whether an address can be an organisation's own: its host is neither one of those that many share, or that report on
    others, nor under one. False for none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    blocked = F.array(*map(F.lit, [*shared, *others]))
    return (host != "") & ~F.exists(blocked, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def unlisted_site(url: Column, parts: Iterable[str] = C.DIRECTORY_HOSTS) -> Column:
    """Whether an address has none of the parts that hosts of directories, networks and job boards have."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return (low != "") & ~F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p))
