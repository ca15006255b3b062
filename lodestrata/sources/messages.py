"""Feeds and mail: parsers, and Python data sources that read a folder with a partition a file.

``spark.dataSource.register(FeedSource)``, then ``spark.read.format("entity_feeds").load(path)``; likewise MailSource. Both open files by
Arrow's file systems; where only Spark can open a store, ``feed_rows`` and ``mail_rows`` parse what ``binaryFile`` reads.

A file that can't be parsed gives one row with its error and nothing else, so broken files can be counted.
"""

from __future__ import annotations

import email
import email.header
import email.utils
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from email.message import Message
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T
from ..operators.dom import text_pieces

FEED = "feed string, pos int, title string, link string, published timestamp, summary string, error string"
MAIL = "path string, pos int, message_id string, sender string, sender_name string, subject string, sent timestamp, text string, error string"
FEED_COLUMNS, MAIL_COLUMNS = ([x.split()[0] for x in s.split(", ")] for s in (FEED, MAIL))
#: Line that begins a message in a file of several.
_FROM = re.compile(rb"(?:\A|\n)From [^\n]*\n")


def when(text: str | None) -> datetime | None:
    """A date as mail or ISO 8601 writes it, in UTC; None if neither. Without a zone it is taken as UTC."""
    raw = (text or "").strip()
    for parse in (email.utils.parsedate_to_datetime, datetime.fromisoformat):
        try:
            found = parse(raw)
        except (ValueError, TypeError):
            continue
        return found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc)
    return None


def _name(tag: object) -> str:
    return str(tag).rpartition("}")[2]


def _inner(item: ElementTree.Element, *names: str) -> str | None:
    """The text of the first child of any of these names, in their order."""
    for name in names:
        for child in item:
            if _name(child.tag) == name:
                return "".join(child.itertext())
    return None


def _link(item: ElementTree.Element) -> str:
    for child in item:
        if _name(child.tag) == "link" and child.get("href") is not None:
            if child.get("rel", "alternate") == "alternate":
                return child.get("href", "").strip()
        elif _name(child.tag) == "link":
            return (child.text or "").strip()
    return ""


def feed_entries(raw: bytes, most: int = 50) -> list[tuple]:
    """(pos, title, link, published, summary, error) of the first ``most`` entries of an RSS or Atom document."""
    try:
        root = ElementTree.fromstring(raw)
    except (ElementTree.ParseError, ValueError, LookupError) as e:
        return [(None, None, None, None, None, str(e))]
    out = []
    for item in (x for x in root.iter() if _name(x.tag) in ("item", "entry")):
        if len(out) == most:
            break
        title = (_inner(item, "title") or "").strip()
        published = when(_inner(item, "pubDate", "published", "date")) or when(_inner(item, "updated"))
        out.append((len(out), title, _link(item), published, _inner(item, "description", "summary", "content") or "", None))
    return out


def header(raw: object) -> str:
    """A header with its encoded words decoded; as it is if they are broken."""
    try:
        return str(email.header.make_header(email.header.decode_header(str(raw or ""))))
    except (ValueError, LookupError, email.errors.HeaderParseError):
        return str(raw or "")


def sender_name(sender: str) -> str:
    """What stands before the address; the whole if nothing does."""
    found = re.match(r'^"?([^"<]+?)"?\s*<', sender)
    return found[1].strip() if found else sender


def mail_text(message: Message) -> str:
    """The first part, in order, that has text; of HTML what it shows, a line a piece."""
    for part in message.walk():
        if part.is_multipart() or part.get_content_type() not in ("text/plain", "text/html"):
            continue
        raw = part.get_payload(decode=True) or b""
        try:
            text = raw.decode(part.get_content_charset() or "utf-8", "ignore")
        except LookupError:
            text = raw.decode("utf-8", "ignore")
        text = "\n".join(text_pieces(text)) if part.get_content_type() == "text/html" else text
        if text:
            return text
    return ""


def mail_messages(raw: bytes) -> list[tuple]:
    """(pos, message_id, sender, sender_name, subject, sent, text, error) of a message, or of a file of several."""
    cuts = [m.end() for m in _FROM.finditer(raw)] if raw.startswith(b"From ") else []
    ends = [m.start() for m in _FROM.finditer(raw)][1:] + [len(raw)]
    out = []
    for pos, one in enumerate([raw[a:b] for a, b in zip(cuts, ends, strict=True)] if cuts else [raw]):
        try:
            m = email.message_from_bytes(one)
            if not m.keys():
                raise ValueError("no header")
            sender = header(m["From"])
            out.append((pos, header(m["Message-ID"]).strip(), sender, sender_name(sender), header(m["Subject"]), when(str(m["Date"] or "")), mail_text(m), None))
        except (ValueError, TypeError, AttributeError) as e:
            out.append((pos, *(None,) * 6, str(e)))
    return out


#: So many files have a task each; of more, a task reads several, of so many bytes, about, and so many files at most.
OWN_TASK, TASK_BYTES, TASK_FILES = 64, 4 << 20, 256


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class _Reader(DataSourceReader):
    """A partition a file under ``path``, or, where they are many, several small ones; hidden files are passed over."""

    def __init__(self, options: dict, parse: Callable[[bytes], list[tuple]]):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path, self.parse = options["path"], parse

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(name, recursive=True)) if system.get_file_info(name).type == fs.FileType.Directory else [system.get_file_info(name)]
        files = [x for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name[:1] not in "._"]
        full = min(TASK_BYTES, sum(x.size for x in files) // OWN_TASK)
        parts, room = [[]], full
        for x in files:
            if parts[-1] and (len(files) <= OWN_TASK or x.size > room or len(parts[-1]) == TASK_FILES):
                parts.append([])
                room = full
            parts[-1].append(x.path)
            room -= x.size
        return [_Files(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path in partition.value:
            with system.open_input_stream(path) as f:
                raw = f.read()
            yield from ((path, *r) for r in self.parse(raw))


class FeedSource(DataSource):
    """RSS and Atom files; option ``entries``: how many of each at most (50)."""

    @classmethod
    def name(cls) -> str:
        return "entity_feeds"

    def schema(self) -> str:
        return FEED

    def reader(self, schema) -> DataSourceReader:
        most = int(self.options.get("entries", 50))
        return _Reader(dict(self.options), lambda raw: feed_entries(raw, most))


class MailSource(DataSource):
    """Messages, one or several a file."""

    @classmethod
    def name(cls) -> str:
        return "entity_mail"

    def schema(self) -> str:
        return MAIL

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), mail_messages)


def _rows(files: DataFrame, parse: Callable[[bytes], list[tuple]], schema: str, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                frame = pd.DataFrame([(path, *r) for r in parse(bytes(raw))], columns=columns)
                if "pos" in frame:
                    frame["pos"] = frame["pos"].astype("Int32")
                yield frame

    return files.select("path", "content").mapInPandas(run, schema)


def feed_rows(files: DataFrame, most: int = 50) -> DataFrame:
    """The entries of files (path, content) as ``binaryFile`` reads them."""
    return _rows(files, lambda raw: feed_entries(raw, most), FEED, FEED_COLUMNS)


def mail_rows(files: DataFrame) -> DataFrame:
    """The messages of files (path, content) as ``binaryFile`` reads them."""
    return _rows(files, mail_messages, MAIL, MAIL_COLUMNS)


def newsletter_yield(messages: DataFrame, groups: dict[str, list[str]], trusted: list[str] | None = None) -> DataFrame:
    """(message_id, blurbs, relevant, characters): what the mail of trusted senders holds, blurb by blurb; messages without an id or
    text are passed over. Each message counts once, whatever the number of its copies."""
    own = messages.where("error IS NULL AND message_id <> '' AND text <> ''")
    if trusted is not None:
        low = F.lower("sender")
        own = own.where(F.exists(F.array(*map(F.lit, [t.lower() for t in trusted])), lambda t: F.contains(low, t)))
    one = own.groupBy("message_id").agg(F.min("text").alias("text"))
    found = one.select("message_id", F.explode_outer(T.blurbs(F.col("text"))).alias("blurb"))
    score = T.relevance(F.col("blurb"), groups)
    return found.groupBy("message_id").agg(F.count("blurb").alias("blurbs"), F.count_if(score["relevant"]).alias("relevant"), F.coalesce(F.sum(F.length("blurb")), F.lit(0)).alias("characters"))


def escaped(text: Column) -> Column:
    """Text for XML: without the characters that it can't hold, marks escaped."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def encoded_word(text: Column) -> Column:
    """A header's text as one encoded word."""
    return F.concat(F.lit("=?utf-8?B?"), F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", ""), F.lit("?="))
