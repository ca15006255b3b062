"""State by key in a stream: recently seen ids with a bound, and the life of a site's profile in the order of event time.

Both keep their state in the checkpoint (RocksDB, set by ``use_rocksdb``) and give the same results however the rows are
dealt into batches, within what each says of late rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import attrgetter

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

#: Rounds of two shortfalls flag a profile; a probe is good for so many days.
SHORTFALLS, TTL_DAYS = 2, 30


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed processors need; a session that names another one keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if not (spark.conf.get(key, "") or "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _RecentIds(StatefulProcessor):
    def __init__(self, id_col: str, order: str, keep: int):
        self.id_col, self.order, self.keep = id_col, order, keep

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "ids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = dict.fromkeys(self.seen.get()[0] if self.seen.exists() else [])
        batch = pd.concat(list(rows)).sort_values([self.order, self.id_col], kind="stable")
        fresh = []
        for i, at in zip(batch[self.id_col], batch[self.order], strict=True):
            if i not in seen:
                seen[i] = None
                fresh.append((key[0], i, at))
                if len(seen) > self.keep:
                    del seen[next(iter(seen))]
        self.seen.update((list(seen),))
        yield pd.DataFrame(fresh, columns=["mailbox", self.id_col, self.order])

    def close(self) -> None:
        pass


def recent_ids(df: DataFrame, mailbox: str, id_col: str, order: str, keep: int = 2000) -> DataFrame:
    """(mailbox, id, order) of rows whose id isn't among the last ``keep`` new ones of its mailbox.

    A mailbox's rows of one batch are taken in their order; rows of a later batch count as later. So what one task holds is
    bounded by what the source gives a trigger, and the state by ``keep``. Rows without an id are passed over.
    """
    use_rocksdb(df.sparkSession)
    kinds = dict(df.dtypes)
    rows = df.select(F.col(mailbox).alias("mailbox"), F.col(id_col).cast("string").alias(id_col), order).where(F.col(id_col).isNotNull())
    return rows.groupBy("mailbox").transformWithStateInPandas(_RecentIds(id_col, order, keep), f"mailbox {kinds[mailbox]}, {id_col} string, {order} {kinds[order]}", "append", "None")


@dataclass(frozen=True)
class Profile:
    """What is known of a site's way of being read."""

    status: str = "unprobed"
    shortfalls: int = 0
    step: int = 0
    probed_at: int | None = None  # microseconds
    version: int = 0
    strategy: str | None = None
    source: str | None = None
    recall: float | None = None
    reason: str | None = None

    def due(self, now: int, version: int) -> bool:
        """Whether it is to be probed anew; a pinned one never is."""
        if self.status == "unprobed":
            return True
        if self.status == "pinned":
            return False
        old = self.probed_at is not None and now - self.probed_at > TTL_DAYS * 86_400_000_000
        return self.status == "stale" or self.version < version or self.shortfalls >= SHORTFALLS or old

    def after(self, e: dict) -> "Profile":
        """The profile after an event; unknown kinds change nothing."""
        kind, pinned = e["kind"], self.status == "pinned"
        if kind == "probe" and not pinned and (e["forced"] or self.due(e["at"], e["version"])):
            return replace(self, status="active", shortfalls=0, probed_at=e["at"], version=e["version"], strategy=e["strategy"], source="deterministic", reason=None)
        if kind == "guess" and self.status == "unprobed":  # a strategy inferred for pages never looked at
            return replace(self, status="active", strategy=e["strategy"], source="speculative")
        if self.status == "unprobed":
            return self
        if kind == "recall":
            ratio = e["extracted"] / e["expected"] if e["expected"] else 1.0
            if e["recovered"] or ratio >= 1:
                return replace(self, recall=ratio, shortfalls=0)
            n = self.shortfalls + 1
            if n < SHORTFALLS or pinned:
                return replace(self, recall=ratio, shortfalls=n)
            return replace(self, recall=ratio, shortfalls=n, status="flagged", reason=f"{e['extracted']} of {e['expected']}, {n} in a row")
        if kind == "retry":
            learned = {"strategy": e["strategy"], "source": "learned"} if e["recovered"] else {}
            return replace(self, step=e["step"], **learned)
        if kind == "pin":
            return replace(self, status="pinned")
        if kind == "unpin":
            return replace(self, status="active", shortfalls=0, reason=None)
        if kind == "stale" and not pinned:
            return replace(self, status="stale")
        return self


_EVENT = {"seq": "long", "kind": "string", "expected": "long", "extracted": "long", "recovered": "boolean", "step": "int", "version": "int", "strategy": "string", "forced": "boolean"}
_STATE = "status string, shortfalls int, step int, probed_at long, version int, strategy string, source string, recall double, reason string"
_FIELDS = [x.split()[0] for x in _STATE.split(", ")]
_NEW, _shown = Profile(), attrgetter(*_FIELDS)


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


class _Profiles(StatefulProcessor):
    """Keys share groups, as a call to the state store or a timer for each event or key would cost far more than the event.

    What waits of a group is one Arrow table a batch, its profiles are one more, and it has a timer for the earliest event of each.
    """

    def __init__(self, events: pa.Schema):
        self.events = events
        fields = [("status", pa.string()), ("shortfalls", pa.int64()), ("step", pa.int64()), ("probed_at", pa.int64()), ("version", pa.int64()), ("strategy", pa.string()), ("source", pa.string()), ("recall", pa.float64()), ("reason", pa.string())]
        self.known = pa.schema([events.field("key"), *fields])

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.profiles = handle.getValueState("profiles", "profiles binary, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.wait(pa.concat_tables([pa.Table.from_pandas(r[self.events.names], self.events, preserve_index=False) for r in rows]), self.waiting.appendList)
        return iter(())

    def wait(self, events: pa.Table, put) -> None:
        """The events are called for when the watermark has passed the first of them. That may happen twice."""
        put([(_packed(events),)])
        self.handle.registerTimer(-(-pa.compute.min(events["at"]).as_py() // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # what the watermark has passed is whole: no earlier event can come any more
        now, known = timerValues.getCurrentWatermarkInMs(), self.profiles.get()
        if known is not None and expiredTimerInfo.getExpiryTimeInMs() <= known[1]:
            return
        events = pa.concat_tables([_unpacked(raw) for (raw,) in self.waiting.get()])
        ready = pa.compute.less_equal(events["at"], now * 1000)
        due, rest = events.filter(ready).sort_by([("at", "ascending"), ("seq", "ascending")]), events.filter(pa.compute.invert(ready))
        if rest.num_rows:
            self.wait(rest, self.waiting.put)
        else:
            self.waiting.clear()
        lives = {} if known is None else {k: Profile(*x) for k, *x in zip(*_unpacked(known[0]).to_pydict().values(), strict=True)}
        out, names = [], due.column_names
        for e in zip(*due.to_pydict().values(), strict=True):
            p = lives[e[0]] = lives.get(e[0], _NEW).after(dict(zip(names, e, strict=True)))
            out.append((*e[:4], *_shown(p)))
        columns = list(zip(*[(k, *_shown(p)) for k, p in lives.items()], strict=True)) or [()] * len(self.known)
        self.profiles.update((_packed(pa.table([pa.array(c, f.type) for c, f in zip(columns, self.known, strict=True)], schema=self.known)), now))
        if out:
            frame = pd.DataFrame(out, columns=["key", "at", "seq", "kind", *_FIELDS])
            yield frame.astype({"probed_at": "Int64"})

    def close(self) -> None:
        pass


def profile_states(df: DataFrame, key: str, at: str, late: str = "10 minutes", groups: int = 512) -> DataFrame:
    """Each event with its profile's state after it, in the order of event time, then ``seq``.

    ``df`` has the key, a timestamp and kind (probe, guess, recall, retry, pin, unpin, stale), seq, expected, extracted, recovered, step, version,
    strategy, forced; those that a kind doesn't need may be NULL. Events wait until the watermark (the latest time less
    ``late``) has passed them, so batches may bring them in any order; what comes later than that is dropped. The last
    ``late`` of a stream waits for more. Keys are dealt into ``groups``; a group's waiting events and profiles are held by a task
    at once, so very many keys want more groups. A query that goes on from its checkpoint must keep their number.
    """
    use_rocksdb(df.sparkSession)
    defaults = {"expected": 0, "extracted": 0, "recovered": False, "step": 0, "version": 0, "forced": False}
    given = [F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k) for c, k in _EVENT.items()]
    values = [F.coalesce(g, F.lit(defaults[c])).alias(c) if c in defaults else g.alias(c) for g, c in zip(given, _EVENT, strict=True)]
    rows = df.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("lode_time"), *values).withWatermark("lode_time", late).withColumn("at", F.unix_micros("lode_time"))
    kind = dict(rows.dtypes)["key"]
    # pandas would make floats of numbers beside a NULL, so keys go as texts
    text = F.col("key") if kind in ("string", "binary") else F.col("key").cast("string")
    rows = rows.withColumn("lode_group", F.pmod(F.xxhash64("key"), F.lit(groups))).withColumn("key", text)
    events = to_arrow_schema(rows.select("key", "at", *_EVENT).schema)
    out = rows.groupBy("lode_group").transformWithStateInPandas(_Profiles(events), f"key {dict(rows.dtypes)['key']}, at long, seq long, kind string, {_STATE}", "append", "EventTime")
    time = lambda c: F.timestamp_micros(c).alias(c)
    return out.select(F.col("key").cast(kind).alias("key"), time("at"), "seq", "kind", *[time(c) if c == "probed_at" else F.col(c) for c in _FIELDS])

