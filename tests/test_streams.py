"""Streams with state: replays, retention and order across batches, against plain replays in Python."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from lodestrata import plans
from lodestrata.scratch import scratch
from lodestrata.streaming import jobs, states, upserts
from pyspark.sql import functions as F

ROWS = "k long, seq long, v string"


def stream(spark, batches, schema):
    folder = scratch(spark, "batches")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
    return jobs.stream_of(spark, folder, spark.createDataFrame([], schema).schema)


def dealt(rows, rnd, n):
    rows = list(rows)
    rnd.shuffle(rows)
    cuts = sorted(rnd.sample(range(1, len(rows)), n - 1))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]


def latest(rows):
    best = {}
    for k, seq, v in rows:
        best[k] = max(best.get(k, (-1, "")), (seq, v))
    return sorted((k, *x) for k, x in best.items())


@pytest.fixture
def changes():
    rnd = random.Random(5)
    return [(rnd.randrange(40), seq, rnd.choice("abcd")) for seq in range(300)] + [(0, 299, "z"), (0, 299, "y")]


def open_table(spark, folder):
    return upserts.SnapshotTable(spark, f"{folder}/table", spark.createDataFrame([], ROWS).schema, ["k"], buckets=4)


def test_any_deal_into_batches_gives_the_same_table(spark, changes):
    for seed, n in ((1, 1), (2, 3), (3, 5)):
        f = scratch(spark, "t")
        got = upserts.upsert_stream(stream(spark, dealt(changes, random.Random(seed), n), ROWS), open_table(spark, f), ["seq"], f"{f}/state")
        assert sorted(map(tuple, got.collect())) == latest(changes)


@pytest.mark.parametrize("dies", ["before the commit", "after the commit"])
def test_a_batch_that_died_comes_again_and_counts_once(spark, changes, dies, monkeypatch):
    f = scratch(spark, "t")
    batches = dealt(changes, random.Random(4), 4)
    target, whole = open_table(spark, f), upserts.SnapshotTable.commit
    source = stream(spark, batches, ROWS)

    def killed(self, number, folders):
        if number == 2:
            if dies == "after the commit":
                whole(self, number, folders)
            raise RuntimeError("killed")
        whole(self, number, folders)

    monkeypatch.setattr(upserts.SnapshotTable, "commit", killed)
    with pytest.raises(Exception, match="killed"):
        upserts.upsert_stream(source, target, ["seq"], f"{f}/state")
    assert target.last_batch() == (2 if dies == "after the commit" else 1)
    monkeypatch.setattr(upserts.SnapshotTable, "commit", whole)
    before = [tuple(r) for r in target.commits().where("batch = 2").collect()]
    got = upserts.upsert_stream(source, target, ["seq"], f"{f}/state")
    assert sorted(map(tuple, got.collect())) == latest(changes) and target.last_batch() == 3
    assert not before or [tuple(r) for r in target.commits().where("batch = 2").collect()] == before
    assert upserts.upsert_stream(source, target, ["seq"], f"{f}/state").count() == got.count()  # nothing new


def test_a_batch_put_in_twice_changes_nothing_and_old_states_stay(spark, changes):
    target = open_table(spark, scratch(spark, "t"))
    first, second = changes[:150], changes[150:]
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    assert target.read().count() == 0 and target.last_batch() is None
    assert target.merge(frame(first), 0, ["seq"]) and not target.merge(frame(second), 0, ["seq"])
    assert target.merge(frame(second), 1, ["seq"]) and target.merge(frame([]), 2, ["seq"])
    assert sorted(map(tuple, target.read(as_of=0).collect())) == latest(first)
    assert sorted(map(tuple, target.read().collect())) == latest(changes)
    old, new = {r[0]: r for r in latest(first)}, {r[0]: r for r in latest(changes)}
    got = {r["k"]: r["kind"] for r in upserts.changes(target, since=0).collect()}
    assert got == {k: "changed" if k in old else "new" for k in new if old.get(k) != new[k]}


def test_only_touched_buckets_are_written(spark):
    target = open_table(spark, scratch(spark, "t"))
    target.merge(spark.range(100).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("seq"), F.lit("a").alias("v")), 0, ["seq"])
    target.merge(spark.createDataFrame([(7, 1, "b")], ROWS), 1, ["seq"])
    assert target.commits().where("batch = 0").count() == 4 and target.commits().where("batch = 1").count() == 1
    assert target.read().where("v = 'b'").count() == 1 and target.read().count() == 100


def recent(batches, keep):
    seen, out = {}, []
    for batch in batches:
        for box, i, at in sorted((r for r in batch if r[1] is not None), key=lambda r: (r[2], r[1])):
            own = seen.setdefault(box, [])
            if i not in own:
                own.append(i)
                out.append((box, i, at))
                del own[:-keep]
    return sorted(out)


def test_recent_ids_are_bounded(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("ab"), rnd.choice([None, *(f"m{k}" for k in range(30))]), seq) for seq in range(400)]
    for keep, n in ((5, 3), (25, 2), (2000, 3)):
        batches = dealt(rows, random.Random(keep), n)
        f = scratch(spark, "t")
        found = states.recent_ids(stream(spark, batches, "box string, id string, at long"), "box", "id", "at", keep)
        got = jobs.run_available(found, f"{f}/out", f"{f}/state")
        assert sorted(map(tuple, got.collect())) == recent(batches, keep)


def test_query_of_recent_ids(spark, sf_dir):
    e = [(r["event_type"], str(r["user_id"]), r["event_id"]) for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()]
    want = recent([[r] for r in sorted(e, key=lambda r: r[2])], 50)
    assert sorted(map(tuple, plans.QUERIES["stream_recent_ids"](spark, sf_dir).collect())) == want


DAY = 86_400_000_000


def lives(events):
    """A profile's life, event by event, kept as a plain dictionary: (key, at, seq) -> what is known after it."""
    profiles, out = {}, {}
    for e in sorted(events, key=lambda e: (e["at"], e["seq"])):
        p = profiles.setdefault(e["key"], {"status": "unprobed", "short": 0, "step": 0, "probed": None, "version": 0, "strategy": None, "source": None, "recall": None, "reason": None})
        status, kind = p["status"], e["kind"]
        if kind == "probe":
            worn = status in ("unprobed", "stale") or p["version"] < e["version"] or p["short"] >= 2 or (p["probed"] is not None and e["at"] - p["probed"] > 30 * DAY)
            if status != "pinned" and (e["forced"] or worn):
                p.update(status="active", short=0, probed=e["at"], version=e["version"], strategy=e["strategy"], source="deterministic", reason=None)
        elif kind == "guess":
            if status == "unprobed":
                p.update(status="active", strategy=e["strategy"], source="speculative")
        elif status == "unprobed":
            pass
        elif kind == "recall":
            p["recall"] = e["extracted"] / e["expected"] if e["expected"] else 1.0
            p["short"] = 0 if e["recovered"] or p["recall"] >= 1 else p["short"] + 1
            if p["short"] >= 2 and status != "pinned":
                p.update(status="flagged", reason=f"{e['extracted']} of {e['expected']}, {p['short']} in a row")
        elif kind == "retry":
            p["step"] = e["step"]
            if e["recovered"]:
                p.update(strategy=e["strategy"], source="learned")
        elif kind == "pin":
            p["status"] = "pinned"
        elif kind == "unpin":
            p.update(status="active", short=0, reason=None)
        elif kind == "stale" and status != "pinned":
            p["status"] = "stale"
        out[e["key"], e["at"], e["seq"]] = (kind, *p.values())
    return out


def micros(t):
    return round(t.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


def shown(got):
    stamp = lambda t: None if t is None else micros(t)
    return {(r["key"], micros(r["at"]), r["seq"]): (r["kind"], r["status"], r["shortfalls"], r["step"], stamp(r["probed_at"]), r["version"], r["strategy"], r["source"], r["recall"], r["reason"]) for r in got.collect()}


def test_profiles_live_in_the_order_of_event_time(spark):
    """Batches bring events out of order, as late as an hour; the result is that of one sorted replay."""
    rnd = random.Random(7)
    begin = datetime(2024, 1, 1)
    kinds = ["probe", "recall", "recall", "recall", "retry", "pin", "unpin", "stale", "guess", "other"]
    rows = []
    for seq in range(400):
        at = begin + timedelta(minutes=seq * 10 if seq < 350 else seq * 10 + 60 * 24 * 40, microseconds=rnd.randrange(3) * 700)
        rows.append((rnd.randrange(6), at, seq, rnd.choice(kinds), rnd.randrange(4), rnd.randrange(4), rnd.random() < 0.2, rnd.randrange(8), seq // 150, rnd.choice("xyz"), rnd.random() < 0.2))
    late = sorted(rows, key=lambda r: (r[1] + timedelta(minutes=rnd.randrange(50)), r[2]))
    batches = [late[a : a + 80] for a in range(0, 400, 80)]
    schema = "site long, at timestamp, seq long, kind string, expected long, extracted long, recovered boolean, step int, version int, strategy string, forced boolean"
    f = scratch(spark, "t")
    got = jobs.run_available(states.profile_states(stream(spark, batches, schema), "site", "at", "1 hour"), f"{f}/out", f"{f}/state")
    events = [dict(zip(("key", "at", "seq", "kind", "expected", "extracted", "recovered", "step", "version", "strategy", "forced"), r, strict=True)) for r in rows]
    for e in events:
        e["at"] = micros(e["at"])
    until = (max(e["at"] for e in events) // 1000 - 3_600_000) * 1000
    want = {k: v for k, v in lives(events).items() if k[1] <= until}
    assert shown(got) == want and {v[1] for v in want.values()} >= {"active", "flagged", "stale", "pinned"}


class Held:
    """A state store that counts what it is asked."""

    def __init__(self):
        self.parts, self.value, self.timers, self.calls = [], None, set(), 0

    def getListState(self, *_):
        return Calls(self, appendList=lambda x: self.parts.extend(x), put=lambda x: setattr(self, "parts", list(x)), get=lambda: iter(self.parts), clear=lambda: self.parts.clear())

    def getValueState(self, *_):
        return Calls(self, get=lambda: self.value, update=lambda x: setattr(self, "value", x), exists=lambda: self.value is not None)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


class Calls:
    def __init__(self, held, **kinds):
        def counted(f):
            def call(*a):
                held.calls += 1
                return f(*a)

            return call

        for k, f in kinds.items():
            setattr(self, k, counted(f))


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_calls_to_the_state_grow_with_batches_not_with_events(spark):
    """A timer and calls for each event made events a hundred times as dear (F10)."""
    names = ("key", "at", *states._EVENT)
    schema = "key long, at long, " + ", ".join(f"{k} {v}" for k, v in states._EVENT.items())
    held, lives_of = Held(), states._Profiles(states.to_arrow_schema(spark.createDataFrame([], schema).schema))
    lives_of.init(held)
    event = lambda i: dict(zip(names, (i % 7, i * 1000, i, "probe", 0, 0, False, 0, 0, "x", True), strict=True))
    got = []
    for batch in range(4):
        list(lives_of.handleInputRows((0,), iter([pd.DataFrame([event(i) for i in range(batch * 500, batch * 500 + 500)])]), None))
        now = batch * 500 + 400
        for ms in sorted(t for t in held.timers if t <= now):
            held.timers.discard(ms)
            for frame in lives_of.handleExpiredTimer((0,), Now(now), Now(ms)):
                got += list(zip(frame["key"], frame["seq"], strict=True))
    assert sorted(got) == sorted((i % 7, i) for i in range(1901)) and held.calls < 60


def test_null_and_large_keys_have_their_own_lives(spark):
    f, big = scratch(spark, "t"), (1 << 60) + 1
    at = lambda i: datetime(2024, 1, 1) + timedelta(hours=i)
    rows = [(k, at(i), i, "probe" if i < 2 else "stale", "x", True) for i in range(4) for k in (None, big, big + 1)] + [(5, at(9), 9, "other", "x", False)]
    got = jobs.run_available(states.profile_states(stream(spark, [rows, []], "k long, t timestamp, seq long, kind string, strategy string, forced boolean"), "k", "t", groups=1), f"{f}/out", f"{f}/state")
    assert sorted(((r["key"] or 0), r["seq"], r["status"]) for r in got.collect()) == sorted(((k or 0), i, "active" if i < 2 else "stale") for i in range(4) for k in (None, big, big + 1))


def test_large_batches_are_several_files(spark):
    from lodestrata.plans.flows import _in_batches

    def files(**k):
        f = scratch(spark, "t")
        rows = _in_batches(spark, spark.range(4000), "id", "x", **k).select(F.input_file_name().alias("f"), "id")
        return [r["count"] for r in jobs.run_available(rows, f"{f}/out", f"{f}/state").groupBy("f").count().collect()]

    assert len(files()) == 4 and len(some := files(rows=300)) == 12 and sum(some) == 4000


def test_query_of_profiles(spark, sf_dir):
    from lodestrata.plans.flows import profile_events

    events = [r.asDict() for r in profile_events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumnRenamed("user_id", "key").collect()]
    until = (max(e["at"] for e in events) // 1000 - 600_000) * 1000
    assert shown(plans.QUERIES["stream_profile_states"](spark, sf_dir)) == {k: v for k, v in lives(events).items() if k[1] <= until}
