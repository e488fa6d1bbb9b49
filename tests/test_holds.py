"""The keyed holds over states kept in plain dictionaries, which count what is touched."""

import random
import tempfile

import pandas as pd

from daybook.streaming.holds import DAY_MS, hold_and_release, hold_processor, hold_step

COLUMNS = ["ident", "kind", "key", "at", "until", "rank"]


class State:
    """A map or value state that counts its reads and refuses to be walked."""

    def __init__(self, walk=True):
        self.held, self.reads, self.walk = {}, 0, walk

    def containsKey(self, key):
        self.reads += 1
        return key in self.held

    def getValue(self, key):
        self.reads += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        self.held.pop(key, None)

    def iterator(self):
        assert self.walk, "the whole map is walked"
        return iter(list(self.held.items()))

    def clear(self):
        self.held.clear()

    def exists(self):
        return None in self.held

    def get(self):
        return self.held[None]

    def update(self, value):
        self.held[None] = value


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, State(walk=name == "held"))

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, at, watermark=0):
        self.at, self.watermark = at, watermark

    def getExpiryTimeInMs(self):
        return self.at

    def getCurrentWatermarkInMs(self):
        return self.watermark


def started():
    handle, processor = Handle(), hold_processor(3)
    processor.init(handle)
    return handle, processor


def take(processor, *events):
    rows = pd.DataFrame([("i", k, unit, pd.Timestamp(at, unit="ms"),
                          pd.Timestamp(until or 0, unit="ms"), 0)
                         for k, unit, at, until in events], columns=COLUMNS)
    (out,) = processor.handleInputRows(("i",), iter([rows]), None)
    return [tuple(r) for r in out[["key", "outcome"]].itertuples(index=False)]


def fire(handle, processor, watermark):
    """All timers up to the watermark, as the engine fires them."""
    out = []
    while due := sorted(t for t in handle.timers if t <= watermark):
        handle.timers.discard(due[0])
        (rows,) = processor.handleExpiredTimer(("i",), Clock(due[0], watermark), Clock(due[0]))
        out += rows["key"].tolist()
    return out


def test_a_timer_touches_what_is_due_and_nothing_else():
    handle, processor = started()
    take(processor, ("resolved", None, 0, None),
         *[("day", f"k{i}", 1_000 + i, None) for i in range(10_000)])
    for state in handle.states.values():
        state.reads = 0
    assert fire(handle, processor, 1_000 + 3 * DAY_MS) == ["k0"]
    assert sum(s.reads for s in handle.states.values()) < 10
    assert len(handle.states["queued"].held) == len(handle.states["due"].held) == 9_999


def test_leases_go_when_they_end_whether_or_not_their_key_was_queued():
    handle, processor = started()
    take(processor, ("lease", "never", 0, 5_000), ("lease", "never", 1, 9_000),
         ("lease", "never", 2, 4_000), ("resolved", None, 0, None), ("day", "a", 0, None),
         ("day", "b", 0, None), ("lease", "a", 1, 4 * DAY_MS))
    assert fire(handle, processor, 8_000) == [] and ("never",) in handle.states["leases"].held
    assert fire(handle, processor, 10_000) == [] and ("never",) not in handle.states["leases"].held
    assert fire(handle, processor, 3 * DAY_MS) == ["b"]
    assert fire(handle, processor, 4 * DAY_MS - 1) == []
    assert fire(handle, processor, 4 * DAY_MS) == ["a"]
    left = {n: s.held for n, s in handle.states.items() if n != "person"}
    assert not any(left.values()) and not handle.timers


def test_held_days_wait_for_the_first_resolution():
    handle, processor = started()
    assert take(processor, ("day", "a", 5, None), ("day", "a", 6, None)) == []
    assert take(processor, ("resolved", None, 9, None)) == [("a", "queued")]
    assert take(processor, ("resolved", None, 11, None), ("day", "b", 10, None)) == [("b", "queued")]
    assert handle.states["queued"].held == {("a",): (9 + 3 * DAY_MS,), ("b",): (10 + 3 * DAY_MS,)}


class Group:
    """A group state that counts its reads and writes."""

    def __init__(self):
        self.value, self.timeout, self.watermark, self.calls = None, None, 0, 0

    exists = property(lambda self: self.value is not None)

    @property
    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, at):
        assert at >= self.watermark
        self.timeout = at


def stepped(step, state, *events):
    """(ident, key, outcome, ms) of one call; events are (ident, kind, key, at, until)."""
    rows = pd.DataFrame([(i, k, unit, pd.Timestamp(at, unit="ms"),
                          pd.Timestamp(until or 0, unit="ms"), 1)
                         for i, k, unit, at, until in events], columns=COLUMNS)
    state.timeout = None
    return [(i, k, o, int(at.timestamp() * 1000)) for piece in step((0,), iter([rows]), state)
            for i, k, o, at in piece[["ident", "key", "outcome", "at"]].itertuples(index=False)]


def test_a_bucket_holds_by_the_rules_of_its_identifiers_alone():
    rng = random.Random(5)
    for _trial in range(40):
        step, state, alone, ours, theirs = hold_step(3), Group(), {}, [], []
        watermark = 0
        for _batch in range(6):
            batch = [(rng.choice("ab"), rng.choice(["day", "day", "lease", "resolved"]),
                      f"k{rng.randrange(6)}", watermark + rng.randrange(1, 5 * DAY_MS),
                      watermark + rng.randrange(1, 9 * DAY_MS)) for _ in range(8)]
            ours += [r[:3] for r in stepped(step, state, *batch)]
            for ident in "ab":
                handle, processor = alone.setdefault(ident, started())
                mine = [e[1:] for e in batch if e[0] == ident]
                theirs += [(ident, *r) for r in take(processor, *mine)] if mine else []
            state.watermark = watermark = max(e[3] for e in batch)
            if state.timeout is not None and state.timeout < watermark:
                ours += [r[:3] for r in stepped(step, state)]
            for ident, (handle, processor) in alone.items():
                theirs += [(ident, key, "stale") for key in fire(handle, processor, watermark)]
        assert sorted(ours) == sorted(theirs)


def test_a_batch_reads_and_writes_its_state_once_whatever_it_brings():
    step, state = hold_step(3), Group()
    stepped(step, state, *[(f"i{i}", "resolved", None, 0, None) for i in range(100)])
    state.calls = 0
    out = stepped(step, state, *[(f"i{i}", "day", f"k{d}", 1_000 + d, None)
                                 for i in range(100) for d in range(50)])
    assert len(out) == 5_000 and state.calls == 2
    state.watermark, state.calls = 1_000 + 3 * DAY_MS, 0
    assert stepped(step, state) == [(f"i{i}", "k0", "stale", state.watermark) for i in range(100)]
    assert state.calls == 2 and state.timeout == 1_000 + 3 * DAY_MS


def test_a_stream_gathers_many_identifiers_in_one_call(spark):
    plan = hold_and_release(spark.readStream.schema(
        "ident string, kind string, rank int, key string, at timestamp, until timestamp")
        .parquet(tempfile.mkdtemp(prefix="daybook-test-")), buckets=7)
    assert plan.isStreaming and "['bucket]" not in (text := plan._jdf.queryExecution().analyzed()
                                                    .toString()) and "bucket#" in text
