"""The fold against a plain in-memory one, on busy, skewed and odd conversations."""

import datetime as dt
import random

from daybook.config import Settings
from daybook.operators import fold as fo

SETTINGS = Settings(own_handles=("+15559999999",), never_ingest=("+15550000066",))
SCHEMA = ("rowid long, chat_rowid long, is_group boolean, chat_name string, is_from_me boolean, "
          "handle_raw string, sent_at timestamp, date_raw long, text string")


def rows(seed, n=3000, hot=0.4):
    rnd = random.Random(seed)
    start, out = dt.datetime(2024, 3, 1), []
    people = [f"+1555000{i:04d}" for i in range(9)] + ["22395", "+15559999999", "+15550000066"]
    for i in range(n):
        chat = 7 if rnd.random() < hot else rnd.randrange(1, 30)
        at = start + dt.timedelta(seconds=rnd.randrange(3 * 86400))
        if rnd.random() < 0.3:  # many messages in one instant, and at slice borders
            at = at.replace(minute=at.minute // 5 * 5, second=0)
        handle = None if rnd.random() < 0.05 else rnd.choice(people)
        out.append((i, chat, chat % 3 == 0, "G" if chat % 6 == 0 else None, rnd.random() < 0.3,
                    handle, at, rnd.randrange(3), rnd.choice([None, "", "ok", "a longer text here"])))
    return out


def plain_fold(data):
    groups = {}
    for r in data:
        groups.setdefault((r[1], r[6].date()), []).append(r)
    units = {}
    for (chat, day), msgs in groups.items():
        msgs.sort(key=lambda r: (r[6], r[7], r[0]))
        turns, last, chars, part = [], None, 0, set()
        for r in msgs:
            mine = r[4] or r[5] in SETTINGS.own_handles
            who = "(me)" if mine else (r[5] or "(unknown)")
            if r[5] and r[5] not in SETTINGS.own_handles:
                part.add(r[5])
            if who != last:
                turns.append((who, r[6]))
            last = who
            chars += len(" ".join((r[8] or "").split()))
        people = {w for w, _ in turns} - {"(me)", "(unknown)"}
        if part & set(SETTINGS.never_ingest) or (people and people <= {"22395"}):
            continue
        if len(turns) < 2 or len({w for w, _ in turns}) < 2 or chars < 20:
            continue
        for p in people - {"22395"}:
            units.setdefault((p, day), []).append((turns, len(msgs)))
    out = {}
    for (p, day), parts in units.items():
        theirs = [at for t, _ in parts for w, at in t if w == p]
        mine = [at for t, _ in parts for w, at in t if w == "(me)"]
        if not mine:
            d = "they_reached_out"
        elif len(theirs) > 1 and len(mine) > 1:
            d = "mutual"
        else:
            d = "they_reached_out" if min(theirs) <= min(mine) else "i_reached_out"
        out[p, day] = (len(parts), sum(len(t) for t, _ in parts), len(theirs), len(mine),
                       sum(n for _, n in parts), d)
    return out


def test_fold_equals_plain_fold(spark):
    for seed, hot in ((1, 0.05), (2, 0.6)):
        data = rows(seed, hot=hot)
        got = fo.fold(spark.createDataFrame(data, SCHEMA), SETTINGS)["person_days"].collect()
        assert {(r.ident, r.day): (r.chats, r.turns, r.their_turns, r.my_turns, r.messages,
                                   r.direction) for r in got} == plain_fold(data)


def test_slice_width_does_not_change_turns(spark):
    data = spark.createDataFrame(rows(3), SCHEMA)
    seen = []
    for seconds in (1, 300, 86_400):
        s = Settings(own_handles=SETTINGS.own_handles, slice_seconds=seconds)
        voice = fo.voices(fo.prepare(data, s))
        seen.append(sorted((r.chat_rowid, str(r.day), r.speaker, r.turns)
                           for r in fo.speakers(voice, s).collect()))
    assert seen[0] == seen[1] == seen[2]


def test_shared_fold_is_the_same(spark):
    data = spark.createDataFrame(rows(4), SCHEMA)
    a, b = (sorted(map(str, fo.fold(data, SETTINGS, shared=s)["person_days"].collect()))
            for s in (False, True))
    assert a == b and a


def test_empty_own_handles_refused():
    import pytest
    with pytest.raises(ValueError):
        Settings(own_handles=())
