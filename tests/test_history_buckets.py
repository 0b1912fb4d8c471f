"""The history of a bucket of users, worked out in few calls to the state."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from riskloom.operators.history import DAY, LAST
from riskloom.streaming import history_stream as H

HOUR = 3600 * 1000 * 1000


class State:
    """A value or a map that counts its calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def getValue(self, key):  # noqa: N802
        self.calls.append(key)
        return self.held[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls.append(key)
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls.append(key)
        del self.held[key]

    def get(self):
        self.calls.append("get")
        return self.held.get("book")

    def update(self, value):
        self.calls.append("update")
        self.held["book"] = value


class Handle:
    def __init__(self):
        self.calls, self.timers, self.states = [], set(), {}

    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, State(self.calls))

    getValueState = getMapState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls.append(at)
        self.timers.add(at)


def rows_of(users, n):
    rng = random.Random(3)
    us = [10**15 + rng.randrange(4 * DAY) // HOUR * rng.choice([1, HOUR]) for _ in range(n)]
    return [(i, f"={rng.randrange(users)}", 10**15 + rng.choice([0, 1, HOUR, DAY, DAY + 1]) if i % 5 == 0 else u, rng.choice([None, *"ABCDEFG"])) for i, u in enumerate(us)]


def by_hand(rows):
    out, seen = [], {}
    for ident, user, us, merchant in sorted(rows, key=lambda r: (r[2], r[0])):
        before = seen.setdefault(user, [])
        count = sum(1 for r in rows if r[1] == user and us - DAY <= r[2] <= us)
        out.append((ident, before[-1][0] if before else None, [m for _, m in before[-LAST:]], count))
        before.append((us, merchant))
    return sorted(out, key=lambda r: r[0])


def play(rows, batches):
    """The rows in order of time, in batches, each with the watermark of the one before; what comes out, and the handle."""
    handle, processor = Handle(), H._History("event_id", "us", "merchant_id", HOUR)
    processor.init(handle)
    order = sorted(rows, key=lambda r: r[2])
    out, step, mark = [], -(-len(order) // batches), 0
    for a in range(0, len(order) + 2 * step, step):
        part = order[a : a + step]
        if part:
            random.Random(a).shuffle(part)
            frame = pd.DataFrame(part, columns=["event_id", H._KEY, "us", "merchant_id"])
            processor.handleInputRows((0,), iter([frame[: step // 2], frame[step // 2 :]]), None)
        for at in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(at)
            out += processor.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), SimpleNamespace(getExpiryTimeInMs=lambda: at))  # noqa: B023
        mark = max(r[2] for r in part) // 1000 if part else (order[-1][2] + 3 * DAY) // 1000
    got = pd.concat(out).sort_values("event_id")
    last = [None if pd.isna(x) else int(x) for x in got[H._LAST_US]]
    return list(zip(got.event_id, last, got.known_merchants, got.day_count, strict=True)), handle


@pytest.mark.parametrize("run_rows, chunk_rows", [(1 << 16, 1 << 12), (40, 7), (1, 1)])
def test_a_bucket_gives_every_user_their_own_history(monkeypatch, run_rows, chunk_rows):
    monkeypatch.setattr(H, "RUN_ROWS", run_rows)
    monkeypatch.setattr(H, "CHUNK_ROWS", chunk_rows)
    rows = rows_of(9, 700)
    got, handle = play(rows, 6)
    assert got == by_hand(rows)
    assert not handle.states["waiting"].held and not handle.states["past"].held and not handle.timers  # only the last rows are kept


def test_calls_to_the_state_grow_with_batches_not_with_users_or_slices():
    """Every user and slice made some ten calls: 10,000 rows took a minute."""
    few, many = (len(play(rows_of(users, n), 4)[1].calls) for users, n in ((3, 300), (300, 3000)))
    assert many < 2 * few < 200
