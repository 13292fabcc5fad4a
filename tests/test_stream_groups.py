"""The state of a group of listings: a few calls for all of them, and the same rows as one after the other."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from test_streams import START, hour, model, row

from pricewatch_spark.streaming.changes import ListingStates


class Handle:
    """State in memory that counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.states = 0, set(), {}

    def _state(self, name, schema):
        state = self.states[name] = {"v": None}

        def call(f):
            def counted(*a):
                self.calls += 1
                return f(*a)

            return counted

        put = lambda v: state.update(v=v)
        return SimpleNamespace(
            exists=call(lambda: state["v"] is not None), get=call(lambda: state["v"]), clear=call(lambda: put(None)),
            update=call(put), put=call(put), appendList=call(lambda v: put([*(state["v"] or []), *v])),
        )

    getValueState = getListState = _state

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def micros(at):
    return round((at - START).total_seconds() * 1e6) + 1_000_000_000


def played(rows, batches, **options):
    """What a group emits when its rows come in batches, each followed by a watermark an hour behind the last row."""
    handle = Handle()
    states = ListingStates(options["silent"] * 3_600_000_000, options.get("forget") and options["forget"] * 3_600_000_000, options.get("revive", True))
    states.init(handle)
    frames, most, size = [], None, -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        part = [r for r in rows[k : k + size] if r[2] is not None]
        frame = pd.DataFrame([("a", r[1], micros(r[2]), f"{r[3]:020d}", r[4], r[5], r[6], not r[7].strip() or r[8] < 0) for r in part], columns=["source_id", "source_external_id", "at", "pos", "hash", "price", "availability", "failed"])
        frames += states.handleInputRows((0,), iter([frame]), None)
        most = max(int(frame["at"].max()), most or 0)
        mark = (most - 3_600_000_000) // 1000
        for at in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(at)
            frames += states.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), None)
    out = pd.concat(frames)
    return sorted(zip(out["source_external_id"], out["at"], out["change"], strict=True)), handle.calls


@pytest.mark.parametrize("batches", [1, 4])
@pytest.mark.parametrize("options", [{}, {"revive": False}, {"forget": 12}, {"forget": 5, "revive": False}])
def test_a_group_equals_one_row_after_the_other(batches, options):
    r = random.Random(11)
    times = sorted(round(r.uniform(0, 400), 1) for _ in range(1200))  # many equal times
    rows = [row(f"k{r.randrange(40)}", t, k, r.choice(["h1", "h2"]), " " if k % 17 == 0 else "t", -1 if k % 19 == 0 else 1) for k, t in enumerate(times)]
    rows.append(row("last", 500, 1200, "h1"))
    got, _ = played(rows, batches, silent=24, **options)
    expected = model(rows, 24, **options)
    assert got == sorted((key, micros(at), change) for key, at, change in expected)
    assert {"created", "changed", "delisted", "failed"} == {x[2] for x in got}


def test_the_calls_do_not_grow_with_the_listings():
    assert hour(0) == START
    rows = [row(f"k{k}", k % 50, k, "h1") for k in range(5000)] + [row("last", 90, 5000, "h1")]
    got, calls = played(rows, 1, silent=24)
    assert sum(x[2] == "created" for x in got) == 5000 and sum(x[2] == "delisted" for x in got) == 5000
    assert calls < 30
