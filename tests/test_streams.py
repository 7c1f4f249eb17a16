"""Streams that stop and go on: the same end as one pass; budgets and turns of windows."""

import os
import random

import pytest

from bidstream.plans import inventories
from bidstream.sources import windowed

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["retry_queue", "pages_confirmed"])
def test_a_stopped_stream_ends_as_one_pass(spark, monkeypatch, name):
    several = sorted(map(tuple, inventories.QUERIES[name](spark, DATA).collect()), key=repr)
    monkeypatch.setattr(inventories, "PARTS", 1)
    monkeypatch.setattr(inventories, "STOP", 1)
    assert sorted(map(tuple, inventories.QUERIES[name](spark, DATA).collect()), key=repr) == several and several


@pytest.mark.parametrize("seed", range(30))
def test_turns_admit_a_budget_and_lose_no_window(seed):
    rng = random.Random(seed)
    sizes = {lane: rng.randint(0, 9) for lane in "abc"}
    reserved, budget = {lane: rng.randint(0, 3) for lane in "ab"}, rng.randint(1, 6)
    at = dict.fromkeys(sizes, 0)
    while at != sizes:
        after = windowed.turns(at, sizes, reserved, budget)
        admitted = {lane: after[lane] - at[lane] for lane in sizes}
        assert sum(admitted.values()) == min(budget, sum(sizes.values()) - sum(at.values())) and min(admitted.values()) >= 0
        if sum(reserved.values()) <= budget:
            assert all(admitted[lane] >= min(n, sizes[lane] - at[lane]) for lane, n in reserved.items())
        at = after
    assert windowed.turns(at, sizes, reserved, budget) == at


def test_windows_cover_their_days_once():
    import json

    reader = windowed._Reader({"lanes": json.dumps({"a": {"first": "2026-01-01", "last": "2026-01-10"}, "b": {"first": "2026-02-01", "last": "2026-01-01"}}), "days": "4", "budget": "2"})
    first, then = reader.read(reader.initialOffset())
    assert [(str(a), str(b)) for _, _, a, b in first] == [("2026-01-01", "2026-01-04"), ("2026-01-05", "2026-01-08")] and then == {"a": 2, "b": 0}
    rest, end = reader.read(then)
    assert [(str(a), str(b)) for _, _, a, b in rest] == [("2026-01-09", "2026-01-10")] and reader.read(end) [1] == end
    assert list(reader.readBetweenOffsets(then, end)) == [next(reader._windows("a", 2, 3))]
