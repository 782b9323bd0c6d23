"""Sorted streams with carried state against plain loops, with Arrow batches far smaller than a key's rows."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from veilframe.operators.spatial import _iou
from veilframe.streaming import events as M

START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _events(n, keys, seed):
    draw = random.Random(seed)
    return [(draw.choice(keys), i, START + timedelta(milliseconds=draw.randrange(20_000)), draw.choice([None, *map(float, range(0, 200, 10))])) for i in range(n)]


def test_debounce_by_loop(small_batches):
    rows = [*_events(400, [1, 1, 1, 2, None], 3), (5, 9000, None, 1.0)]
    want = []
    for key in (1, 2, None):
        opened = None
        for t in sorted(r[2] for r in rows if r[0] == key and r[2]):
            if opened is None or t - opened >= timedelta(milliseconds=300):
                want.append([key, t, 0, t])
                opened = t
            want[-1][2:] = [want[-1][2] + 1, t]
    frame = small_batches.createDataFrame(rows, "key long, event_id long, ts timestamp, y double")
    got = M.debounce(frame, 300).collect()
    assert sorted((str(r.key), r.opened.timestamp(), r.events, r["last"].timestamp()) for r in got) == sorted((str(k), a.timestamp(), n, b.timestamp()) for k, a, n, b in want)
    assert M.debounce(frame.limit(0), 300).collect() == []


def test_scroll_steps_and_stops_by_loop(small_batches):
    rows = _events(300, [1, 1, 1, 2], 4)
    steps, stops = [], []
    for key in (1, 2):
        last, own = None, []
        for _, i, t, y in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if y is not None and (last is None or abs(y - last) >= 32):
                own.append((i, t))
                last = y
        steps += [i for i, _ in own]
        stops += [i for n, (i, t) in enumerate(own) if n + 1 == len(own) or own[n + 1][1] - t >= timedelta(milliseconds=100)]
    frame = small_batches.createDataFrame(rows, "key long, event_id long, ts timestamp, y double")
    assert sorted(r.event_id for r in M.scroll_steps(frame).collect()) == sorted(steps)
    got = M.scroll_stops(frame).collect()
    assert sorted(r.event_id for r in got) == sorted(stops) and 0 < len(stops) < len(steps)


def test_tracks_by_loop(small_batches):
    draw = random.Random(5)
    boxes = [(tab, f, o, float(draw.randrange(60)), float(draw.randrange(60)), 40.0, 40.0) for tab in (1, 2, 3) for f in range(12) for o in range(draw.randrange(1, 5))]
    want = []
    for tab in (1, 2, 3):
        tracks, fresh = [], 1
        for f in range(12):
            free, now = [b[3:] for b in boxes if b[:2] == (tab, f)], []
            for name, age, *old in tracks:
                scores = [_iou(old, b) for b in free]
                if scores and max(scores) >= 0.3:
                    now.append((name, age + 1, *free.pop(scores.index(max(scores)))))
            for b in free:
                now.append((fresh, 1, *b))
                fresh += 1
            tracks = now
            want += [(tab, f, *t) for t in tracks]
    frame = small_batches.createDataFrame(boxes, "tab long, frame long, ord long, x double, y double, w double, h double")
    assert sorted(map(tuple, M.track(frame).collect())) == sorted(want)
