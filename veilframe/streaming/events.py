"""Debouncing, gaps, replays, expiry and tracking over event streams.

Each has a batch form; the stateful ones share their step with the streaming form, keyed by ``key`` and fed in
event time.  Debounce windows open at the first event and aren't prolonged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

OUT = "key long, opened timestamp, events long, last timestamp"


def in_order(frame: DataFrame, key: str, order: Sequence[str], run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``run`` over Arrow batches in which each key's rows follow each other, by ``order``.

    A key may span many batches and tasks hold many keys: what ``run`` carries over is one key's state, so memory
    doesn't grow with a key's rows.  The sort spills where it has to.
    """
    return frame.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def runs_of(key: pa.Array) -> Iterator[tuple[int | None, int, int]]:
    """(key, start, end) of the runs of equal keys in a sorted batch."""
    at, n = 0, len(key)
    own = np.where(key.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, key.fill_null(0).to_numpy())
    for end in [*(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), n] if n else []:
        yield key[at].as_py(), at, end
        at = end


def debounce(events: DataFrame, window_ms: int, key: str = "key") -> DataFrame:
    """key, opened, events, last: a row per burst, batch form; events without a time are left out."""
    us = window_ms * 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open burst: key, opened, events, last
        for batch in batches:
            times, out = batch.column(1).to_numpy(), []
            for k, at, end in runs_of(batch.column(0)):
                if held is not None and held[0] != k:
                    out.append(held)
                    held = None
                while at < end:
                    if held is None:
                        held = (k, int(times[at]), 0, 0)
                    to = at + int(np.searchsorted(times[at:end], held[1] + us))
                    if to > at:
                        held = (*held[:2], held[2] + to - at, int(times[to - 1]))
                    if to < end:
                        out.append(held)
                        held = None
                    at = to
            yield _burst_rows(out)
        if held is not None:
            yield _burst_rows([held])

    own = events.where("ts is not null").select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    found = in_order(own, "key", ["at"], run, "key long, opened long, events long, last long")
    return found.select("key", F.timestamp_micros("opened").alias("opened"), "events", F.timestamp_micros("last").alias("last"))


def _burst_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["key", "opened", "events", "last"])


def debounce_stream(events: DataFrame, window_ms: int, key: str = "key", delay: str = "10 seconds") -> DataFrame:
    """The same over a stream: state is the open burst, which a timeout in event time closes."""

    def run(own, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us = window_ms * 1000
        held = state.getOption
        if state.hasTimedOut:
            opened, n, last = held
            state.remove()
            yield pd.DataFrame([(own[0], pd.Timestamp(opened, unit="us"), n, pd.Timestamp(last, unit="us"))], columns=["key", "opened", "events", "last"])
            return
        times = sorted(int(t.value // 1000) for f in frames for t in f["ts"])
        out = []
        for t in times:
            if held is None or t - held[0] >= us:
                if held is not None:
                    out.append((own[0], pd.Timestamp(held[0], unit="us"), held[1], pd.Timestamp(held[2], unit="us")))
                held = (t, 0, t)
            held = (held[0], held[1] + 1, t)
        state.update(held)
        state.setTimeoutTimestamp(max(held[0] // 1000 + window_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "opened", "events", "last"])

    return events.withWatermark("ts", delay).select(F.col(key).cast("long").alias("key"), "ts").groupBy("key").applyInPandasWithState(run, OUT, "opened long, n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, gap: str, key: str = "key") -> DataFrame:
    """key, opened, events: runs without a pause of ``gap``; works on batches and, with a watermark, on streams."""
    return events.groupBy(F.col(key).alias("key"), F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("key", F.col("w.start").alias("opened"), "events")


def sparse(events: DataFrame, least_ms: int, key: str = "key") -> DataFrame:
    """The events that come at least ``least_ms`` after the last one that was let through: openers of bursts."""
    return debounce(events, least_ms, key).select("key", F.col("opened").alias("ts"))


def scroll_steps(events: DataFrame, least: float = 32, key: str = "key") -> DataFrame:
    """key, event_id, y: scroll positions at least ``least`` away from the last accepted one; null positions aren't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for batch in batches:
            keep, ys = [], batch.column(3).to_pylist()
            for k, at, end in runs_of(batch.column(0)):
                if k != own:
                    own, last = k, None
                for i in range(at, end):
                    if ys[i] is not None and (last is None or abs(ys[i] - last) >= least):
                        keep.append(i)
                        last = ys[i]
            yield batch.select(["key", "event_id", "y"]).take(pa.array(keep, pa.int64()))

    own = events.select(F.col(key).cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), "ts", F.col("y").cast("double").alias("y"))
    return in_order(own, "key", ["ts", "event_id"], run, "key long, event_id long, y double")


def scroll_stops(events: DataFrame, least: float = 32, quiet_ms: int = 100, key: str = "key") -> DataFrame:
    """key, event_id, y, sent_at: accepted scroll positions that no other accepted one follows within ``quiet_ms``.

    Each accepted position starts the timer anew, so only the last of a run is sent, ``quiet_ms`` after it.
    """
    own = scroll_steps(events, least, key).join(events.select(F.col("event_id").cast("long").alias("event_id"), "ts"), "event_id")
    after = F.lead("ts").over(W.partitionBy("key").orderBy("ts", "event_id"))
    wait = F.expr(f"INTERVAL {int(quiet_ms)} MILLISECONDS")
    return own.withColumn("_next", after).where(F.col("_next").isNull() | (F.col("_next") >= F.col("ts") + wait)).select("key", "event_id", "y", (F.col("ts") + wait).alias("sent_at"))


def replays(uses: DataFrame, ticket: str, order: tuple[str, ...]) -> DataFrame:
    """With ``replayed``: any use of a ticket but the first."""
    return uses.withColumn("replayed", F.row_number().over(W.partitionBy(ticket).orderBy(*order)) > 1)


def first_uses_stream(uses: DataFrame, ticket: str, ts: str = "ts", ttl: str = "10 seconds") -> DataFrame:
    return uses.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([ticket])


def recent(events: DataFrame, value: str, key: str, order: tuple[str, ...], n: int = 5) -> DataFrame:
    """With ``recent``: the last ``n`` values of the key."""
    return events.withColumn("recent", F.collect_list(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)))


def match_tracks(tracks: list[tuple], found: list[tuple], next_id: int, least: float = 0.3) -> tuple[list[tuple], int]:
    """Tracks (id, age, x, y, w, h) of the next frame: each track takes the free box it overlaps most; others end."""
    from ..operators.spatial import _iou

    free, out = list(found), []
    for track in tracks:
        best = max(range(len(free)), key=lambda i: (_iou(track[2:], free[i]), -i), default=None)
        if best is not None and _iou(track[2:], free[best]) >= least:
            out.append((track[0], track[1] + 1, *free.pop(best)))
    for b in free:
        out.append((next_id, 1, *b))
        next_id += 1
    return out, next_id


def track(boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """tab, frame, track, age, x, y, w, h: boxes (tab, frame, ord, x, y, w, h) followed from frame to frame.

    Held are a tab's tracks and the boxes of its current frame, which a screen bounds, however long the tab lives.
    """
    names = ["tab", "frame", "track", "age", "x", "y", "w", "h"]
    kinds = [pa.int64()] * 4 + [pa.float64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, tracks, next_id = None, [], [], 1

        def close(rows: list[tuple]) -> None:
            nonlocal tracks, next_id
            tracks, next_id = match_tracks(tracks, found, next_id, least)
            rows += [(*at, *t) for t in tracks]

        for batch in batches:
            out: list[tuple] = []
            for tab, frame, _, *box in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (tab, frame):
                    if at is not None:
                        close(out)
                        if at[0] != tab:
                            tracks, next_id = [], 1
                    at, found = (tab, frame), []
                found.append(tuple(box))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        if at is not None:
            last: list[tuple] = []
            close(last)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in last], k) for i, k in enumerate(kinds)], names)

    own = boxes.select(*[F.col(c).cast("long").alias(c) for c in ("tab", "frame", "ord")], *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")])
    return in_order(own, "tab", ["frame", "ord"], run, ", ".join(f"{n} {'long' if i < 4 else 'double'}" for i, n in enumerate(names)))


def settled(actions: DataFrame, changes: DataFrame, debounce_ms: int = 150, most_ms: int = 2000) -> DataFrame:
    """action, settled_at: when a page has been still for ``debounce_ms`` after an action, or ``most_ms`` later.

    actions (key, action, at) and changes (key, at) in milliseconds.  A change after the page was still no longer
    counts.  Changes meet an action only within ``most_ms``, by buckets of that length, so no key is paired whole.
    """
    bucket = lambda c: F.floor(c / most_ms)
    own = actions.select("key", "action", F.col("at").alias("start")).withColumn("_b", F.explode(F.array(bucket(F.col("start")), bucket(F.col("start")) + 1)))
    near = own.join(changes.select("key", "at", bucket(F.col("at")).alias("_b")), ["key", "_b"]).where((F.col("at") > F.col("start")) & (F.col("at") < F.col("start") + most_ms))
    points = near.select("action", "start", "at").unionByName(actions.select("action", F.col("at").alias("start"), "at")).distinct()
    after = F.lead("at").over(W.partitionBy("action", "start").orderBy("at"))
    still = F.when(after.isNull() | (after - F.col("at") > debounce_ms), F.col("at") + debounce_ms)
    first = points.withColumn("_s", still).groupBy("action", "start").agg(F.min("_s").alias("_s"))
    return first.select("action", F.least("_s", F.col("start") + most_ms).alias("settled_at"))


def drained(events: DataFrame, drains: DataFrame) -> DataFrame:
    """key, event, drained_at: the first drain (key, at) not before an event (key, event, at); null while it waits.

    One ordered pass over both, so neither is paired with the other.
    """
    both = events.select("key", "at", "event", F.lit(None).cast("long").alias("d")).unionByName(drains.select("key", "at", F.lit(None).cast("long").alias("event"), F.col("at").alias("d")))
    nxt = F.first("d", ignorenulls=True).over(W.partitionBy("key").orderBy("at", F.col("d").isNotNull()).rowsBetween(W.currentRow, W.unboundedFollowing))
    return both.withColumn("drained_at", nxt).where("event is not null").select("key", "event", "drained_at")


def invalidated(cache: DataFrame, dirty: DataFrame, keys: list[str]) -> DataFrame:
    """The cached rows (keys, cached_at) that no mark (keys, at) made after them; the others must be read anew."""
    last = dirty.groupBy(*keys).agg(F.max("at").alias("_dirty"))
    return cache.join(last, keys, "left").where(F.col("_dirty").isNull() | (F.col("_dirty") <= F.col("cached_at"))).drop("_dirty")
