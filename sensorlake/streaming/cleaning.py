"""The trajectory's cleaning over a stream: spikes and gaps are decided when the observations after them have come."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import hypot

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from sensorlake.config import MAX_GAP_S, MAX_SPIKE_SPEED
from sensorlake.streaming.asof import OPTIONS, PARTS, call_again, in_parts, use_rocksdb

OUT = "at long, e double, n double, u double, interpolated boolean"


class Track:
    """The open end of one track.

    newest: the last observation, not decided before the next one or the track's end; before: the observation before it,
    kept or not; kept: the last one that stays; waiting: times of frames without an observation since `kept`, as far as a
    gap of max_gap may still fill them.  All observations are (time in microseconds, e, n, u).
    """

    def __init__(self, max_speed: float, max_gap: float, state: dict | None = None):
        self.max_speed, self.max_gap = max_speed, max_gap
        state = state or {}
        self.before, self.newest, self.kept = (state.get(k) for k in ("before", "newest", "kept"))
        self.waiting: list[int] = state.get("waiting", [])

    def state(self) -> dict:
        return {"before": self.before, "newest": self.newest, "kept": self.kept, "waiting": self.waiting}

    def _fast(self, a: list | None, b: list | None) -> bool:
        """Whether the step from a to b is faster than allowed; no step where one is missing or time does not advance."""
        return a is not None and b is not None and b[0] > a[0] and hypot(b[1] - a[1], b[2] - a[2]) / (b[0] / 1e6 - a[0] / 1e6) > self.max_speed

    def frame(self, at: int, place: list | None) -> Iterator[tuple]:
        """Takes the next frame in time order, with its observation or None; gives the rows that are certain by it."""
        if place is None:
            self.waiting.append(at)
        else:
            yield from self._decide([at, *place])
            self.before, self.newest = self.newest, [at, *place]
        span, own = self.max_gap * 1e6, None if self.newest is None else self.newest[0]
        after_kept = lambda t: self.kept is not None and t <= self.kept[0] + span
        after_own = own is not None and at <= own + span
        # what no later observation can fill any more is dropped
        self.waiting = [t for t in self.waiting if (after_kept(at if own is None else own) if own is None or t < own else after_own or after_kept(at))]

    def _decide(self, following: list | None) -> Iterator[tuple]:
        one = self.newest
        if one is None:
            return
        if self._fast(self.before, one) and self._fast(one, following):
            self.waiting = sorted([*self.waiting, one[0]])
            return
        if self.kept is not None and (gap := one[0] / 1e6 - self.kept[0] / 1e6) <= self.max_gap:
            for t in self.waiting:
                if t < one[0]:
                    share = (t / 1e6 - self.kept[0] / 1e6) / gap
                    yield (t, *[a + (b - a) * share for a, b in zip(self.kept[1:], one[1:], strict=True)], True)
        yield (*one, False)
        self.kept, self.waiting = one, [t for t in self.waiting if t > one[0]]

    def end(self) -> Iterator[tuple]:
        """The last observation has none after it and stays."""
        yield from self._decide(None)
        self.before, self.newest, self.waiting = self.newest or self.before, None, []


def cleaned_until(passed: int, track: Track, last: int | None, early: list[tuple], idle: float) -> tuple[list[tuple], int | None, list[tuple]]:
    """Takes the waiting frames (at, e, n, u) of one key that the watermark has passed: the rows that are certain by them, the
    time of the last frame taken, and the frames that wait on."""
    early, out, taken = sorted(early, key=lambda r: (r[0], r[1] is None)), [], 0
    for at, *place in early:
        if at > passed:
            break
        if last is not None and at - last > idle * 1e6:
            out += track.end()
        out += track.frame(at, None if None in place else place)
        last, taken = at, taken + 1
    if last is not None and passed - last > idle * 1e6:
        out += track.end()
    return out, last, early[taken:]


def cleaned_stream(frames: DataFrame, key: str, ts: str, delay: str, max_speed: float = MAX_SPIKE_SPEED, max_gap: float = MAX_GAP_S,
                   idle: float = 60.0, parts: int = PARTS) -> DataFrame:
    """(key, ts, e, n, u, interpolated) of a stream of frames(key, ts, e, n, u), whose places are null where nothing was observed:
    the observations without spikes, and the frames in gaps of at most max_gap seconds with places in between.

    Frames are taken in time order as the watermark, `delay` behind the newest, passes them.  A row is certain and comes
    out with the next observation, or when no frame follows for `idle` seconds of event time (more than max_gap), which
    ends a track: its last observation stays.  The state of a key is what is newer than the watermark and what one open gap
    holds; keys are dealt to `parts`, and a batch makes at most a call for each part.  Frames of a key have different times; those with a null time never come out.
    """
    if idle <= max_gap:
        raise ValueError("a track ends later than a gap closes")
    use_rocksdb(frames.sparkSession)
    places = [F.col(c).cast("double").alias(c) for c in ("e", "n", "u")]
    rows = frames.select(F.col(key).alias("key"), F.col(ts).alias("event_time"), F.unix_micros(ts).alias("at"), *places).where("at IS NOT NULL").withWatermark("event_time", delay)
    names, held_key = ["key", *(c.split()[0] for c in OUT.split(", "))], StructType([StructField("key", frames.schema[key].dataType)])

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks, done, timers = pickle.loads(state.get[0]) if state.exists else {}, [], []
        for came in () if state.hasTimedOut else batches:
            places = ([None if v != v else v for v in came[c].tolist()] for c in ("e", "n", "u"))
            for k, *frame in zip(came["key"].tolist(), came["at"].tolist(), *places, strict=True):
                tracks.setdefault(k, ([], None, None))[0].append(tuple(frame))
        passed = state.getCurrentWatermarkMs() * 1000
        for k, (early, last, held) in tracks.items():
            track = Track(max_speed, max_gap, held)
            certain, last, early = cleaned_until(passed, track, last, early, idle)
            done += [(k, *r) for r in certain]
            tracks[k] = early, last, track.state()
            timers += [early[0][0]] if early else []
            timers += [int(last + idle * 1e6) + 1] if last is not None and passed - last <= idle * 1e6 else []
        state.update((pickle.dumps(tracks),))
        if timers:
            call_again(state, min(timers))
        if done:
            yield pd.DataFrame(dict(zip(names, zip(*done, strict=True), strict=True)))

    out = in_parts(rows, parts).groupBy("part").applyInPandasWithState(step, f"key string, {OUT}", "tracks binary", "append", GroupStateTimeout.EventTimeTimeout)
    out = out.withColumn("key", F.from_json("key", held_key, OPTIONS)["key"])
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts), "e", "n", "u", "interpolated")
