"""Stateful trackers as pure step functions, folded over a recording in time order.

The same step functions run in batch (one recording per group) and in Structured Streaming
(sensorlake.streaming.trackers), so both give the same states.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from math import hypot, sqrt
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sensorlake.config import Tracker

Point = tuple[float, float, float]
NAN = float("nan")


@dataclass
class State:
    ts: float
    pos: Point
    vel: Point = (0.0, 0.0, 0.0)
    source: str = "observed"


def moved(s: State, dt: float) -> Point:
    (x, y, z), (u, v, w) = s.pos, s.vel  # written out, as it runs for every frame
    return x + u * dt, y + v * dt, z + w * dt


def filtered(s: State, start: Point, measured: Point, ts: float, gain: float) -> State:
    """Blend of a predicted and a measured position; the velocity follows from the positions."""
    dt = max(ts - s.ts, 1e-3)
    (a, b, c), (u, v, w), (x, y, z) = start, measured, s.pos
    pos = a + gain * (u - a), b + gain * (v - b), c + gain * (w - c)
    return State(ts, pos, ((pos[0] - x) / dt, (pos[1] - y) / dt, (pos[2] - z) / dt))


@dataclass
class Single:
    """Alpha filter on one target with a lifecycle and a running quality."""

    cfg: Tracker = Tracker()
    state: State | None = None
    observed_ts: float | None = None
    quality: float = 0.0
    lifecycle: str = "tentative"
    hits: int = 0
    misses: int = 0

    def predicted(self, ts: float) -> State | None:
        if not self.cfg.allow_prediction or self.state is None or self.observed_ts is None:
            return None
        since, seen = ts - self.state.ts, ts - self.observed_ts
        if since < 0 or seen < 0 or seen > self.cfg.max_prediction_s:
            return None
        return State(ts, moved(self.state, since), self.state.vel, "predicted")

    def step(self, ts: float, candidates: list[tuple[Point, float]]) -> State | None:
        """candidates: (footpoint, score) in id order.  Without a prediction the best score wins ungated;
        with one, the candidate nearest in space if it lies within the gate."""
        ahead, chosen = self.predicted(ts), None
        if candidates and ahead is None:
            chosen = max(candidates, key=lambda c: c[1])[0]
        elif candidates:
            x, y, z = ahead.pos
            gap = lambda p: sqrt(sum(((p[0] - x) ** 2, (p[1] - y) ** 2, (p[2] - z) ** 2)))
            nearest = min((c[0] for c in candidates), key=gap)
            chosen = nearest if gap(nearest) <= self.cfg.gate else None
        if chosen is None:
            self.hits, self.misses = 0, self.misses + 1
            self.quality *= self.cfg.quality_decay
            if self.misses >= self.cfg.forget_misses:
                self.lifecycle, self.quality = "lost", 0.0
            self.state = ahead
            return ahead
        self.hits, self.misses = self.hits + 1, 0
        self.quality += self.cfg.quality_gain * (1.0 - self.quality)
        if self.hits >= self.cfg.confirm_hits:
            self.lifecycle = "confirmed"
        elif self.lifecycle == "lost":
            self.lifecycle = "tentative"
        old = self.state
        self.state = State(ts, chosen) if old is None else filtered(old, moved(old, max(ts - old.ts, 1e-3)), chosen, ts, self.cfg.gain)
        self.observed_ts = ts
        return self.state


@dataclass
class Track:
    state: State
    hits: int = 1
    misses: int = 0


@dataclass
class Multi:
    """Many targets: predict, gate in the plane, match greedily, update, miss and evict, spawn."""

    cfg: Tracker = Tracker()
    tracks: dict[int, Track] = field(default_factory=dict)
    next_id: int = 1

    def ahead(self, t: Track, ts: float) -> State | None:
        dt = ts - t.state.ts
        if dt < 0 or dt > self.cfg.max_prediction_s:
            return None
        return t.state if dt == 0 else State(ts, moved(t.state, dt), t.state.vel, "predicted")

    def step(self, ts: float, feet: list[Point]) -> list[tuple[int, Track]]:
        known = sorted(self.tracks)
        ahead = {i: self.ahead(self.tracks[i], ts) for i in known}
        pairs = sorted((hypot(p[0] - ahead[i].pos[0], p[1] - ahead[i].pos[1]), c, i)
                       for c, p in enumerate(feet) for i in known if ahead[i] is not None)
        matched: dict[int, int] = {}
        for d, c, i in pairs:
            if d <= self.cfg.gate and i not in matched and c not in matched.values():
                matched[i] = c
        for i in known:
            t = self.tracks[i]
            if i in matched:
                t.state = filtered(t.state, ahead[i].pos, feet[matched[i]], ts, self.cfg.gain)
                t.hits, t.misses = t.hits + 1, 0
                continue
            t.misses += 1
            if ahead[i] is not None and self.cfg.allow_prediction:
                t.state = ahead[i]
            if t.misses > self.cfg.forget_misses:
                del self.tracks[i]
        for c, p in enumerate(feet):
            if c not in matched.values():
                self.tracks[self.next_id] = Track(State(ts, p))
                self.next_id += 1
        return [(i, t) for i, t in sorted(self.tracks.items()) if t.hits >= self.cfg.confirm_hits]

    def quality(self, t: Track) -> float:
        return t.hits / max(t.hits + t.misses, 1)


SINGLE_SCHEMA = "ts double, x double, y double, z double, vx double, vy double, vz double, source string, quality double, lifecycle string"
MULTI_SCHEMA = ("ts double, track_id int, x double, y double, z double, vx double, vy double, vz double, source string, "
                "quality double, lifecycle string, hits int, misses int")


def frames(rows: Iterable[tuple]) -> Iterator[tuple[float, list[tuple[Point, float]]]]:
    """(ts, candidates as (footpoint, score)) of one recording's rows (ts, x, y, z, score) in order; x NaN: no candidate."""
    for ts, of_frame in groupby(rows, itemgetter(0)):
        yield ts, [((x, y, z), score) for _, x, y, z, score in of_frame if x == x]


def single_rows(tracker: Single, rows: Iterable[tuple]) -> Iterator[tuple]:
    """rows(ts, x, y, z, score; x NaN: a frame without candidates) in order of time and id, folded."""
    for ts, found in frames(rows):
        s = tracker.step(ts, found)
        yield (ts, *(s.pos + s.vel + (s.source,) if s else (None,) * 7), tracker.quality, tracker.lifecycle)


def multi_rows(tracker: Multi, rows: Iterable[tuple]) -> Iterator[tuple]:
    for ts, found in frames(rows):
        for i, t in tracker.step(ts, [p for p, _ in found]):
            yield (ts, i, *t.state.pos, *t.state.vel, t.state.source, tracker.quality(t), "confirmed", t.hits, t.misses)


def _folded(candidates: DataFrame, key: str, schema: str, fold) -> DataFrame:
    """fold(rows of one recording) over every recording: a task streams its sorted recordings one after the other and
    holds one frame and one tracker."""
    out_schema = f"{key} {candidates.schema[key].dataType.simpleString()}, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(out_schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            keys = [k if k == k else NAN for k in batch.column(0).to_pylist()]  # one object, so that they are one recording
            yield from zip(keys, *(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns[1:6]), strict=True)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=f.name != key) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for value, recording in groupby(rows(batches), itemgetter(0)):
            for row in fold(r[1:] for r in recording):
                out.append((value, *row))
                if len(out) == 10_000:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    known = candidates if "score" in candidates.columns else candidates.withColumn("score", F.lit(NAN))  # many targets need none
    numbers = [F.col(c).cast("double").alias(c) for c in ("ts", "x", "y", "z", "score")]
    ready = known.select(key, *numbers, "candidate_id").where("ts IS NOT NULL AND NOT isnan(ts)")
    dealt = ready.repartition(key).sortWithinPartitions(key, "ts", F.asc_nulls_last("candidate_id"))
    return dealt.mapInArrow(run, out_schema)


def track_single(candidates: DataFrame, key: str, cfg: Tracker = Tracker()) -> DataFrame:
    """A tracker state per key and frame of candidates(key, ts, candidate_id, x, y, z, score).  A recording is
    one key: its frames depend on each other, so it is folded in one task; recordings run side by side."""
    return _folded(candidates, key, SINGLE_SCHEMA, lambda rows: single_rows(Single(cfg), rows))


def track_multi(candidates: DataFrame, key: str, cfg: Tracker = Tracker()) -> DataFrame:
    """The confirmed tracks per key and frame; ids start at 1 in every recording."""
    return _folded(candidates, key, MULTI_SCHEMA, lambda rows: multi_rows(Multi(cfg), rows))


def alpha_fold(samples: Column, gain: float) -> Column:
    """The filter on one scalar as a fold over an array of structs (ts, v), in order: struct of p and u."""
    zero = F.struct(F.lit(None).cast("double").alias("t"), F.lit(0.0).alias("p"), F.lit(0.0).alias("u"))

    def step(s: Column, m: Column) -> Column:
        dt = F.greatest(m["ts"] - s["t"], F.lit(1e-3))
        start = s["p"] + s["u"] * dt
        blend = start + gain * (m["v"] - start)
        p = F.when(s["t"].isNull(), m["v"]).otherwise(blend)
        u = F.when(s["t"].isNull(), F.lit(0.0)).otherwise((blend - s["p"]) / dt)
        return F.struct(m["ts"].alias("t"), p.alias("p"), u.alias("u"))

    return F.aggregate(samples, zero, step)


def weighted_pick(pairs: DataFrame, frame: str, cfg: Tracker = Tracker(), gate: float = 1.5) -> DataFrame:
    """The candidate with the best mixture of marker likelihood, motion likelihood and score, if it is good enough.
    pairs: distance to the marker, residual to the expected position (null: none), score, candidate_id."""
    from pyspark.sql.window import Window

    marker = F.exp(-0.5 * F.pow(F.col("distance") / cfg.marker_sigma, F.lit(2.0)))
    motion = F.coalesce(F.exp(-0.5 * F.pow(F.col("residual") / cfg.motion_sigma, F.lit(2.0))), F.lit(1.0))
    rated = pairs.where(F.col("distance") <= gate * cfg.hard_gate).withColumn("combined", 0.55 * marker + 0.25 * motion + 0.20 * F.col("score"))
    nth = F.row_number().over(Window.partitionBy(frame).orderBy(F.desc("combined"), "candidate_id"))
    return rated.withColumn("__n", nth).where((F.col("__n") == 1) & (F.col("combined") >= cfg.min_combined)).drop("__n")


@dataclass
class Marker:
    """A marker's observed positions with a bounded history and an optional constant-velocity prediction."""

    size: int = 10
    allow_prediction: bool = False
    max_prediction_s: float = 1.0
    history: list[tuple[float, Point]] = field(default_factory=list)

    def observe(self, ts: float, pos: Point) -> State:
        self.history = [*self.history, (ts, pos)][-self.size:]
        return State(ts, pos)

    def predict(self, ts: float) -> State | None:
        if not self.allow_prediction or not self.history or ts - self.history[-1][0] > self.max_prediction_s:
            return None
        last_ts, last = self.history[-1]
        vel = (0.0, 0.0, 0.0)
        if len(self.history) > 1 and last_ts - self.history[-2][0] > 1e-6:
            before_ts, before = self.history[-2]
            vel = tuple((a - b) / (last_ts - before_ts) for a, b in zip(last, before, strict=True))
        return State(ts, tuple(p + v * (ts - last_ts) for p, v in zip(last, vel, strict=True)), vel, "predicted")
