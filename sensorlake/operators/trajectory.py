"""Trajectory cleaning and summaries, on time buckets: one recording may be many tasks (see `buckets`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.config import MAX_GAP_S, MAX_SPIKE_SPEED
from sensorlake.operators import buckets


def _distance(values: list[str], other: list[Column]) -> Column:
    return F.sqrt(sum((F.col(v) - o) * (F.col(v) - o) for v, o in zip(values, other, strict=True)))


def step_speed(track: DataFrame, key: str, ts: str, values: list[str], order: list[str] | None = None, width: float = buckets.WIDTH) -> DataFrame:
    """Adds speed (from the previous row) and next_speed (to the next); null where time does not advance."""
    near = buckets.neighbours(track, [key], order or [ts], list(dict.fromkeys([ts, *values])), width, "__before", "__after")
    speed = lambda side, dt: F.when(dt > 0, _distance(values, [F.col(f"{side}.{v}") for v in values]) / dt)
    return near.withColumns({"speed": speed("__before", F.col(ts) - F.col(f"__before.{ts}")),
                             "next_speed": speed("__after", F.col(f"__after.{ts}") - F.col(ts))}).drop("__before", "__after")


def reject_spikes(track: DataFrame, key: str, ts: str, values: list[str], max_speed: float = MAX_SPIKE_SPEED, order: list[str] | None = None) -> DataFrame:
    """Drops rows that are too fast from their previous and to their next row; one pass on the input."""
    fast = step_speed(track, key, ts, values, order)
    both = (F.col("speed") > max_speed) & (F.col("next_speed") > max_speed)
    return fast.where(~F.coalesce(both, F.lit(False))).select(track.columns)


def spike_counts(track: DataFrame, key: str, ts: str, values: list[str], max_speed: float = MAX_SPIKE_SPEED) -> DataFrame:
    return step_speed(track, key, ts, values).groupBy(key).agg(F.count("*").alias("points"), F.count_if(F.col("speed") > max_speed).alias("spikes"))


def spike_report(track: DataFrame, key: str, ts: str, values: list[str], max_speed: float = MAX_SPIKE_SPEED, top: int = 8) -> DataFrame:
    """The first `top` spikes of each key in time order."""
    spikes = step_speed(track, key, ts, values).where(F.col("speed") > max_speed)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(ts))  # of a top-k report: Spark keeps the first rows of each task
    return spikes.withColumn("nth", nth).where(F.col("nth") <= top)


def bracketed(frames: DataFrame, key: str, ts: str, observed: Column, values: list[str], order: list[str], width: float = buckets.WIDTH) -> DataFrame:
    """frames with the last observation before and the next one after each row (structs before and after)."""
    return buckets.observations(frames, [key], order, observed, list(dict.fromkeys([ts, *values])), width)


def fill_gaps(frames: DataFrame, key: str, ts: str, observed: str, values: list[str], max_gap: float = MAX_GAP_S, order: list[str] | None = None) -> DataFrame:
    """Observed rows, and unobserved ones between two observations at most max_gap apart, with linear values and
    the flag interpolated; filled rows are never anchors."""
    b = bracketed(frames, key, ts, F.col(observed), values, order or [ts])
    gap = F.col(f"after.{ts}") - F.col(f"before.{ts}")
    share = F.when(gap > 0, (F.col(ts) - F.col(f"before.{ts}")) / gap).otherwise(F.lit(0.0))
    inner = ~F.col(observed) & (gap <= max_gap)
    linear = lambda v: F.col(f"before.{v}") + (F.col(f"after.{v}") - F.col(f"before.{v}")) * share
    return b.where(F.col(observed) | inner).select(
        *[F.when(F.col(observed), F.col(c)).otherwise(linear(c)).alias(c) if c in values else F.col(c) for c in frames.columns],
        (~F.col(observed)).alias("interpolated"))


def long_gaps(frames: DataFrame, key: str, ts: str, observed: str, max_gap: float = MAX_GAP_S, order: list[str] | None = None, width: float = buckets.WIDTH) -> DataFrame:
    """(key, start, stop, gap, missing) of the gaps that fill_gaps leaves open."""
    order = order or [ts]
    numbered = buckets.row_numbers(frames, [key], order[0], order, width, "__i").where(F.col(observed))
    near = buckets.neighbours(numbered, [key], order, [ts, "__i"], width)
    pairs = near.select(key, F.col(ts).alias("start"), F.col(f"after.{ts}").alias("stop"), (F.col("after.__i") - F.col("__i") - 1).alias("missing"))
    return pairs.where((F.col("missing") > 0) & (F.col("stop") - F.col("start") > max_gap)).withColumn("gap", F.col("stop") - F.col("start"))


def track_summary(track: DataFrame, key: str, ts: str, heading: str) -> DataFrame:
    return track.groupBy(key).agg(
        F.count("*").alias("points"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), (F.max(ts) - F.min(ts)).alias("duration"),
        F.min_by(heading, ts).alias("first_heading"), F.max_by(heading, ts).alias("last_heading"))


def elapsed(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Adds elapsed time since the key's first row: an aggregate joined back."""
    first = df.groupBy(key).agg(F.min(ts).alias("__first"))
    return df.join(first, key).withColumn("elapsed", F.col(ts) - F.col("__first")).drop("__first")


def frame_index(df: DataFrame, key: str, order: list[str], width: float = buckets.WIDTH) -> DataFrame:
    return buckets.row_numbers(df, [key], order[0], order, width, "frame_index").withColumn("frame_index", F.col("frame_index") - 1)


def downsample(track: DataFrame, key: str, order: list[str], most: int = 10_000) -> DataFrame:
    """Every k-th row of tracks longer than `most`, k = n div most."""
    n = track.groupBy(key).agg(F.count("*").alias("__n"))
    step = F.when(F.col("__n") > most, F.floor(F.col("__n") / most)).otherwise(F.lit(1))
    return frame_index(track, key, order).join(n, key).where(F.pmod("frame_index", step) == 0).select(track.columns)


def miss_streak(df: DataFrame, key: str, order: list[str], hit: str, width: float = buckets.WIDTH) -> DataFrame:
    """Adds streak: consecutive rows up to this one without a hit."""
    return buckets.streaks(df, [key], order, F.col(hit), width)


def velocity(df: DataFrame, key: str, ts: str, values: list[str], width: float = buckets.WIDTH) -> DataFrame:
    """Adds v_<value>: finite differences, zero where time barely advances."""
    near = buckets.neighbours(df, [key], [ts], list(dict.fromkeys([ts, *values])), width, "__before", "__after")
    dt = F.col(ts) - F.col(f"__before.{ts}")
    return near.select("*", *[F.when(dt > 1e-6, (F.col(v) - F.col(f"__before.{v}")) / dt).otherwise(F.lit(0.0)).alias(f"v_{v}") for v in values]).drop("__before", "__after")


def last_k(df: DataFrame, key: str, ts: str, value: str, k: int, width: float = buckets.WIDTH) -> DataFrame:
    """Adds history: the last k values, oldest first."""
    return buckets.histories(df, [key], [ts], value, k, width)


def world_csv_rows(world: DataFrame, ts: str = "utc_seconds") -> DataFrame:
    """Long (ts, group, lat, lon, height) to the fixed two-slot wide rows; groups from 2 on have no slot."""
    slot = lambda g, c: F.max(F.when(F.col("group_index") == g, F.col(c))).alias(f"target_{g}_{c}")
    return world.groupBy(ts).agg(*[slot(g, c) for g in (0, 1) for c in ("lat", "lon", "height")])
