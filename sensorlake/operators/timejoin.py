"""Time-aligned joins without pairs: both sides are merged on the time axis and values are carried along.

Streams are cut into time buckets of `width` seconds, so one long recording is many tasks.  A bucket's
carry-in comes from a summary with one row per key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.functions.geo import angle_lerp, lerp
from sensorlake.operators import buckets


def _carry(left: DataFrame, right: DataFrame, key: str, ts: str, width: float, forward: bool) -> DataFrame:
    """left with column m: the right row (struct) last at or before ts, or first at or after it."""
    sign = -1.0 if forward else 1.0
    fields = [c for c in right.columns if c != key]
    rows = left.select(F.col(key), (F.col(ts) * sign).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))
    other = right.select(F.col(key), (F.col(ts) * sign).alias("__t"), F.lit(0).alias("__side"), F.struct(*fields).alias("__m"))
    both = rows.unionByName(other, allowMissingColumns=True).withColumn("__b", F.floor(F.col("__t") / width))
    last = both.where("__side = 0").groupBy(key, "__b").agg(F.max_by("__m", F.struct("__t", "__m")).alias("__last"))
    filled = both.where("__side = 1").select(key, "__b").distinct().join(last, [key, "__b"], "full")
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = filled.select(key, "__b", F.last("__last", ignorenulls=True).over(before).alias("__in"))
    inside = Window.partitionBy(key, "__b").orderBy("__t", "__side", "__m").rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("__own", F.last("__m", ignorenulls=True).over(inside)).where("__side = 1")
    return merged.join(carry, [key, "__b"], "left").select("__row.*", F.coalesce("__own", "__in").alias("m"))


def asof_backward(left: DataFrame, right: DataFrame, key: str, ts: str = "ts", width: float = 3600.0, tolerance: float | None = None) -> DataFrame:
    """left with struct m of the newest right row not after it; with a tolerance, null if that is too old."""
    out = _carry(left, right, key, ts, width, False)
    return out if tolerance is None else out.withColumn("m", F.when(F.col(ts) - F.col(f"m.{ts}") <= tolerance, F.col("m")))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, ts: str = "ts", width: float = 3600.0, tolerance: float | None = None) -> DataFrame:
    """left with struct m of the nearest right row; the earlier one on a tie, null beyond the tolerance."""
    back = _carry(left, right, key, ts, width, False).withColumnRenamed("m", "__back")
    both = _carry(back, right, key, ts, width, True)
    before, after = F.col(ts) - F.col(f"__back.{ts}"), F.col(f"m.{ts}") - F.col(ts)
    chosen = F.when(F.col("m").isNull() | (before <= after), F.coalesce(F.col("__back"), F.col("m"))).otherwise(F.col("m"))
    out = both.withColumn("m", chosen).drop("__back")
    return out if tolerance is None else out.withColumn("m", F.when(F.abs(F.col(ts) - F.col(f"m.{ts}")) <= tolerance, F.col("m")))


def sync_delta_ms(ts: Column, matched: Column) -> Column:
    return (matched - ts) * 1000.0


def pose_intervals(poses: DataFrame, key: str, ts: str = "ts", width: float = 3600.0) -> DataFrame:
    """poses with the values of the next pose under next_*; null at the end."""
    fields = [c for c in poses.columns if c != key]
    near = buckets.neighbours(poses, [key], [ts], fields, width, "__before", "__after")
    return near.select(*poses.columns, *[F.col(f"__after.{c}").alias(f"next_{c}") for c in fields])


def interpolate_poses(frames: DataFrame, poses: DataFrame, key: str, linear: list[str], angles: list[str], ts: str = "ts", width: float = 3600.0) -> DataFrame:
    """frames with the interpolated pose: linear values, and angles along the shorter arc (not wrapped).
    Before the first pose its values hold under the frame's time; after the last, its values under its own time."""
    spans = pose_intervals(poses, key, ts, width)
    first = poses.groupBy(key).agg(F.min_by(F.struct(*[ts, *linear, *angles]), ts).alias("__first"))
    joined = _carry(frames, spans, key, ts, width, False).join(first, key, "left")
    gap = F.col(f"m.next_{ts}") - F.col(f"m.{ts}")
    t = F.when(gap > 0, F.greatest(F.least((F.col(ts) - F.col(f"m.{ts}")) / gap, F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0))
    value = lambda c, f: F.when(F.col("m").isNull(), F.col(f"__first.{c}")).when(
        F.col(f"m.next_{ts}").isNull(), F.col(f"m.{c}")).otherwise(f(F.col(f"m.{c}"), F.col(f"m.next_{c}"), t))
    pose_ts = F.when(F.col("m").isNotNull() & F.col(f"m.next_{ts}").isNull(), F.col(f"m.{ts}")).otherwise(F.col(ts))
    return joined.select(*frames.columns, pose_ts.alias("pose_ts"), *[value(c, lerp).alias(c) for c in linear], *[value(c, angle_lerp).alias(c) for c in angles])


def band_join(left: DataFrame, wanted: DataFrame, ts: str = "ts", at: str = "at", width: float = 0.05) -> DataFrame:
    """Pairs of a left row and a wanted time closer than width: an equi-join on time cells and their neighbours."""
    cells = wanted.select(at, F.explode(F.sequence(F.floor(F.col(at) / width) - 1, F.floor(F.col(at) / width) + 1)).alias("__c"))
    keyed = left.withColumn("__c", F.floor(F.col(ts) / width))
    return keyed.join(cells, "__c").where(F.abs(F.col(ts) - F.col(at)) < width).drop("__c")
