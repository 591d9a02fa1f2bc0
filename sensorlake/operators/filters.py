"""Predicates on points, candidates, groups and frames; all are column expressions that Catalyst can push."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.config import EgoBox, LocalRoi, Motion, Person, Roi
from sensorlake.functions.geo import norm2
from sensorlake.operators.quantiles import quantiles

Range = tuple[float, float]


def in_box(**ranges: Range | None) -> Column:
    """Inclusive ranges by column name; None leaves an axis free."""
    out = F.lit(True)
    for name, limits in ranges.items():
        out = out if limits is None else out & F.col(name).between(*limits)
    return out


def roi_box(points: DataFrame, roi: Roi) -> DataFrame:
    return points.where(in_box(x=roi.x, y=roi.y, z=roi.z))


def roi_annulus(points: DataFrame, roi: Roi = Roi()) -> DataFrame:
    r = norm2(F.col("x") - roi.center[0], F.col("y") - roi.center[1])
    return points.where((r >= roi.min_radius) & (r <= roi.radius) & in_box(x=roi.x, y=roi.y, z=roi.z))


def region_of_interest(points: DataFrame, shape: str, roi: Roi = Roi()) -> DataFrame:
    if shape not in ("box", "circle"):
        raise ValueError(f"unknown region shape: {shape}")
    return roi_box(points, roi) if shape == "box" else roi_annulus(points, roi)


def without_ego(points: DataFrame, ego: EgoBox) -> DataFrame:
    return points.where(~in_box(x=ego.x, y=ego.y, z=ego.z)) if ego.enabled else points


def z_gate(points: DataFrame, low: float = float("-inf"), high: float = float("inf")) -> DataFrame:
    return points.where(F.col("z").between(low, high))


def protected(points: DataFrame, regions: DataFrame, size: float = 1.0) -> DataFrame:
    """Points inside any of the cylinders regions(x, y, z?, radius_m, z_margin_m).

    An equi-join on grid cells: every cylinder is listed in all cells that its square covers (a little more, so
    that rounding loses none), every point looks into its own, so no point is returned twice.
    """
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in ("x", "y", "z", "radius_m", "z_margin_m")]).distinct()
    radius = F.greatest(F.col("r_radius_m"), F.lit(1e-3))
    for axis in ("x", "y"):
        centre = F.col(f"r_{axis}")
        reach = radius * (1 + 1e-6) + F.abs(centre) * 1e-12
        r = r.withColumn(f"r_g{axis}", F.explode(F.sequence(_cell(centre - reach, size), _cell(centre + reach, size))))
    dx, dy = F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y")
    below = F.col("r_z").isNull() | (F.col("z") <= F.col("r_z") + F.col("r_z_margin_m"))
    same = (_cell(F.col("x"), size) == F.col("r_gx")) & (_cell(F.col("y"), size) == F.col("r_gy"))
    return points.join(r, same & (dx * dx + dy * dy <= radius * radius) & below, "left_semi")


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def width(sx: str = "size_x", sy: str = "size_y") -> Column:
    return F.greatest(sx, sy)


def depth(sx: str = "size_x", sy: str = "size_y") -> Column:
    return F.least(sx, sy)


def person_like(p: Person = Person()) -> Column:
    return ((F.col("point_count") >= p.min_points) & F.col("size_z").between(*p.height)
            & width().between(*p.width) & depth().between(*p.depth))


def person_filter_or_largest(candidates: DataFrame, frame: str, p: Person) -> DataFrame:
    """Person-like candidates; a frame without any keeps its largest cluster if that has enough points."""
    w = Window.partitionBy(frame)
    marked = candidates.withColumn("__ok", person_like(p)).withColumn("__any", F.max("__ok").over(w))
    nth = F.row_number().over(w.orderBy(F.desc("point_count"), "cluster_id"))
    fallback = ~F.col("__any") & (F.col("__nth") == 1) & (F.col("point_count") >= max(p.min_points, 3))
    return marked.withColumn("__nth", nth).where(F.col("__ok") | fallback).drop("__ok", "__any", "__nth")


def local_roi(points: DataFrame, centers: DataFrame, frame: str, roi: LocalRoi = LocalRoi(), reconnects: int = 0) -> DataFrame:
    """Points near any center of their frame; a frame whose crop is too sparse, or without centers, keeps all."""
    wide = reconnects >= roi.expand_after
    hx, hy, (lo, hi) = ((roi.expanded_half_x, roi.expanded_half_y, roi.expanded_z_offsets) if wide
                        else (roi.half_x, roi.half_y, roi.z_offsets))
    c = centers.select(F.col(frame).alias("__f"), *[F.col(v).alias(f"__{v}") for v in "xyz"])
    per_frame = c.groupBy("__f").agg(F.collect_list(F.struct("__x", "__y", "__z")).alias("__c"))  # a few per frame
    near = F.exists("__c", lambda q: F.col("x").between(q["__x"] - hx, q["__x"] + hx) & F.col("y").between(q["__y"] - hy, q["__y"] + hy)
                    & F.col("z").between(q["__z"] + lo, q["__z"] + hi))
    joined = points.join(per_frame, F.col(frame) == F.col("__f"), "left").withColumn("__near", F.coalesce(near, F.lit(True)))
    left = joined.groupBy(F.col(frame).alias("__g")).agg(F.count_if("__near").alias("__n"))
    return joined.join(left, F.col(frame) == F.col("__g")).where(
        F.col("__near") | (F.col("__n") < roi.min_points)).select(points.columns)


def crop_around(points: DataFrame, states: DataFrame, frame: str, half_width: float = 2.5, half_height: float = 2.5) -> DataFrame:
    """Points in the inclusive box around their frame's state(frame, x, y); a frame without a state keeps all of them."""
    s = states.select(F.col(frame).alias("__f"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    near = F.col("x").between(F.col("__x") - half_width, F.col("__x") + half_width) & F.col("y").between(F.col("__y") - half_height, F.col("__y") + half_height)
    return points.join(s, F.col(frame) == F.col("__f"), "left").where(F.col("__x").isNull() | near).select(points.columns)


def motion_limits(m: Motion, has_marker: Column, reconnects: Column, rescue: Column) -> dict[str, Column]:
    """Thresholds after the overrides: base, with marker, reconnecting, rescue."""
    late = has_marker & (reconnects >= m.reconnect_after)
    resolve = lambda base, i: F.when(late, F.lit(m.reconnect[i])).when(has_marker, F.lit(m.with_marker[i])).otherwise(F.lit(base))
    saved = rescue & has_marker
    base = F.lit(m.max_marker_distance) if m.max_marker_distance is not None else F.lit(None).cast("double")
    return {
        "max_foot_z": F.when(saved, F.lit(m.rescue[0])).otherwise(resolve(m.max_foot_z, 0)),
        "max_planar_jump": F.when(saved, F.lit(m.rescue[1])).otherwise(resolve(m.max_planar_jump, 1)),
        "max_planar_speed": resolve(m.max_planar_speed, 2),
        "max_marker_distance": F.when(saved, F.lit(m.rescue[2])).otherwise(base),
    }


def motion_reject_reason(foot, last, dt: Column, marker_distance: Column, m: Motion = Motion(), limits: dict[str, Column] | None = None) -> Column:
    """The first rule that a candidate fails, or null.  foot and last: x, y, z columns (last null: no state);
    marker_distance null: no marker."""
    limits = limits or {"max_foot_z": F.lit(m.max_foot_z), "max_planar_jump": F.lit(m.max_planar_jump),
                        "max_planar_speed": F.lit(m.max_planar_speed), "max_marker_distance": F.lit(m.max_marker_distance).cast("double")}
    near = F.coalesce(marker_distance <= m.near_marker, F.lit(False))
    pick = lambda close, name: F.when(near, F.lit(close)).otherwise(limits[name])
    foot_z, jump, speed = pick(m.near_foot_z, "max_foot_z"), pick(m.near_planar_jump, "max_planar_jump"), pick(m.near_planar_speed, "max_planar_speed")
    planar, vertical = norm2(foot[0] - last[0], foot[1] - last[1]), F.abs(foot[2] - last[2])
    said = lambda name, limit: F.format_string(f"{name}>%.2f", limit)
    moving = F.when(dt > 1e-3, dt)
    return (F.when(marker_distance > limits["max_marker_distance"], said("aruco_distance", limits["max_marker_distance"]))
            .when(foot[2] > foot_z, said("footpoint_z", foot_z))
            .when(last[0].isNull(), F.lit(None))
            .when(dt < 0, F.lit("negative_dt"))
            .when(planar > jump, said("planar_jump", jump))
            .when(vertical > m.max_vertical_jump, said("vertical_jump", F.lit(m.max_vertical_jump)))
            .when(planar / moving > speed, said("planar_speed", speed))
            .when(vertical / moving > m.max_vertical_speed, said("vertical_speed", F.lit(m.max_vertical_speed))))


def allowed(reason: Column) -> Column:
    """Whether a motion passes: no reason speaks against it."""
    return reason.isNull()


def outliers_removed(points: DataFrame, group: str, sigmas: float = 2.0) -> DataFrame:
    """Drops points further than `sigmas` population deviations of the distance from the group's median point;
    groups of fewer than four points, or without spread, stay whole.  The statistics are aggregates joined
    back, medians of large groups are refined (see `quantiles`), so no group is held in one task."""
    center = quantiles(points, [group], {f"__m{c}": (c, [0.5]) for c in "xyz"}).withColumnRenamed("n", "__n")
    center = center.withColumns({f"__m{c}": F.col(f"__m{c}")[0] for c in "xyz"})
    square = sum((F.col(c) - F.col(f"__m{c}")) * (F.col(c) - F.col(f"__m{c}")) for c in "xyz")
    far = points.join(center, group).withColumn("__d", F.sqrt(square))
    spread = far.groupBy(group).agg(F.stddev_pop("__d").alias("__s"))
    return far.join(spread, group).where((F.col("__n") < 4) | (F.col("__s") <= 0) | (F.col("__d") <= sigmas * F.col("__s"))).select(points.columns)


def valid_groups(groups: DataFrame, visible: str = "visible_ids", least: int = 2) -> DataFrame:
    return groups.where(F.size(visible) >= least)


def in_time_range(df: DataFrame, ts: str, start: float | None, end: float | None) -> DataFrame:
    out = df if start is None else df.where(F.col(ts) >= start)
    return out if end is None else out.where(F.col(ts) <= end)


def frames_without(frames: DataFrame, detections: DataFrame, key: str) -> DataFrame:
    return frames.join(detections.select(key).distinct(), key, "left_anti")


def clip_to(df: DataFrame, reference: DataFrame, ts: str, padding: float = 5.0) -> DataFrame:
    """Rows within the reference's time range and padding; the range is one row."""
    span = reference.agg((F.min(ts) - padding).alias("__lo"), (F.max(ts) + padding).alias("__hi"))
    return df.join(F.broadcast(span), F.col(ts).between(F.col("__lo"), F.col("__hi")), "left_semi")


def every_n(df: DataFrame, index: str, n: int, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows start, start + n, ... by index; at most limit of them."""
    out = df.where((F.col(index) >= start) & ((F.col(index) - start) % n == 0))
    return out if limit is None else out.where(F.col(index) < start + n * limit)


def not_yet_done(jobs: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return jobs.join(manifest, key, "left_anti")
