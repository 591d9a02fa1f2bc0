"""The recordings' flows, each a DataFrame pipeline keyed by bag and frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.config import MAX_GAP_S, MAX_SPIKE_SPEED, SYNC_TOLERANCE_S, Camera, Clustering, EgoBox, Extrinsics, Ground, Person, Roi, Tracker
from sensorlake.functions import geo, projection
from sensorlake.operators import cluster, filters, ground, markers, spatial, timejoin, trackers, trajectory
from sensorlake.operators.quantiles import quantiles
from sensorlake.scratch import stored

POSE_LINEAR, POSE_ANGLES = ["latitude_deg", "longitude_deg", "height_m"], ["roll_deg", "pitch_deg", "heading_deg"]


def regional(points: DataFrame, roi: Roi = Roi(), ego: EgoBox = EgoBox()) -> DataFrame:
    return filters.without_ego(filters.region_of_interest(points, "circle", roi), ego)


def ground_lab(points: DataFrame, roi: Roi = Roi(), ego: EgoBox = EgoBox(), g: Ground = Ground()) -> DataFrame:
    """Counts, keep ratio and height profiles before and after ground removal, per frame."""
    inside = regional(points, roi, ego)
    kept = stored(ground.remove_ground(inside, "frame", "point_index", g).select("frame", "z"), "kept")
    profile = lambda df, n, name: quantiles(df, ["frame"], {name: ("z", [0.1, 0.5, 0.9])}).withColumnRenamed("n", n)
    after, before = profile(kept, "kept", "filtered_z"), profile(inside, "inside", "raw_z")
    raw = points.groupBy("frame").agg(F.count("*").alias("raw"))
    joined = raw.join(before, "frame", "left").join(after, "frame", "left").na.fill(0, ["inside", "kept"])
    return joined.withColumn("keep_ratio", F.coalesce(F.bround(F.try_divide("kept", "inside"), 6), F.lit(0.0)))


def lidar_states(points: DataFrame, times: DataFrame, bag: str = "bag", cfg: Tracker = Tracker(), c: Clustering = Clustering(),
                   p: Person = Person(), g: Ground = Ground()) -> DataFrame:
    """points(bag, frame, point_index, x, y, z) and times(bag, frame, ts) to one tracker state per frame.

    frame identifies a frame across bags.
    """
    kept = ground.remove_ground(regional(points), "frame", "point_index", g)
    found = cluster.candidates(cluster.eps_clusters(kept, "frame", "point_index", c), "frame", p)
    feet = found.select("frame", F.col("cluster_id").alias("candidate_id"), F.col("foot_x").alias("x"), F.col("foot_y").alias("y"), F.col("foot_z").alias("z"), "score")
    frames = times.join(feet, "frame", "left").select(bag, "ts", F.coalesce("candidate_id", F.lit(-1)).alias("candidate_id"), "x", "y", "z", "score")
    return trackers.track_single(frames, bag, cfg)


def marker_targets(detections: DataFrame, frame: str = "frame") -> DataFrame:
    """Groups with at least two visible markers, their centres and hulls of all corners."""
    groups = markers.group_table(detections)
    targets = filters.valid_groups(markers.group_targets(detections, groups, frame, "det"))
    corners = markers.members(detections, groups).select(frame, "group_index", F.explode("corners").alias("p")).select(frame, "group_index", "p.u", "p.v")
    return targets.join(spatial.hulls(corners, [frame, "group_index"]), [frame, "group_index"])


def hull_targets(points: DataFrame, targets: DataFrame, camera: Camera = Camera()) -> DataFrame:
    """Mean position of the lidar points that project into each group's hull, without outliers."""
    v = projection.lidar_to_camera((F.col("x"), F.col("y"), F.col("z")), camera)
    seen = projection.with_fisheye(points, v, ("u", "v"), camera).where(F.col("u").isNotNull() & projection.in_image(F.col("u"), F.col("v"), camera))
    inside = spatial.hull_join(seen, targets.select("frame", "group_index", "hull", "area", "x_min", "x_max", "y_min", "y_max"), "frame")
    keyed = inside.withColumn("target", F.struct("frame", "group_index"))
    clean = filters.outliers_removed(keyed, "target")
    return cluster.centroids(clean, "target").select("target.*", "points", "x", "y", "z")


def fused_targets(points: DataFrame, times: DataFrame, detections: DataFrame, camera_times: DataFrame, bag: str = "bag", strict_sync: bool = False,
                  camera: Camera = Camera()) -> DataFrame:
    """Lidar frames with the groups of the newest camera frame not after them; without strict_sync a group stays in
    use however old it is, as in the field system."""
    tolerance = SYNC_TOLERANCE_S if strict_sync else None
    cam = camera_times.select(bag, "ts", F.col("frame").alias("camera_frame"))
    matched = timejoin.asof_backward(times, cam, bag, tolerance=tolerance).select(bag, "frame", "ts", F.col("m.camera_frame").alias("camera_frame"))
    targets = marker_targets(detections).withColumnRenamed("frame", "camera_frame")
    here = matched.join(targets, "camera_frame")
    lidar = hull_targets(points, here, camera).select("frame", "group_index", "x", "y", "z")
    centres = here.select("frame", "group_index", bag, "ts", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    return markers.centre_or(lidar, centres, ["frame", "group_index"]).join(centres.select("frame", "group_index", bag, "ts"), ["frame", "group_index"])


def world_solution(targets: DataFrame, poses: DataFrame, bag: str = "bag", e: Extrinsics = Extrinsics()) -> DataFrame:
    """targets(bag, ts, x, y, z) to geodetic positions and ENU about the first pose of all."""
    posed = timejoin.interpolate_poses(targets, poses, bag, POSE_LINEAR, POSE_ANGLES)
    lat, lon, h = (F.col(c) for c in POSE_LINEAR)
    enu = geo.apply(geo.attitude(*[F.col(c) for c in POSE_ANGLES]), geo.lidar_to_body((F.col("x"), F.col("y"), F.col("z")), e))
    ecef = geo.add(geo.geodetic_to_ecef(lat, lon, h), geo.apply(geo.transposed(geo.enu_from_ecef(lat, lon)), enu))
    out = posed.select("*", *[c.alias(f"ecef_{n}") for c, n in zip(ecef, "xyz", strict=True)])
    out = geo.with_geodetic(out, ("ecef_x", "ecef_y", "ecef_z"), ("lat", "lon", "height"))
    origin = first_pose(poses)
    place = tuple(F.col(f"o.{c}") for c in POSE_LINEAR)
    zero = geo.geodetic_to_ecef(*place)
    local = geo.apply(geo.enu_from_ecef(place[0], place[1]), tuple(F.col(f"ecef_{n}") - z for n, z in zip("xyz", zero, strict=True)))
    named = [c.alias(n) for c, n in zip(local, ("e", "n", "u"), strict=True)]
    return out.join(F.broadcast(origin)).select(*out.columns, *named)


def first_pose(poses: DataFrame) -> DataFrame:
    """The origin of the local frame: one row."""
    return poses.agg(F.min_by(F.struct(*POSE_LINEAR), "ts").alias("o"))


def placed(local: DataFrame, poses: DataFrame) -> DataFrame:
    """local(e, n, u, ...) about the first pose, with ecef_x, ecef_y, ecef_z, lat, lon and height."""
    both = local.join(F.broadcast(first_pose(poses)))
    place = tuple(F.col(f"o.{c}") for c in POSE_LINEAR)
    shift = geo.apply(geo.transposed(geo.enu_from_ecef(place[0], place[1])), (F.col("e"), F.col("n"), F.col("u")))
    ecef = geo.add(geo.geodetic_to_ecef(*place), shift)
    out = both.select(*local.columns, *[c.alias(f"ecef_{n}") for c, n in zip(ecef, "xyz", strict=True)])
    return geo.with_geodetic(out, ("ecef_x", "ecef_y", "ecef_z"), ("lat", "lon", "height"))


def cleaned(world: DataFrame, key: str, frames: DataFrame, max_speed: float = MAX_SPIKE_SPEED, max_gap: float = MAX_GAP_S,
            poses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """world(key, ts, e, n, u) without spikes and with short gaps filled at the times of frames(key, ts), with world positions
    (see `placed`) if poses are given; the second table lists the gaps that stay open."""
    kept = trajectory.reject_spikes(world, key, "ts", ["e", "n"], max_speed).select(key, "ts", "e", "n", "u", F.lit(True).alias("seen"))
    every = frames.select(key, "ts").distinct().join(kept, [key, "ts"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    filled = trajectory.fill_gaps(every, key, "ts", "seen", ["e", "n", "u"], max_gap)
    return filled if poses is None else placed(filled, poses), trajectory.long_gaps(every, key, "ts", "seen", max_gap)
