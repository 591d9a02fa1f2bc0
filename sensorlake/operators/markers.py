"""Marker groups: membership, missing ids, centres, boxes and the best group of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.config import TARGET_GROUPS


def group_table(df: DataFrame, groups=TARGET_GROUPS) -> DataFrame:
    """(group_index, target_ids) of the configured groups: a fixed, small dimension."""
    rows = [(i, list(ids)) for i, ids in enumerate(groups)]
    return df.sparkSession.createDataFrame(rows, "group_index int, target_ids array<int>")


def normalise_groups(ids) -> list[list[int]]:
    """A number, a list of numbers or a list of lists to a list of lists."""
    if isinstance(ids, int):
        return [[ids]]
    return [list(map(int, g)) for g in ids] if ids and not isinstance(ids[0], int) else [list(map(int, ids))]


def distinct_ids(groups: Column) -> Column:
    """The ids of an array of groups, each once, in the order in which they first come."""
    return F.array_distinct(F.flatten(groups))


def members(detections: DataFrame, groups: DataFrame, marker: str = "marker_id") -> DataFrame:
    each = groups.select("group_index", F.size("target_ids").alias("group_size"), F.explode("target_ids").alias(marker))
    return detections.join(F.broadcast(each), marker)  # as many rows as configured ids


def group_targets(detections: DataFrame, groups: DataFrame, frame: str, order: str) -> DataFrame:
    """Per frame and group: visible ids in detection order (repeats count), coverage and mean centre."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("marker_id").alias("i")))), lambda s: s["i"])
    return members(detections, groups).groupBy(frame, "group_index").agg(
        ids.alias("visible_ids"), F.count("*").alias("visible"), (F.count("*") / F.first("group_size")).alias("coverage"),
        *[F.avg(c).alias(c) for c in ("tx", "ty", "tz") if c in detections.columns])


def group_boxes(detections: DataFrame, groups: DataFrame, frame: str) -> DataFrame:
    """Bounding box of all corners (array of u, v) of a group's markers and its area."""
    corner = members(detections, groups).withColumn("p", F.explode("corners"))
    box = corner.groupBy(frame, "group_index").agg(*[f(F.col("p")[c]).alias(f"{c}_{n}") for c in "uv" for n, f in (("min", F.min), ("max", F.max))])
    return box.withColumn("area", (F.col("u_max") - F.col("u_min")) * (F.col("v_max") - F.col("v_min")))


def matched_groups(frames: DataFrame, groups: DataFrame, ids: str = "marker_ids") -> DataFrame:
    """frames with each group that shows in them: visible ids sorted, missing ids in the group's order."""
    both = frames.join(F.broadcast(groups))
    seen = both.withColumn("visible_ids", F.array_sort(F.array_intersect("target_ids", ids))).withColumn("missing_ids", F.array_except("target_ids", ids))
    return seen.where(F.size("visible_ids") > 0)


def best_group(targets: DataFrame, frame: str, *keys: str) -> DataFrame:
    """The group that is largest in keys, the smallest index on a tie."""
    w = Window.partitionBy(frame).orderBy(*[F.desc(k) for k in keys], "group_index")
    return targets.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def centre_or(centroids: DataFrame, marker_centres: DataFrame, keys: list[str]) -> DataFrame:
    """Marker centres replaced by the lidar centroid of their group where there is one."""
    c = centroids.select(*keys, *[F.col(v).alias(f"__{v}") for v in "xyz"])
    return marker_centres.join(c, keys, "left").select(*keys, *[F.coalesce(f"__{v}", v).alias(v) for v in "xyz"])
