"""World trajectories: wide CSV, JSON lines and JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_COLUMNS = ("utc_seconds", "gt_lat", "gt_lon", "gt_height", "gt_roll", "gt_pitch", "gt_heading",
               "target_0_lat", "target_0_lon", "target_0_height", "target_1_lat", "target_1_lon", "target_1_height")
RECORD = ("timestamp double, source_bag string, aruco_group_targets array<struct<target_group_index:int, target_lidar_m:array<double>, "
          "target_world_enu_m:array<double>, target_world_lla:array<double>, interpolated:boolean>>")


def read_world_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in CSV_COLUMNS))


def target_tracks(wide: DataFrame) -> DataFrame:
    """Long (target, ts, lon, lat, alt) of the two slots; blank or unparsable rows are left out, and targets
    with fewer than two points."""
    long = None
    for g in (0, 1):
        part = wide.select(F.lit(f"target_{g}").alias("target"), F.col("utc_seconds").try_cast("double").alias("ts"), *[
            F.col(f"target_{g}_{c}").try_cast("double").alias(n) for c, n in (("lon", "lon"), ("lat", "lat"), ("height", "alt"))])
        long = part if long is None else long.unionByName(part)
    long = long.na.drop()
    enough = long.groupBy("target").count().where("count >= 2").select("target")
    return long.join(enough, "target", "left_semi")


def read_records(spark: SparkSession, path: str, strict: bool = False, array: bool = False) -> DataFrame:
    """JSON records; unless strict, lines that are no JSON objects are left out.  array: files hold one list each."""
    if strict:
        return spark.read.schema(RECORD).option("mode", "FAILFAST").option("multiLine", array).json(path)
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").option("multiLine", array).json(path).where("timestamp IS NOT NULL")


def plotted_track(records: DataFrame, field: str = "target_world_enu_m", group: int = 0, least: int = 2) -> DataFrame:
    """(ts, elapsed, a, b, c) of one vector field of a group, for a plot; an error if fewer than `least` rows have it."""
    each = records.select("timestamp", F.explode("aruco_group_targets").alias("g")).where((F.col("g.target_group_index") == group) & (F.size(F.col(f"g.{field}")) >= 3))
    start = each.agg(F.min("timestamp").alias("start"), F.count("*").alias("n")).first()
    if start.n < least:
        raise ValueError(f"{start.n} rows with {field}")
    return each.select(F.col("timestamp").alias("ts"), (F.col("timestamp") - start.start).alias("elapsed"), *[F.col(f"g.{field}")[i].alias(n) for i, n in enumerate("abc")])


def group_points(records: DataFrame) -> DataFrame:
    """One row per record and group with an ENU position."""
    each = records.select("timestamp", F.explode("aruco_group_targets").alias("g")).where("g.target_world_enu_m IS NOT NULL")
    enu = F.col("g.target_world_enu_m")
    return each.select("timestamp", F.col("g.target_group_index").alias("group_index"), *[enu[i].alias(n) for i, n in enumerate(("e", "n", "u"))],
                       F.coalesce("g.interpolated", F.lit(False)).alias("interpolated"))
