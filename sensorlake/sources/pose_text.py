"""Pose text files: whitespace-separated columns, one pose per line that starts with a digit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.functions.geo import dms_to_degrees


def parse_poses(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines with at least 18 tokens to poses; lines with a token that is no number are left out."""
    tokens = lines.where(F.trim(column).rlike("^[0-9]")).select(F.split(F.trim(column), r"\s+").alias("t")).where(F.size("t") >= 18)
    n = lambda i: F.element_at("t", i).try_cast("double")  # noqa: E731  1-based, negative from the end
    poses = tokens.select(
        n(1).alias("ts"), dms_to_degrees(n(4), n(5), n(6)).alias("latitude_deg"), dms_to_degrees(n(7), n(8), n(9)).alias("longitude_deg"),
        n(10).alias("height_m"), n(-4).alias("roll_deg"), n(-3).alias("pitch_deg"), n(-2).alias("heading_deg"))
    return poses.na.drop()


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    return parse_poses(spark.read.text(path))
