"""Registry, and the driver's tables read as sensor data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.functions.records import epoch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points of 50 frames."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") % 50).alias("frame"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("point_index"),
        (c("l_quantity") / 5 - 5).alias("x"), (c("l_extendedprice") % 2000 / 100 - 10).alias("y"),
        (c("l_discount") * 30 - 0.5 + c("l_tax")).alias("z"))


PTS = ("pts AS (SELECT l_orderkey % 50 AS frame, l_orderkey * 8 + l_linenumber AS point_index, l_quantity / 5 - 5 AS x, "
       "l_extendedprice % 2000 / 100 - 10 AS y, l_discount * 30 - 0.5 + l_tax AS z FROM lineitem)")


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: the first three components, in 10 m; frames of some thousand points."""
    e = lambda i: (F.col("embedding")[i].cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 5000).cast("long").alias("frame"), F.col("vec_id").alias("id"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), "label")


VEC = ("vec AS (SELECT CAST(floor(vec_id / 5000) AS BIGINT) AS frame, vec_id AS id, CAST(embedding[1] AS DOUBLE) * 10 AS x, "
       "CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z, label FROM embeddings)")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples (user_id, ts in seconds, value, event_type, event_id)."""
    return table(spark, sf_dir, "events").select("user_id", epoch(F.col("ts")).alias("ts"), "value", "event_type", "event_id")


SERIES = "s AS (SELECT user_id, epoch_us(ts) / 1e6 AS ts, value, event_type, event_id FROM events)"


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k % 170 - 85).cast("double").alias("lat"),
                                                   (k * 7 % 360 - 180).cast("double").alias("lon"), (F.col("c_acctbal") / 10).alias("h"))


GEO = ("g AS (SELECT c_custkey AS id, CAST(c_custkey % 170 - 85 AS DOUBLE) AS lat, CAST(c_custkey * 7 % 360 - 180 AS DOUBLE) AS lon, "
       "c_acctbal / 10 AS h FROM customer)")


def r(expr: str, digits: int = 6) -> str:
    """Half-even rounding in SQL, without -0."""
    return f"round_even({expr}, {digits}) + 0.0"
