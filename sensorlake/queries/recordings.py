"""Queries on bag files that Spark writes from the tables, and on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.functions.records import rounded
from sensorlake.queries.base import SERIES, query, r, table
from sensorlake.queries.series import ASOF, CAMERA, CLEAN, GAP, LIDAR, SEEN, SIDES, SPEED
from sensorlake.scratch import scratch_path
from sensorlake.sources import bags
from sensorlake.sources.points import decode_points, encode_points
from sensorlake.streaming.asof import asof_stream
from sensorlake.streaming.cleaning import cleaned_stream

#: Orders in a bag; an order is a frame, 0.1 s after that of the order before.
ORDERS = 20_000


def _bags(spark, sf_dir):
    """Line items as the points of their orders' frames and the orders as messages of another topic, in bags."""
    bag = lambda k: F.format_string("bag_%06d", F.floor(F.col(k) / ORDERS).cast("long"))
    at = lambda k: (F.col(k) * 100_000_000).alias("ts_ns")
    point = F.struct("l_linenumber", (F.col("l_quantity") / 5 - 5).alias("x"), (F.col("l_extendedprice") % 2000 / 100 - 10).alias("y"), (F.col("l_discount") * 30 - 0.5).alias("z"))
    clouds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("p"))
    clouds = clouds.select(bag("l_orderkey").alias("bag"), F.lit("/points").alias("topic"), F.lit("driver/CustomMsg").alias("type"), at("l_orderkey"),
                           F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("points"))
    orders = table(spark, sf_dir, "orders").select(bag("o_orderkey").alias("bag"), F.lit("/status").alias("topic"), F.lit("std/String").alias("type"), at("o_orderkey"),
                                                   F.encode("o_orderstatus", "UTF-8").alias("payload"))
    return bags.bag_scratch(spark, encode_points(clouds).unionByName(orders), compression="lz4")


def _number(path):
    return F.regexp_extract(path, r"bag_(\d+)\.bag$", 1).cast("long").alias("bag")


XYZ = ", ".join(f"{r(f'CAST(CAST({e} AS FLOAT) AS DOUBLE)')} AS {c}" for c, e in
                (("x", "(l_quantity / 5 - 5)"), ("y", "(l_extendedprice % 2000 / 100 - 10)"), ("z", "(l_discount * 30 - 0.5)")))


@query(f"SELECT CAST(l_orderkey // {ORDERS} AS BIGINT) AS bag, dense_rank() OVER (PARTITION BY l_orderkey // {ORDERS} ORDER BY l_orderkey) - 1 AS frame_index, "
       f"{r('l_orderkey * 100000000 / 1e9')} AS ts, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice % 2000, l_discount) - 1 AS point_index, {XYZ} FROM lineitem")
def bag_points(spark, sf_dir):
    """One topic of all bags, decoded."""
    messages = bags.read_bags(spark, _bags(spark, sf_dir)).where("topic = '/points'")
    p = decode_points(bags.frames(messages))
    return p.select(_number(F.col("bag")), "frame_index", *rounded({"ts": F.col("ts")}), "point_index", *rounded({c: F.col(c) for c in "xyz"}))


@query(f"WITH m AS (SELECT o_orderkey AS k, o_orderstatus AS status, '/status' AS topic FROM orders), b AS (SELECT min(k) * 100000000 AS low, max(k) * 100000000 AS high FROM m) "
       f"SELECT CAST(k // {ORDERS} AS BIGINT) AS bag, k * 100000000 AS ts_ns, status FROM m, b WHERE k * 100000000 BETWEEN low + (high - low) // 4 AND low + (high - low) // 4 * 3")
def bag_range(spark, sf_dir):
    """One topic in the middle half of the recordings' time: chunks outside are not read."""
    ends = table(spark, sf_dir, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    low, high = (k * 100_000_000 for k in ends)
    quarter = (high - low) // 4
    messages = bags.read_bags(spark, _bags(spark, sf_dir)).where((F.col("topic") == "/status") & F.col("ts_ns").between(low + quarter, low + quarter * 3))
    return messages.select(_number(F.col("bag")), "ts_ns", F.decode("payload", "UTF-8").alias("status"))


def _streamed(spark, sf_dir, build):
    """build(stream of events), run over three slices of time, each by a query that goes on from the checkpoint of the one
    before; a last row moves the watermark past all others."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")
    slices = events.withColumn("month", F.floor(F.col("ts").cast("double") / (30 * 86400)))
    low, high = slices.agg(F.min("month"), F.max("month")).first()
    edges = [low + (high + 1 - low) * i / 3 for i in range(4)]
    end = {"user_id": F.lit(-1), "ts": F.col("ts") + F.expr("INTERVAL 30 DAYS"), "event_id": F.lit(-1), "event_type": F.lit("view"), "value": F.lit(0.0)}
    last = events.agg(F.max("ts").alias("ts")).select(*[end[c].cast(events.schema[c].dataType).alias(c) for c in events.columns])
    folder, out, state = (scratch_path(spark, n) for n in ("events", "streamed", "stream-state"))
    for part in [*(slices.where((F.col("month") >= a) & (F.col("month") < b)).drop("month") for a, b in zip(edges, edges[1:], strict=False)), last]:
        part.write.mode("append").parquet(folder)
        result = build(spark.readStream.schema(events.schema).parquet(folder))
        result.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


@query(f"WITH {SERIES}, {SIDES}, j AS ({ASOF}) SELECT event_id, coalesce(camera_id, -1) AS camera_id FROM j")
def stream_asof(spark, sf_dir):
    """The as-of join of two streams."""
    def build(events):
        left = events.where(LIDAR).select("user_id", "ts", "event_id")
        right = events.where(CAMERA).select("user_id", "ts", F.col("event_id").alias("camera_id"))
        return asof_stream(left, right, "user_id", "ts", "1 day").select("event_id", F.coalesce("m.camera_id", F.lit(-1)).alias("camera_id"))

    return _streamed(spark, sf_dir, build).where("event_id >= 0")


@query(f"WITH {SERIES}, {CLEAN} SELECT user_id, {r('ts')} AS ts, {r('value')} AS value, interpolated FROM fill")
def stream_cleaned(spark, sf_dir):
    """Spikes and gaps of a stream of frames."""
    def build(events):
        place = lambda v: F.when(F.expr(SEEN), v)
        frames = events.select("user_id", "ts", place(F.col("value")).alias("e"), place(F.lit(0.0)).alias("n"), place(F.lit(0.0)).alias("u"))
        return cleaned_stream(frames, "user_id", "ts", "1 day", SPEED, GAP, idle=20 * 86_400.0)

    out = _streamed(spark, sf_dir, build).where("user_id >= 0")
    return out.select("user_id", *rounded({"ts": F.unix_micros("ts") / 1e6, "value": F.col("e")}), "interpolated")
