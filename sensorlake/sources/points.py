"""Binary point-cloud and image messages to rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One point on the wire (fixed values).
WIRE = np.dtype([("offset_time", "<u4"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("reflectivity", "u1"), ("tag", "u1"), ("line", "u1")])

#: Points that a task decodes at once.
POINTS = 1 << 18


def points_of(payload: bytes) -> np.ndarray:
    """The points of a message: sequence, stamp, frame id, time base, count and lidar id precede them."""
    (name,) = struct.unpack_from("<I", payload, 12)
    at = 16 + name + 8
    (count,) = struct.unpack_from("<I", payload, at)
    return np.frombuffer(payload, dtype=WIRE, count=count, offset=at + 4 + 4)


def decode_points(messages: DataFrame) -> DataFrame:
    """messages(bag, frame_index, ts, payload) to (bag, frame_index, ts, point_index, x, y, z); a message that is
    cut short is an error of its task."""

    def rows(batch: pa.RecordBatch, start: int, clouds: list[np.ndarray]) -> pa.RecordBatch:
        counts = np.array([len(p) for p in clouds])
        own = pa.array(np.repeat(np.arange(start, start + len(clouds)), counts))
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        points = np.concatenate(clouds)
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(own) for c in range(3)], pa.array(nth), *[pa.array(points[c].astype(np.float64)) for c in "xyz"]],
                                          names=["bag", "frame_index", "ts", "point_index", "x", "y", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, clouds = 0, 0, []
            for i in range(batch.num_rows):
                clouds.append(points_of(batch.column(3)[i].as_py()))
                held += len(clouds[-1])
                if held >= POINTS or i + 1 == batch.num_rows:
                    yield rows(batch, start, clouds)
                    start, held, clouds = i + 1, 0, []

    return messages.select("bag", "frame_index", "ts", "payload").mapInArrow(
        run, "bag string, frame_index long, ts double, point_index long, x double, y double, z double")


def encode_points(messages: DataFrame) -> DataFrame:
    """messages(..., points array<struct<x, y, z>>) with payload, as decode_points reads it, in place of points."""
    kept = [c for c in messages.columns if c != "points"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(len(kept))
            ends = np.asarray(points.offsets) - points.offsets[0].as_py()
            flat = points.flatten()
            wire = np.zeros(len(flat), dtype=WIRE)
            for i, c in enumerate("xyz"):
                wire[c] = flat.field(i).to_numpy(zero_copy_only=False)
            head = lambda i, n: struct.pack("<IIIIQI", i, 0, 0, 0, 0, n) + bytes(4)
            out = [head(i, b - a) + wire[a:b].tobytes() for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*kept, "payload"])

    schema = ", ".join(f"`{c}` {messages.schema[c].dataType.simpleString()}" for c in kept)
    return messages.select(*kept, F.col("points").cast("array<struct<x:double,y:double,z:double>>")).mapInArrow(run, f"{schema}, payload binary")


def decode_images(frames: DataFrame) -> DataFrame:
    """Raw mono8, bgr8 and rgb8 frames(bag, frame_index, ts, encoding, height, width, data) to BGR bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.select(["encoding", "height", "width", "data"]).to_pylist():
                kind = row["encoding"]
                if kind not in ("mono8", "bgr8", "rgb8"):
                    raise ValueError(f"unsupported image encoding: {kind}")
                image = np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], -1)
                image = np.repeat(image, 3, axis=2) if kind == "mono8" else image[..., ::-1] if kind == "rgb8" else image
                out.append(np.ascontiguousarray(image).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["bag", "frame_index", "ts", "bgr"])

    return frames.select("bag", "frame_index", "ts", "encoding", "height", "width", "data").mapInArrow(
        run, "bag string, frame_index long, ts double, bgr binary")


def list_recordings(spark: SparkSession, folder: str, pattern: str = "*.bag") -> DataFrame:
    """(path, name, length) of the recordings of a folder; an error if there are none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    if found.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return found


def open_source(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Stored messages by source type."""
    if kind not in ("points", "frames"):
        raise ValueError(f"unknown source type: {kind}")
    return spark.read.parquet(path)


def decode_objects(messages: DataFrame) -> DataFrame:
    """Messages whose points are records already, messages(bag, frame_index, ts, points array<struct<x, y, z>>), to rows."""
    each = messages.select("bag", "frame_index", "ts", F.posexplode("points").alias("point_index", "p"))
    return each.select("bag", "frame_index", "ts", F.col("point_index").cast("long").alias("point_index"), *[F.col(f"p.{c}").cast("double").alias(c) for c in "xyz"])


def live_frames(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of the images that a camera process writes to a folder: (path, ts in wall-clock seconds, data)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return stream.select("path", F.col("modificationTime").cast("double").alias("ts"), F.col("content").alias("data"))


def replayed(messages: DataFrame, times: int) -> DataFrame:
    """messages over and over, as a looping source gives them, with the number of the round."""
    return messages.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("round"))


def discover(files: DataFrame) -> DataFrame:
    """(dataset, status, reason, bags) of the data sets in a listing of files(path) below one root.

    A data set is a folder <root>/<dataset>/CollectionSystem with a pose file IE/<dataset>.txt and a folder rosbag, at most one
    level further down, with recordings.
    """
    parts = files.select("path", F.regexp_extract("path", r"([^/]+)/CollectionSystem/(.*)$", 1).alias("dataset"),
                         F.regexp_extract("path", r"/CollectionSystem/(.*)$", 1).alias("rest")).where("dataset <> ''")
    bag = F.col("rest").rlike(r"^([^/]+/)?rosbag/[^/]+\.bag$")
    found = parts.groupBy("dataset").agg(
        F.count_if(F.col("rest") == F.concat(F.lit("IE/"), F.col("dataset"), F.lit(".txt"))).alias("poses"),
        F.count_if(F.col("rest").rlike(r"^([^/]+/)?rosbag/")).alias("inside"), F.count_if(bag).alias("bags"))
    reason = F.when(F.col("poses") == 0, "no pose file").when(F.col("inside") == 0, "no recording folder").when(F.col("bags") == 0, "no recordings")
    return found.select("dataset", F.when(reason.isNull(), "ready").otherwise("skipped").alias("status"), reason.alias("reason"), "bags")
