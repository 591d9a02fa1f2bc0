"""The trackers over a stream of frames, with the same step functions as in batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, FloatType, IntegralType, StringType, StructField, StructType

from sensorlake.config import Tracker
from sensorlake.functions.records import epoch
from sensorlake.operators.trackers import MULTI_SCHEMA, NAN, SINGLE_SCHEMA, Multi, Single, multi_rows, single_rows
from sensorlake.scratch import scratch_path
from sensorlake.streaming.asof import OPTIONS, PARTS, in_parts, use_rocksdb


def track_stream(candidates: DataFrame, key: str, cfg: Tracker = Tracker(), many: bool = False, parts: int = PARTS) -> DataFrame:
    """States per key and frame of a stream candidates(key, ts, candidate_id, x, y, z, score): of one target, or with
    `many` of all confirmed ones.  Rows of a key have to arrive in time order from batch to batch; inside a batch
    they are sorted.  Keys are dealt to `parts`, whose trackers come and go with their rows: a batch makes at most a call for
    each part, however many keys there are, and a call holds the batch's rows of one part."""
    use_rocksdb(candidates.sparkSession)
    schema, fold, start = (MULTI_SCHEMA, multi_rows, Multi) if many else (SINGLE_SCHEMA, single_rows, Single)
    names, kind = ["key"] + [c.split()[0] for c in schema.split(", ")], candidates.schema[key].dataType
    plain = isinstance(kind, (IntegralType, StringType))  # as JSON their keys took a quarter of the time

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trackers, came = pickle.loads(state.get[0]) if state.exists else {}, {}
        for *row, k in _in_order(batches):
            came.setdefault(k, []).append(row)
        done = ((k, *r) for k, rows in came.items() for r in fold(trackers.setdefault(k, start(cfg)), rows))
        while some := list(islice(done, 10_000)):
            yield pd.DataFrame(dict(zip(names, zip(*some, strict=True), strict=True)))
        state.update((pickle.dumps(trackers),))

    dealt = in_parts(_ready(candidates, key), parts, F.col("key").cast("string") if plain else None)
    out = dealt.groupBy("part").applyInPandasWithState(
        step, f"key string, {schema}", "trackers binary", "append", GroupStateTimeout.NoTimeout)
    typed = F.col("key").cast(kind) if plain else F.from_json("key", StructType([StructField("key", kind)]), OPTIONS)["key"]
    return out.select(typed.alias(key), *names[1:])


def _ready(candidates: DataFrame, key: str) -> DataFrame:
    """The rows that have a time, with numbers as doubles; whole-numbered ids hold no nulls, which pandas would make them lose digits for."""
    known = candidates if "score" in candidates.columns else candidates.withColumn("score", F.lit(NAN))  # many targets need none
    kind, id_kind = candidates.schema[key].dataType, candidates.schema["candidate_id"].dataType
    one = F.col(key) + F.lit(0.0).cast(kind) if isinstance(kind, (FloatType, DoubleType)) else F.col(key)  # -0.0 is 0.0
    ids = F.coalesce("candidate_id", F.lit(0).cast(id_kind)) if isinstance(id_kind, IntegralType) else F.col("candidate_id")
    numbers = [F.col(c).cast("double").alias(c) for c in ("ts", "x", "y", "z", "score")]
    ready = known.select(one.alias("key"), *numbers, ids.alias("candidate_id"), F.col("candidate_id").isNull().alias("no_id"))
    return ready.where("ts IS NOT NULL AND NOT isnan(ts)")


def _in_order(parts: Iterator[pd.DataFrame]) -> list[tuple]:
    """The rows (ts, x, y, z, score, and key if there is one) by time and id, rows without a time left out: short lists,
    faster sorted in Python than by pandas."""
    rows = []
    for part in parts:
        no_id = part["candidate_id"].isna()
        rows += zip(*(part[c].astype(float).tolist() if c in part else [NAN] * len(part) for c in ("ts", "x", "y", "z", "score")),
                    (no_id | part["no_id"] if "no_id" in part else no_id).tolist(), part["candidate_id"].tolist(),
                    *([part["key"].tolist()] if "key" in part else []), strict=True)
    return [r[:5] + r[7:] for r in sorted((r for r in rows if r[0] == r[0]), key=lambda r: (r[0], r[5], 0 if r[5] else r[6]))]


def single_tracker_over_files(spark: SparkSession, path: str) -> DataFrame:
    """Runs the tracker over an events table as an availableNow stream and returns what it wrote."""
    schema = spark.read.parquet(path).schema
    parent, name = path.rstrip("/").rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path) if _is_folder(
        spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)
    hit = F.col("event_type") != "error"
    frames = stream.select("user_id", epoch(F.col("ts")).alias("ts"), F.col("event_id").alias("candidate_id"), F.when(hit, F.col("value")).alias("x"),
                           F.when(hit, F.lit(0.0)).alias("y"), F.when(hit, F.lit(0.0)).alias("z"), F.lit(1.0).alias("score"))
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    tracked = track_stream(frames, "user_id").select("user_id", "ts", F.bround("x", 4).alias("x"), F.bround("quality", 4).alias("quality"), "lifecycle")
    tracked.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(tracked.schema).parquet(out)


def _is_folder(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(folder).isDirectory()
