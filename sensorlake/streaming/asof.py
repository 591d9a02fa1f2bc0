"""As-of join of two streams: each left row with the newest right row not after it."""

from __future__ import annotations

import json
import pickle
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Calls and states of a batch at most; a part holds what its keys wait for, so more keys by a hundred want more parts.
PARTS = 2048


def _rank(right: tuple) -> tuple:
    """Right rows by time; at one time by their columns, nulls first, as the batch join has it."""
    return right[0], [(v is not None, v) for v in json.loads(right[1]).values()]


def _by_time(rights: list[tuple]) -> list[tuple]:
    return sorted(rights, key=_rank if len({r[0] for r in rights}) < len(rights) else itemgetter(0))


def joined_until(passed: int, lefts: list[tuple], rights: list[tuple]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """From waiting rows (at, row) of one key: the pairs of rows that are certain once the watermark has passed that time, and
    what waits on.  What was read ahead of the left clock is pushed back until that clock arrives."""
    lefts, rights = sorted(lefts), _by_time(rights)
    out, newest, i = [], None, 0
    for at, row in lefts:
        if at > passed:
            break
        while i < len(rights) and rights[i][0] <= at:
            newest, i = rights[i][1], i + 1
        out.append((row, newest))
    gone = max(bisect_right(rights, passed, key=itemgetter(0)) - 1, 0)
    return out, lefts[len(out):], rights[gone:]


def _step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Holds, for each key of a part, the left rows that the watermark has not passed, and of the right rows the newest that it
    has passed and the later ones."""
    waiting, still, pairs = pickle.loads(state.get[0]) if state.exists else {}, {}, []
    for came in () if state.hasTimedOut else batches:
        for key, side, at, row in zip(*(came[c].tolist() for c in ("key", "side", "at", "row")), strict=True):
            waiting.setdefault(key, ([], []))[side].append((at, row))
    passed = state.getCurrentWatermarkMs() * 1000
    for key, (lefts, rights) in waiting.items():
        out, lefts, rights = joined_until(passed, lefts, rights)
        pairs += out
        if lefts or rights:
            still[key] = lefts, rights
    state.update((pickle.dumps(still),))
    if times := [lefts[0][0] for lefts, _ in still.values() if lefts]:
        call_again(state, min(times))
    if pairs:
        left, right = zip(*pairs, strict=True)
        yield pd.DataFrame({"left": left, "right": right}, dtype=object)


def in_parts(rows: DataFrame, parts: int, text: Column | None = None) -> DataFrame:
    """The column key as text (JSON unless told otherwise) and the part of all keys that it falls in: a call for each of many
    keys would cost far more than the rows of most of them."""
    text = F.to_json(F.struct("key"), OPTIONS) if text is None else text
    return rows.withColumn("key", text).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))


def call_again(state: GroupState, at: int) -> None:
    """Sets the timer for when the watermark has passed the time `at`, in microseconds."""
    state.setTimeoutTimestamp(max(-(-at // 1000) - 1, state.getCurrentWatermarkMs() + 1, 1))


def asof_stream(left: DataFrame, right: DataFrame, key: str, ts: str, delay: str, parts: int = PARTS) -> DataFrame:
    """The columns of left and a struct m of right's other columns (null where none precedes) for streams with a time stamp ts.

    A left row comes out once the watermark, `delay` behind the newest row of both streams, has passed it, for then no
    right row can come before it any more; so the result does not depend on how batches cut the streams.  Rows of either
    stream that come later than that are dropped, as everywhere in Structured Streaming.  The state of a key holds what is
    newer than the watermark and one right row more.  Keys are dealt to `parts`, whose states come and go with their rows: a batch
    makes at most a call for each part, however many keys there are.  The states lie in the RocksDB store, not in memory:
    `use_rocksdb` sets it.  Rows with a null key join with each other's, those
    with a null time match nothing and never come out.
    """
    use_rocksdb(left.sparkSession)
    fields = [c for c in right.columns if c != key]

    def side(df: DataFrame, number: int, columns: list[str]) -> DataFrame:
        return df.select(F.col(key).alias("key"), F.col(ts).alias("event_time"), F.unix_micros(ts).alias("at"), F.lit(number).alias("side"),
                         F.to_json(F.struct(*columns), OPTIONS).alias("row"))

    both = side(left, 0, left.columns).unionByName(side(right, 1, fields)).where("at IS NOT NULL").withWatermark("event_time", delay)
    joined = in_parts(both, parts).groupBy("part").applyInPandasWithState(_step, "left string, right string", "waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    kept = StructType([right.schema[c] for c in fields])
    return joined.select(F.from_json("left", left.schema, OPTIONS).alias("l"), F.from_json("right", kept, OPTIONS).alias("m")).select("l.*", "m")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
