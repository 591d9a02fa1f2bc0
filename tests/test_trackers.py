import random
import time
from itertools import count, islice

import pandas as pd
import pytest

from sensorlake.config import Tracker
from sensorlake.operators.trackers import Multi, Single, multi_rows, single_rows, track_multi, track_single
from sensorlake.scratch import scratch_path
from sensorlake.streaming.trackers import _in_order, track_stream

SCHEMA = "key long, ts double, candidate_id long, x double, y double, z double, score double"


def planted(seed=3):
    """Frames of no, one and two candidates in recordings of several lengths, one without a key, and rows without a time."""
    rng, rows = random.Random(seed), [(5, None, 1, 1.0, 1.0, 1.0, 1.0), (5, float("nan"), 2, 1.0, 1.0, 1.0, 1.0)]
    for key, n in ((None, 40), (1, 1), (2, 90), (2**60 + 1, 33), (5, 7)):
        for i in range(n):
            found = [(key, i * 0.1, rng.randint(0, 10**6), rng.uniform(0, 2), rng.uniform(0, 2), 0.0, rng.random()) for _ in range(rng.randint(0, 2))]
            rows += found or [(key, i * 0.1, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def plain(rows, start, fold):
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == key and r[1] is not None and r[1] == r[1]), key=lambda r: (r[0], r[1] or 0))
        values = [(ts, *(float("nan") if v is None else v for v in (x, y, z, score))) for ts, _, x, y, z, score in mine]
        out += [(key, *r) for r in fold(start(Tracker()), values)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("track, start, fold", [(track_single, Single, single_rows), (track_multi, Multi, multi_rows)])
def test_recordings_are_streamed_one_after_the_other(spark, track, start, fold):
    rows = planted()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # frames and recordings go on in the next batch
    try:
        got = track(spark.createDataFrame(rows, SCHEMA), "key")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, start, fold)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan  # no call and no table for each recording


def test_a_fold_holds_one_frame():
    endless = ((i * 0.1, float(i), 0.0, 0.0, 1.0) for i in count())
    assert [r[0] for r in islice(single_rows(Single(), endless), 3)] == [0.0, 0.1, 0.2]


def test_a_frame_of_a_stream_costs_microseconds():
    n = 30_000
    part = pd.DataFrame({"ts": [i * 0.1 for i in range(n)][::-1], "candidate_id": range(n), "x": 1.0, "y": 0.0, "z": 0.0, "score": 1.0})
    began = time.process_time()
    rows = list(single_rows(Single(), _in_order(iter([part]))))
    assert time.process_time() - began < 3 and [r[0] for r in rows] == sorted(part["ts"])  # some 8 s with a pandas group for each


@pytest.mark.parametrize("track, many, kind, keys", [(track_single, False, "long", {}), (track_multi, True, "double", {1: -0.0, 2: 0.0, 5: float("nan"), 2**60 + 1: 0.1})])
def test_a_batch_of_a_stream_calls_for_parts_not_for_keys(spark, track, many, kind, keys):
    """Keys of one part keep apart, trackers go on in the next batch, and close ids beside a row without one keep their order."""
    twins = [(8, 0.5, None, None, None, None, None), (8, 0.6, 2**60 + 1, 1.0, 1.0, 0.0, 1.0), (8, 0.6, 2**60, 2.0, 2.0, 0.0, 1.0)]
    schema = SCHEMA.replace("key long", f"key {kind}")
    rows = [(keys.get(k, k if k is None or kind == "long" else float(k)), *r) for k, *r in planted() + twins]
    late = lambda r: r[1] is not None and r[1] > 1.05
    folder, out, state = (scratch_path(spark, n) for n in ("candidates", "tracked", "state"))
    for part in ([r for r in rows if not late(r)], [r for r in rows if late(r)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = track_stream(spark.readStream.schema(schema).parquet(folder), "key", many=many, parts=2)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(100)
            assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 2  # 6 keys: before, a call and a state for each
        finally:
            query.stop()
    want = track(spark.createDataFrame(rows, schema), "key")
    assert stream.schema == want.schema
    told = lambda d: sorted(((r[0] if r[0] is None else r[0] + 0, *r[1:]) for r in map(tuple, d.collect())), key=repr)
    assert repr(told(spark.read.schema(stream.schema).parquet(out))) == repr(told(want)) and want.count() > 50
