import random

import pytest
from pyspark.sql import functions as F

from sensorlake.plans.flows import cleaned
from sensorlake.scratch import scratch_path
from sensorlake.streaming.cleaning import Track, cleaned_stream

SPEED, GAP = 5.0, 6.0


def planted(seed, n=400):
    """Frames of two tracks a second apart, some without an observation, with spikes and gaps of any length."""
    rng, rows = random.Random(seed), []
    for k in ("a", "b"):
        e = missing = 0
        for i in range(n):
            e += rng.uniform(-3, 3)
            missing = missing - 1 if missing > 0 else rng.choice([0] * 12 + [1, 3, 5, 9])
            shift = 100.0 if rng.random() < 0.08 else 0.0
            rows.append((k, 1000 + i + rng.choice([0.0, 0.25]), *((None,) * 3 if missing else (e + shift, 2.0 * e, 1.0 * i))))
    return rows


def batch(spark, rows):
    df = spark.createDataFrame(rows, "k string, ts double, e double, n double, u double")
    filled, _ = cleaned(df.where("e IS NOT NULL"), "k", df.select("k", "ts"), SPEED, GAP)
    return sorted((r["k"], r["ts"], round(r["e"], 6), round(r["n"], 6), round(r["u"], 6), r["interpolated"]) for r in filled.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tracks_frame_by_frame_equal_the_batch(spark, seed):
    rows, got = planted(seed), []
    for k in ("a", "b"):
        track = Track(SPEED, GAP)
        for _, ts, e, n, u in (r for r in rows if r[0] == k):
            track = Track(SPEED, GAP, track.state())
            got += [(k, *r) for r in track.frame(round(ts * 1e6), None if e is None else [e, n, u])]
            assert len(track.waiting) <= 30
        got += [(k, *r) for r in track.end()]
    want = batch(spark, rows)
    assert sorted((k, at / 1e6, round(e, 6), round(n, 6), round(u, 6), i) for k, at, e, n, u, i in got) == want
    assert sum(r[5] for r in want) > 20 and len(want) < len(rows)


def test_the_stream_equals_the_batch_and_goes_on_after_each_stop(spark):
    rows = planted(7)
    by_time = sorted(rows, key=lambda r: r[1] + (hash(r[2:]) % 5))  # out of order within the delay
    folder, out, state = (scratch_path(spark, n) for n in ("frames", "cleaned", "state"))
    schema = "k string, ts double, e double, n double, u double"
    for part in (by_time[:300], by_time[300:500], by_time[500:], [("z", 1e6, None, None, None)]):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")))
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = cleaned_stream(spark.readStream.schema(df.schema).parquet(folder), "k", "ts", "10 seconds", SPEED, GAP, 60.0)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(100)
        finally:
            query.stop()
    found = spark.read.schema(stream.schema).parquet(out).withColumn("ts", F.unix_micros("ts") / 1e6)
    assert sorted((r["k"], r["ts"], round(r["e"], 6), round(r["n"], 6), round(r["u"], 6), r["interpolated"]) for r in found.collect()) == batch(spark, rows)


def test_a_track_ends_later_than_a_gap(spark):
    with pytest.raises(ValueError):
        cleaned_stream(spark.createDataFrame([], "k string, ts timestamp, e double, n double, u double"), "k", "ts", "1 second", idle=1.0, max_gap=2.0)


def test_tracks_of_one_part_keep_apart(spark):
    rows = [(k + suffix, *r) for k, *r in planted(9, 60) for suffix in ("1", "2", "3")]
    folder, out, state = (scratch_path(spark, n) for n in ("frames", "cleaned", "state"))
    df = spark.createDataFrame([*rows, ("z", 1e6, None, None, None)], "k string, ts double, e double, n double, u double")
    df = df.withColumn("ts", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")))
    df.coalesce(1).write.parquet(folder)
    stream = cleaned_stream(spark.readStream.schema(df.schema).parquet(folder), "k", "ts", "10 seconds", SPEED, GAP, 60.0, parts=2)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(100)
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 2
    finally:
        query.stop()
    found = spark.read.schema(stream.schema).parquet(out).withColumn("ts", F.unix_micros("ts") / 1e6)
    assert sorted((r["k"], r["ts"], round(r["e"], 6), round(r["n"], 6), round(r["u"], 6), r["interpolated"]) for r in found.collect()) == batch(spark, rows)


def test_a_track_that_has_ended_twice_keeps_its_last_observation():
    """By its timer and again by the next frame: the step from the last observation counts however batches are cut."""
    def kept(ends):
        track, got = Track(SPEED, GAP), []
        for at, e in ((0, 0.0), (100, 1e6), (101, 2e6)):
            got += track.frame(at * 1_000_000, [e, 0.0, 0.0])
            if at == 0:
                for _ in range(ends):
                    got += track.end()
        return [r[0] for r in [*got, *track.end()]]

    assert kept(2) == kept(1)
