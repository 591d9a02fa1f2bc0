import random

import pytest
from pyspark.sql import functions as F

from sensorlake.operators import timejoin
from sensorlake.scratch import scratch_path
from sensorlake.streaming.asof import asof_stream, joined_until

LEFT, RIGHT = "k string, t timestamp, id long, side string", "k string, t timestamp, v double, cam long, side string"


def run(spark, folder, out, state, delay="30 seconds", seconds=100):
    rows = spark.readStream.schema("k string, t timestamp, id long, v double, cam long, side string").parquet(folder)
    left, right = rows.where("side = 'l'").select("k", "t", "id"), rows.where("side = 'r'").select("k", "t", "v", "cam")
    joined = asof_stream(left, right, "k", "t", delay)
    query = joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(seconds)
    finally:
        query.stop()
    return spark.read.schema(joined.schema).parquet(out)


def batches(spark, rows, cuts):
    """Appends the rows in slices that come one after the other, then a row far ahead that moves the watermark."""
    for part in cuts(rows):
        yield spark.createDataFrame([(k, None if t is None else float(t), i, v, c, s) for k, t, i, v, c, s in part],
                                    "k string, t double, id long, v double, cam long, side string").withColumn("t", F.timestamp_micros((F.col("t") * 1e6).cast("long")))


def planted(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1000, 1300):
        t = i + rng.choice([0, 0.000001, 0.5]) if rng.random() < 0.9 else i - 20  # out of order within the delay
        rows.append((rng.choice(["a", "b", "c"]), t, i, None, None, "l") if rng.random() < 0.5 else
                    (rng.choice(["a", "b"]), t, None, rng.choice([None, 1.5, 2.0]), rng.randint(0, 3), "r"))
    return rows


@pytest.mark.parametrize("size", [70, 1000])
def test_equals_the_batch_join_whatever_the_cuts_and_after_restarts(spark, size):
    rows = planted(size)
    folder, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    cuts = lambda rows: [*[rows[i:i + size] for i in range(0, len(rows), size)], [("z", 1e6, -1, None, None, "l")]]
    for part in batches(spark, rows, cuts):
        part.coalesce(1).write.mode("append").parquet(folder)
        found = run(spark, folder, out, state)  # a new query, from the checkpoint, for every slice
    every = spark.read.parquet(folder).where("id IS NULL OR id >= 0")
    seconds = every.withColumn("t", F.unix_micros("t") / 1e6)
    want = timejoin.asof_backward(seconds.where("side = 'l'").select("k", "t", "id"), seconds.where("side = 'r'").select("k", "t", "v", "cam"), "k", "t", width=50.0)
    got = {(r["id"], r["m"] and (r["m"]["t"].timestamp(), r["m"]["v"], r["m"]["cam"])) for r in found.collect()}
    assert got == {(r["id"], r["m"] and (r["m"]["t"], r["m"]["v"], r["m"]["cam"])) for r in want.collect()}
    assert found.count() == want.count() > 100


def test_late_rows_are_dropped_and_early_right_rows_wait(spark):
    folder, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    slices = [[("a", 10, None, 1.0, 1, "r"), ("a", 500, None, 5.0, 5, "r"), ("a", 20, 1, None, None, "l")],  # the right row of 500 is ahead
              [("a", 15, None, 9.0, 9, "r"), ("a", 16, 7, None, None, "l"), ("a", 510, 2, None, None, "l")],  # 15 and 16 are late
              [("z", 1e6, -1, None, None, "l")]]
    for part in batches(spark, None, lambda _: slices):
        part.coalesce(1).write.mode("append").parquet(folder)
        found = run(spark, folder, out, state)
    assert sorted((r["id"], r["m"]["v"]) for r in found.collect()) == [(1, 1.0), (2, 5.0)]


def test_many_keys_share_few_calls(spark):
    """Keys of a part keep their own rows: large numbers, a null, and a number for each of many; one state for each part."""
    rng = random.Random(4)
    keys = [None, 2**60, 2**60 + 1, *range(40)]
    rows = [(rng.choice(keys), 1_000_000 * rng.randint(1, 10**6), i, rng.choice("lr")) for i in range(1500)] + [(7, 10**13, -1, "l")]
    folder, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    df = spark.createDataFrame(rows, "k long, at long, id long, side string").withColumn("t", F.timestamp_micros("at")).drop("at")
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    joined = asof_stream(stream.where("side = 'l'").select("k", "t", "id"), stream.where("side = 'r'").select("k", "t", F.col("id").alias("cam")), "k", "t", "1 second", parts=3)
    query = joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(100)
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 3
    finally:
        query.stop()
    got = {(r["k"], r["id"], r["m"] and r["m"]["cam"]) for r in spark.read.schema(joined.schema).parquet(out).collect() if r["id"] >= 0}
    want = {(k, i, max(((a, j) for key, a, j, s in rows if key == k and s == "r" and a <= at), default=(0, None))[1]) for k, at, i, side in rows if side == "l" and i >= 0}
    assert len({(k, a) for k, a, _, s in rows if s == "r"}) == sum(r[3] == "r" for r in rows) and got == want


def test_what_is_certain_and_what_waits():
    lefts, rights = [(30, "c"), (5, "a"), (20, "b")], [(25, '{"v":1}'), (6, '{"v":2}'), (6, '{"v":null}'), (40, '{"v":3}')]
    assert joined_until(20, lefts, rights) == ([("a", None), ("b", '{"v":2}')], [(30, "c")], [(6, '{"v":2}'), (25, '{"v":1}'), (40, '{"v":3}')])
    assert joined_until(4, [], []) == ([], [], [])
