import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.operators import buckets, timejoin, trajectory


@pytest.fixture(scope="module")
def track(spark):
    """One recording of 400 rows over some 100 buckets, a short one, and one whose rows have no key; some times are null."""
    rng = random.Random(5)
    rows, t = [], 0.0
    for i in range(400):
        t += rng.choice([0.0, 0.5, 1.0, 40.0])
        rows.append(("a", t, i, rng.uniform(-50, 50), rng.choice([True, False, False, None])))
    rows += [("b", 3.0, 1, 1.0, False), (None, -5.0, 2, 2.0, True), (None, 70.0, 3, None, False), ("b", None, 0, 4.0, False), ("b", None, 1, 5.0, False)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "key string, ts double, id long, v double, hit boolean").cache()


ORDER = ["ts", "id"]


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(a.columns) == columns
    assert sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


@pytest.mark.parametrize("width", [0.7, 30.0, 1e9])
def test_equal_to_windows_over_the_key(track, width):
    row, W = F.struct("ts", "v"), Window.partitionBy("key").orderBy(*ORDER)  # noqa: N806
    same(buckets.neighbours(track, ["key"], ORDER, ["ts", "v"], width), track.withColumns({"before": F.lag(row).over(W), "after": F.lead(row).over(W)}))
    seen = F.when(F.col("hit"), row)
    same(buckets.observations(track, ["key"], ORDER, F.col("hit"), ["ts", "v"], width), track.withColumns({
        "before": F.last(seen, ignorenulls=True).over(W.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.first(seen, ignorenulls=True).over(W.rowsBetween(0, Window.unboundedFollowing))}))
    same(buckets.row_numbers(track, ["key"], "ts", ORDER, width), track.withColumn("nth", F.row_number().over(W)))
    island = track.withColumn("i", F.count_if("hit").over(W.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("key", "i").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    same(buckets.streaks(track, ["key"], ORDER, F.col("hit"), width), island.withColumn("streak", F.count_if(~F.col("hit")).over(inner)).drop("i"))
    for k in (1, 7):
        same(buckets.histories(track, ["key"], ORDER, "v", k, width), track.withColumn("history", F.collect_list("v").over(W.rowsBetween(-k + 1, 0))))


def test_no_window_orders_the_rows_of_a_key(track):
    """Only summaries, one row per bucket, are ordered over a key alone."""
    for df in (trajectory.step_speed(track, "key", "ts", ["v"], ORDER), trajectory.fill_gaps(track, "key", "ts", "hit", ["v"], order=ORDER),
               trajectory.miss_streak(track, "key", ORDER, "hit"), trajectory.long_gaps(track, "key", "ts", "hit", order=ORDER),
               trajectory.frame_index(track, "key", ORDER), timejoin.pose_intervals(track, "key")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if " Window " in line or line.lstrip("+- :").startswith("Window ")]
        assert windows
        for line in windows:
            keys, order = line.rsplit("], [", 2)[-2:]
            assert "__bucket" in keys or "__bucket" in order, line


def test_empty(track):
    none = track.where("false")
    assert buckets.neighbours(none, ["key"], ORDER, ["v"]).collect() == buckets.histories(none, ["key"], ORDER, "v", 3).collect() == []
