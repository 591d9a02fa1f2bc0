import random

import pytest
from pyspark.sql import functions as F

from sensorlake.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(2)
    rows = [(0, rng.gauss(0, 1e3) * 10 ** rng.randint(-6, 6), float(rng.randint(0, 3))) for _ in range(5000)]  # one frame holds nearly all
    rows += [(1, float(i), None) for i in range(10)] + [(2, 7.5, 1.0), (None, 1.0, 2.0), (None, 4.0, float("nan")), (3, None, None), (4, 1e308, -0.0), (4, -1e308, 0.0)]
    rows += [(5, float(i % 2), float("inf")) for i in range(300)]
    return spark.createDataFrame(rows, "frame long, x double, y double").repartition(7).cache()


WANTED = {"x": ("x", [0.1, 0.5, 0.9]), "y": ("y", [0.5]), "ends": ("x", [0.0, 1.0])}


@pytest.mark.parametrize("most", [0, 100, 10**9])
def test_equal_to_percentile(points, most):
    finite = points.withColumn("y", F.when(~F.isnan("y") & (F.abs("y") < float("inf")), F.col("y")))
    want = finite.groupBy("frame").agg(F.count("*").alias("n"), *[F.percentile(c, F.array(*map(F.lit, qs))).alias(n) for n, (c, qs) in WANTED.items()])
    got = quantiles(points, ["frame"], WANTED, hot=10**9, most=most)
    rows = lambda df: sorted((repr([v if v is None else [x + 0.0 for x in v] if isinstance(v, list) else v for v in r]) for r in df.collect()))
    assert rows(got) == rows(want)


def test_two_keys_clashing_names_and_empty(points):
    df = points.withColumns({"n": F.lit(1), "lo": F.lit("a")})
    want = df.groupBy("frame", "lo").agg(F.percentile("x", F.array(F.lit(0.3))).alias("q"))
    got = quantiles(df, ["frame", "lo"], {"q": ("x", [0.3])}, hot=10**9, most=50)
    assert sorted(map(repr, got.select("frame", "lo", "q").collect())) == sorted(map(repr, want.collect()))
    assert quantiles(df.where("false"), ["frame"], WANTED, most=0).collect() == []
