"""Every registered query of the library runs, and equals its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sensorlake.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name not in ORACLES:
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_stream_equals_batch(spark):
    rows = lambda n: sorted(map(tuple, QUERIES[n](spark, SF).select("user_id", "ts", "x", "quality", "lifecycle").collect()), key=repr)
    assert rows("stream_tracker") == rows("single_tracker")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_every_supplier_protects(spark):
    """On tables with more suppliers than the smallest ones have."""
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(ORACLES["protect_regions"])
    got = QUERIES["protect_regions"](spark, sf)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_cylinders_of_all_sizes(spark):
    from sensorlake.operators.filters import protected

    points = [(i, x / 4, y / 4, z) for i, (x, y, z) in enumerate((x, y, z) for x in range(-12, 13) for y in range(-12, 13) for z in (0.0, 2.0))]
    regions = [(0.0, 0.0, 1.0, 2.5, 0.5), (-1.25, 1.0, None, 0.25, 0.0), (0.0, 0.0, 1.0, 2.5, 0.5), (2.0, -2.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 9.0, 9.0)]
    want = [i for i, x, y, z in points if any(a is not None and (x - a) ** 2 + (y - b) ** 2 <= max(r, 1e-3) ** 2 and (c is None or z <= c + m) for a, b, c, r, m in regions)]
    got = protected(spark.createDataFrame(points, "i int, x double, y double, z double"),
                    spark.createDataFrame(regions, "x double, y double, z double, radius_m double, z_margin_m double"))
    assert sorted(r.i for r in got.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_all_points_shape_the_hulls(spark):
    """hull_roi builds its hulls from every point, not from one id in four."""
    from sensorlake.operators.spatial import hulls, hull_join
    from sensorlake.queries.base import vec

    v = vec(spark, SF).selectExpr("frame", "id", "label", "x * 100 AS u", "y * 100 AS v")
    rows = lambda d: sorted(map(tuple, d.select("frame", "id", "group_index").collect()))
    over = lambda d: rows(hull_join(v.drop("label"), hulls(d.withColumnRenamed("label", "group_index"), ["frame", "group_index"]), "frame"))
    got = rows(QUERIES["hull_roi"](spark, SF))
    assert got == over(v) and len(got) > len(over(v.where("id % 4 = 0")))


def test_candidate_keys_of_odd_vectors(spark, tmp_path):
    """Small negative, huge, missing and non-finite components read as in the SQL."""
    nan, inf = float("nan"), float("inf")
    vectors = [[-0.00003, 0.00003, -0.0], [0.10625, -0.10625, -0.00005], [1.5e6, -2.5e9, 7654321.5], [1e20, -3e17, 1e15], [nan, inf, -inf], [None, 1.0, 2.0], None]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").selectExpr("*", "1 AS label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = dict(db.sql(ORACLES["candidate_keys"]).fetchall())
    assert dict(map(tuple, QUERIES["candidate_keys"](spark, str(tmp_path)).select("id", "key").collect())) == want
    assert want[0] == "[-0.0, 0.0, -0.0]|[0.0, 0.0, 0.0]" and want[6] is None
