import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorlake.config import Camera
from sensorlake.functions import geo, projection
from sensorlake.functions.records import candidate_key, iso_utc


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


L = F.lit


def test_dms_keeps_sign_of_degrees(spark):
    assert values(spark, geo.dms_to_degrees(L(-22.0), L(30.0), L(0.0)), geo.dms_to_degrees(L(-0.0), L(30.0), L(0.0))) == [-22.5, 0.5]


def test_ecef_golden_and_round_trip(spark):
    assert values(spark, *geo.geodetic_to_ecef(L(22.3), L(114.17), L(10.0))) == pytest.approx([-2417353.1922, 5386395.9900, 2405184.7313], abs=1e-3)
    rows = spark.createDataFrame([(float(a), float(b), 25.0) for a in range(-84, 85, 14) for b in range(-179, 180, 31)], "la double, lo double, h double")
    x = rows.select("*", *[c.alias(n) for c, n in zip(geo.geodetic_to_ecef(F.col("la"), F.col("lo"), F.col("h")), "xyz")])
    for r in geo.with_geodetic(x, ("x", "y", "z"), ("la2", "lo2", "h2")).collect():
        assert (r.la2, r.lo2) == pytest.approx((r.la, r.lo), abs=1e-9) and r.h2 == pytest.approx(r.h, abs=1e-4)


@pytest.mark.parametrize("heading, enu", [(0.0, (0, 1, 0)), (90.0, (1, 0, 0))])
def test_attitude_forward(spark, heading, enu):
    m = geo.attitude(L(0.0), L(0.0), L(heading))
    assert values(spark, *geo.apply(m, (L(1.0), L(0.0), L(0.0)))) == pytest.approx(enu, abs=1e-12)


def test_attitude_is_orthonormal(spark):
    m = geo.attitude(L(3.0), L(-7.0), L(211.0))
    flat = values(spark, *[m[i][j] for i in range(3) for j in range(3)])
    for i in range(3):
        for j in range(3):
            assert sum(flat[3 * i + k] * flat[3 * j + k] for k in range(3)) == pytest.approx(float(i == j), abs=1e-12)


def test_angles_are_not_wrapped(spark):
    assert values(spark, geo.angle_lerp(L(350.0), L(10.0), L(0.5)), geo.angle_lerp(L(10.0), L(350.0), L(0.5))) == [360.0, 0.0]


def test_extrinsics(spark):
    body = values(spark, *geo.lidar_to_body((L(0.0), L(0.0), L(0.0))), *geo.lidar_to_body((L(1.0), L(0.0), L(0.0))))
    assert body == pytest.approx([0.2169, 0, 0.3734, 1.1232, 0, -0.0492], abs=1e-4)
    back = geo.body_to_lidar(geo.lidar_to_body((L(1.0), L(-2.0), L(0.5))))
    assert values(spark, *back) == pytest.approx([1.0, -2.0, 0.5], abs=2e-4)  # the shipped rotation is rounded


def test_projection(spark):
    c = Camera()
    assert values(spark, *projection.fisheye(L(0.1), L(0.2), L(1.0), c)) == pytest.approx([677.376079, 614.865888], abs=1e-5)
    assert values(spark, *projection.fisheye(L(0.1), L(0.2), L(-1.0), c)) == [None, None]
    assert values(spark, *projection.fisheye(L(0.0), L(0.0), L(1.0), c)) == pytest.approx([c.cx, c.cy])
    assert projection.image_size(c) == (1264, 1047)
    assert values(spark, projection.in_image(L(-0.5), L(0.0), c), projection.in_image(L(-1.0), L(0.0), c)) == [True, False]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=3, max_size=3))
def test_rodrigues_keeps_length(spark, r):
    m = geo.rodrigues(*[L(float(v)) for v in r])
    v = values(spark, *geo.apply(m, (L(1.0), L(2.0), L(2.0))))
    assert math.hypot(*v) == pytest.approx(3.0, abs=1e-9)


def test_records(spark):
    assert values(spark, iso_utc(L(0.1239))) == ["1970-01-01T00:00:00.123Z"]
    key = candidate_key((L(0.1235), L(1.0), L(2.0)), (L(1.0), L(1.0), L(1.0)))
    assert values(spark, key, F.bround(L(0.125), 2)) == ["[0.124, 1.0, 2.0]|[1.0, 1.0, 1.0]", 0.12]
