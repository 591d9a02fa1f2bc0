from pyspark.sql import functions as F

from sensorlake.operators.raster import raster, scanlines


def test_the_point_in_front_and_rims(spark):
    rows = [(1, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 2.5), (1, 0.01, 0.0, -1.0), (1, 50.0, -50.0, 0.0), (2, 0.0, 0.0, None), (2, float("nan"), 0.0, 1.0), (2, -1.0, 1.0, 9.0)]
    points = spark.createDataFrame(rows, "frame long, x double, y double, z double")
    args = (["frame"], (-1.0, 1.0), (-1.0, 1.0), (11, 11), (-1.0, 3.0))
    got = {(r["frame"], r["px"], r["py"]): r for r in raster(points, *args).collect()}
    assert set(got) == {(1, 5, 5), (1, 10, 10), (2, 0, 0)}
    assert got[1, 5, 5]["points"] == 3 and got[1, 5, 5]["z"] == 2.5 and (got[2, 0, 0]["b"], got[2, 0, 0]["g"], got[2, 0, 0]["r"]) == (0, 0, 255)
    below = {(r["px"], r["py"]): r["z"] for r in raster(points.where("frame = 1"), *args, depth=-F.col("z"), clip=False).collect()}
    assert below == {(5, 5): -1.0}
    lines = {(r["frame"], r["py"]): bytes.fromhex(r["hex"]) for r in scanlines(raster(points, *args), ["frame"], (11, 11), (9, 8, 7)).collect()}
    assert set(lines) == {(1, 5), (1, 10), (2, 0)} and all(len(v) == 33 for v in lines.values())
    assert lines[2, 0] == bytes([0, 0, 255]) + bytes([9, 8, 7]) * 10
    assert raster(points.where("false"), *args).collect() == []
