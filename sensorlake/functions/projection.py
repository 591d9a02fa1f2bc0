"""Camera projections as Column functions; what is not in front of the camera is null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.config import Camera
from sensorlake.functions import geo


def pinhole(x: Column, y: Column, z: Column, c: Camera, d: tuple[float, float, float, float, float]) -> tuple[Column, Column]:
    """Brown-Conrady distortion k1, k2, p1, p2, k3."""
    k1, k2, p1, p2, k3 = d
    front = F.when(z > 0, z)
    a, b = x / front, y / front
    r2 = a * a + b * b
    radial = 1.0 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    u = a * radial + 2.0 * p1 * a * b + p2 * (r2 + 2.0 * a * a)
    v = b * radial + p1 * (r2 + 2.0 * b * b) + 2.0 * p2 * a * b
    return c.fx * u + c.cx, c.fy * v + c.cy


def fisheye(x: Column, y: Column, z: Column, c: Camera) -> tuple[Column, Column]:
    """Equidistant model: theta (1 + k1 theta^2 + ... + k4 theta^8)."""
    front = F.when(z > 0, z)
    a, b = x / front, y / front
    r = F.sqrt(a * a + b * b)
    t = F.atan(r)
    t2 = t * t
    k1, k2, k3, k4 = c.k
    bent = t * (1.0 + k1 * t2 + k2 * t2 * t2 + k3 * t2 * t2 * t2 + k4 * t2 * t2 * t2 * t2)
    scale = F.when(r > 0, bent / r).otherwise(F.when(r.isNotNull(), F.lit(1.0)))
    return c.fx * a * scale + c.cx, c.fy * b * scale + c.cy


def with_fisheye(df: DataFrame, v: geo.Vector, names: tuple[str, str], c: Camera) -> DataFrame:
    """df with the fisheye pixels of v under two names.

    Every step is a column, and the pixels come out of an array of one: filters on them stay above it, where pushed down
    they would repeat the whole formula in generated code too large for the compiler.
    """
    x, y, z = v
    k1, k2, k3, k4 = c.k
    front = F.when(z > 0, z)
    out = df.select("*", (x / front).alias("__a"), (y / front).alias("__b"))
    out = out.withColumn("__r", F.sqrt(F.col("__a") * F.col("__a") + F.col("__b") * F.col("__b"))).withColumn("__t", F.atan("__r"))
    t, t2, r = F.col("__t"), F.col("__t2"), F.col("__r")
    out = out.withColumn("__t2", t * t)
    out = out.withColumn("__bent", t * (1.0 + k1 * t2 + k2 * t2 * t2 + k3 * t2 * t2 * t2 + k4 * t2 * t2 * t2 * t2))
    out = out.withColumn("__scale", F.when(r > 0, F.col("__bent") / r).otherwise(F.when(r.isNotNull(), F.lit(1.0))))
    pixels = (c.fx * F.col("__a") * F.col("__scale") + c.cx, c.fy * F.col("__b") * F.col("__scale") + c.cy)
    return out.select(*df.columns, F.inline(F.array(F.struct(*[p.alias(n) for p, n in zip(pixels, names, strict=True)]))))


def lidar_to_camera(v: geo.Vector, c: Camera) -> geo.Vector:
    return geo.rigid_inverse(c.r_lidar_camera, c.t_lidar_camera, v)


def image_size(c: Camera) -> tuple[int, int]:
    """Width and height taken from the principal point."""
    return int(2 * c.cx + 1), int(2 * c.cy + 1)


def in_image(u: Column, v: Column, c: Camera) -> Column:
    """Pixels truncated toward zero lie in the image."""
    w, h = image_size(c)
    a, b = u.cast("int"), v.cast("int")
    return (a >= 0) & (a < w) & (b >= 0) & (b < h)


def undistorted(c: Camera, steps: int = 10):
    """Arrow function of pixel columns (u, v) to normalised x and y: the fisheye polynomial inverted by Newton's method."""

    def invert(u: pd.Series, v: pd.Series) -> pd.DataFrame:
        a, b = (u.to_numpy(float) - c.cx) / c.fx, (v.to_numpy(float) - c.cy) / c.fy
        bent = np.minimum(np.hypot(a, b), np.pi / 2)
        k = np.array([1.0, *c.k])
        powers = np.arange(5) * 2
        t = bent.copy()
        for _ in range(steps):
            value = (k[:, None] * t ** (powers[:, None] + 1)).sum(0)
            slope = (k[:, None] * (powers[:, None] + 1) * t ** powers[:, None]).sum(0)
            t = t - (value - bent) / slope
        scale = np.divide(np.tan(t), bent, out=np.ones_like(t), where=bent > 0)
        return pd.DataFrame({"x": a * scale, "y": b * scale})

    return F.pandas_udf(invert, "x double, y double", F.PandasUDFType.SCALAR)
