"""Geometry and geodesy as Column functions; vectors are tuples of three columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.config import Extrinsics

#: WGS-84 (fixed values).
A, E2 = 6378137.0, 6.69437999014e-3
Vector = tuple[Column, Column, Column]


def dms_to_degrees(deg: Column, minutes: Column, seconds: Column) -> Column:
    """The sign is that of the degrees; -0 counts as positive."""
    return F.when(deg < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * (F.abs(deg) + minutes / 60.0 + seconds / 3600.0)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def angle_lerp(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter arc; the result is not wrapped."""
    return a + (F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0) * t


def apply(matrix, v: Vector) -> Vector:
    """matrix (3x3 of numbers or columns) times v."""
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in matrix)


def add(v: Vector, t) -> Vector:
    return tuple(a + b for a, b in zip(v, t, strict=True))


def transposed(matrix):
    return tuple(zip(*matrix, strict=True))


def rigid(matrix, t, v: Vector) -> Vector:
    return add(apply(matrix, v), t)


def rigid_inverse(matrix, t, v: Vector) -> Vector:
    return apply(transposed(matrix), tuple(a - b for a, b in zip(v, t, strict=True)))


def rodrigues(rx: Column, ry: Column, rz: Column):
    """Rotation matrix of a rotation vector; the identity for the zero vector."""
    theta = F.sqrt(rx * rx + ry * ry + rz * rz)
    unit = F.when(theta > 0, theta).otherwise(F.lit(1.0))
    k = tuple(c / unit for c in (rx, ry, rz))
    c, s = F.cos(theta), F.sin(theta)
    cross = ((F.lit(0.0), -k[2], k[1]), (k[2], F.lit(0.0), -k[0]), (-k[1], k[0], F.lit(0.0)))
    return tuple(tuple((c if i == j else F.lit(0.0)) + (1.0 - c) * k[i] * k[j] + s * cross[i][j] for j in range(3)) for i in range(3))


def attitude(roll: Column, pitch: Column, heading: Column):
    """ENU from vehicle FLU, for degrees of roll, pitch and clockwise heading."""
    r, p, a = F.radians(roll), F.radians(pitch), F.radians(heading)
    cr, sr, cp, sp, ca, sa = F.cos(r), F.sin(r), F.cos(p), F.sin(p), F.cos(a), F.sin(a)
    right = (cr * ca + sr * sp * sa, sr * sp * ca - cr * sa, -sr * cp)
    forward = (cp * sa, cp * ca, sp)
    up = (sr * ca - cr * sp * sa, -sr * sa - cr * sp * ca, cr * cp)
    return tuple((forward[i], -right[i], up[i]) for i in range(3))


def geodetic_to_ecef(lat: Column, lon: Column, h: Column) -> Vector:
    la, lo = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1.0 - E2 * F.sin(la) * F.sin(la))
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1.0 - E2) + h) * F.sin(la)


def enu_from_ecef(lat: Column, lon: Column):
    la, lo = F.radians(lat), F.radians(lon)
    return ((-F.sin(lo), F.cos(lo), F.lit(0.0)),
            (-F.sin(la) * F.cos(lo), -F.sin(la) * F.sin(lo), F.cos(la)),
            (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)))


def with_geodetic(df: DataFrame, xyz: tuple[str, str, str], names: tuple[str, str, str]) -> DataFrame:
    """Adds latitude, longitude (degrees) and height of ECEF columns; six fixed-point steps, one projection each."""
    x, y, z = (F.col(c) for c in xyz)
    columns = df.columns
    out = df.withColumn("__p", F.hypot(x, y)).withColumn("__la", F.atan2(z, F.hypot(x, y) * (1.0 - E2)))
    radius = A / F.sqrt(1.0 - E2 * F.sin("__la") * F.sin("__la"))
    for _ in range(6):
        out = out.withColumn("__la", F.atan2(z + E2 * radius * F.sin("__la"), F.col("__p")))
    height = F.col("__p") / F.greatest(F.cos("__la"), F.lit(1e-12)) - radius
    values = (F.degrees("__la"), F.degrees(F.atan2(y, x)), height)
    return out.select(*[c for c in columns if c not in names], *[v.alias(n) for v, n in zip(values, names, strict=True)])


def span_from_lidar(e: Extrinsics = Extrinsics()):
    """Rotation and translation of the extrinsic chain, composed on the driver."""
    rb, tb, rs, ts = (np.array(v, dtype=float) for v in (e.r_base_lidar, e.t_base_lidar, e.r_span_base, e.t_span_base))
    return (rs @ rb).tolist(), (rs @ tb + ts).tolist()


def lidar_to_body(v: Vector, e: Extrinsics = Extrinsics()) -> Vector:
    """Lidar point to vehicle FLU about the span origin."""
    right, forward, up = rigid(*span_from_lidar(e), v)
    return forward, -right, up


def body_to_lidar(v: Vector, e: Extrinsics = Extrinsics()) -> Vector:
    return rigid_inverse(*span_from_lidar(e), (-v[1], v[0], v[2]))


def norm2(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def with_between_poses(df: DataFrame, v: Vector, here: tuple[Column, ...], there: tuple[Column, ...], names: tuple[str, str, str],
                       e: Extrinsics = Extrinsics()) -> DataFrame:
    """df with the lidar points v, seen at pose here, as lidar coordinates at pose there; poses: lat, lon, height, roll,
    pitch, heading.  Every step is a column, so that the generated code stays small."""
    staged = lambda table, values, name: table.select("*", *[c.alias(f"__{name}{i}") for i, c in enumerate(values)])
    at = lambda name: tuple(F.col(f"__{name}{i}") for i in range(3))
    out = staged(df, here, "h")
    out = staged(out, there, "t")
    here, there = ([F.col(f"__{n}{i}") for i in range(6)] for n in "ht")
    out = staged(out, lidar_to_body(v, e), "body")
    out = staged(out, apply(attitude(*here[3:]), at("body")), "enu")
    out = staged(out, add(geodetic_to_ecef(*here[:3]), apply(transposed(enu_from_ecef(*here[:2])), at("enu"))), "ecef")
    out = staged(out, [a - b for a, b in zip(at("ecef"), geodetic_to_ecef(*there[:3]), strict=True)], "gap")
    out = staged(out, apply(enu_from_ecef(*there[:2]), at("gap")), "back")
    out = staged(out, apply(transposed(attitude(*there[3:])), at("back")), "flu")
    return out.select(*df.columns, *[c.alias(n) for c, n in zip(body_to_lidar(at("flu"), e), names, strict=True)])


def point3(v: Column) -> Column:
    """A point as an array of three numbers; anything else is an error of its row."""
    return F.when(F.size(v) == 3, v.cast("array<double>")).otherwise(F.raise_error(F.lit("a point has three coordinates")).cast("array<double>"))


def rotation3(m) -> tuple:
    """A 3 x 3 rotation from a configuration, checked on the driver."""
    found = np.asarray(m, dtype=float)
    if found.shape != (3, 3):
        raise ValueError(f"a rotation has 3 x 3 numbers, not {found.shape}")
    return tuple(map(tuple, found.tolist()))


def translation3(t) -> tuple:
    found = np.asarray(t, dtype=float).reshape(-1)
    if found.size != 3:
        raise ValueError(f"a translation has three numbers, not {found.size}")
    return tuple(found.tolist())


def extrinsics_from(mapping) -> Extrinsics:
    """Extrinsics with the entries of a configuration; what is malformed keeps its default."""
    found = {}
    for name, parse in (("r_base_lidar", rotation3), ("t_base_lidar", translation3), ("r_span_base", rotation3), ("t_span_base", translation3)):
        try:
            found[name] = parse(mapping[name])
        except (KeyError, TypeError, ValueError):
            continue
    return Extrinsics(**found)
