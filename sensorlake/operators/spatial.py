"""Spatial joins on grid cells, convex hulls and gated matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.geo import norm2


def cell(c: Column | str, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("int")


def eps_pairs(points: DataFrame, frame: str, index: str, tolerance: float) -> DataFrame:
    """(frame, a < b, d2) of points of a frame within tolerance, inclusive: an equi-join on 27 neighbour cells."""
    own = points.select(frame, F.col(index).alias("a"), *[F.col(c).alias(f"{c}a") for c in "xyz"], *[cell(c, tolerance).alias(f"g{c}") for c in "xyz"])
    near = points.select(frame, F.col(index).alias("b"), *[F.col(c).alias(f"{c}b") for c in "xyz"], *[cell(c, tolerance).alias(f"h{c}") for c in "xyz"])
    for c in "xyz":
        near = near.withColumn(f"g{c}", F.explode(F.sequence(F.col(f"h{c}") - 1, F.col(f"h{c}") + 1))).drop(f"h{c}")
    d2 = sum((F.col(f"{c}a") - F.col(f"{c}b")) * (F.col(f"{c}a") - F.col(f"{c}b")) for c in "xyz")
    pairs = own.join(near, [frame, "gx", "gy", "gz"]).where(F.col("a") < F.col("b")).withColumn("d2", d2)
    return pairs.where(F.col("d2") <= tolerance * tolerance).select(frame, "a", "b", "d2")


def neighbour_cells(cells: DataFrame, frame: str, radius: int) -> DataFrame:
    """(frame, gx, gy, nx, ny) for all present cells within the Chebyshev radius, itself included."""
    around = cells.select(frame, "gx", "gy")
    for g, n in (("gx", "nx"), ("gy", "ny")):
        around = around.withColumn(n, F.explode(F.sequence(F.col(g) - radius, F.col(g) + radius)))
    present = cells.select(frame, F.col("gx").alias("nx"), F.col("gy").alias("ny"))
    return around.join(present, [frame, "nx", "ny"])


def gated_pairs(candidates: DataFrame, tracks: DataFrame, frame: str, gate: float) -> DataFrame:
    """All (candidate, track) of a frame with planar distance within the gate, on grid cells of that size."""
    c = candidates.withColumn("__gx", cell("x", gate)).withColumn("__gy", cell("y", gate))
    t = tracks.select(frame, "track_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    for axis in "xy":
        t = t.withColumn(f"__g{axis}", F.explode(F.sequence(cell(f"t{axis}", gate) - 1, cell(f"t{axis}", gate) + 1)))
    d = norm2(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    return c.join(t, [frame, "__gx", "__gy"]).withColumn("distance", d).where(F.col("distance") <= gate).drop("__gx", "__gy")


def greedy_matches(pairs: pd.DataFrame) -> pd.DataFrame:
    """One-to-one matches of a frame by rising distance; ties by candidate, then track."""
    pairs = pairs.sort_values(["distance", "candidate_id", "track_id"], kind="stable")
    tracks, taken, keep = set(), set(), []
    for c, t in zip(pairs["candidate_id"], pairs["track_id"], strict=True):
        keep.append(t not in tracks and c not in taken)
        if keep[-1]:
            tracks.add(t)
            taken.add(c)
    return pairs[keep]


def convex_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Vertices in counter-clockwise order (monotone chain), collinear points left out."""
    points = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(points) < 3:
        return np.array(points, dtype=float).reshape(-1, 2)

    def chain(rows):
        out = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]), dtype=float)


def outermost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Without most of the points that lie well inside the quadrilateral of the extreme ones."""
    ends = np.array([x.argmin(), y.argmin(), x.argmax(), y.argmax()])
    inside = np.ones(len(x), dtype=bool)
    for a, b in zip(ends, np.roll(ends, -1), strict=True):
        cross = (x[b] - x[a]) * (y - y[a]) - (y[b] - y[a]) * (x - x[a])
        inside &= cross > 1e-9 * (np.ptp(x) * np.ptp(y))
    return ~inside


#: Vertices that a task holds before it passes them on.
HELD = 200_000


def _task_hulls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, x, y) to the vertices of the hull of each key's rows in the task: the combiner."""
    held: dict[str, np.ndarray] = {}
    size = 0
    for frame in frames:
        codes, keys = pd.factorize(frame["key"])
        order = np.argsort(codes, kind="stable")
        xy = frame[["x", "y"]].to_numpy(float)[order]
        for key, own in zip(keys, np.split(xy, np.flatnonzero(np.diff(codes[order])) + 1), strict=True) if len(xy) else ():
            own = own[outermost(own[:, 0], own[:, 1])]
            if (before := held.get(key)) is not None:
                own = np.concatenate([before, own])
            held[key] = convex_hull(own[:, 0], own[:, 1])
            size += len(held[key]) - (0 if before is None else len(before))
        if size > HELD:
            yield _vertices(held)
            held, size = {}, 0
    yield _vertices(held)


def _vertices(held: dict[str, np.ndarray]) -> pd.DataFrame:
    xy = np.concatenate([*held.values(), np.zeros((0, 2))])
    return pd.DataFrame({"key": np.repeat(np.array(list(held), dtype=object), [len(h) for h in held.values()]), "x": xy[:, 0], "y": xy[:, 1]})


def hulls(points: DataFrame, keys: list[str], x: str = "u", y: str = "v", salts: int = 64) -> DataFrame:
    """(keys, hull array<struct<x,y>>, area, bounds) of each group with a point.

    The hull of hulls is the hull of all: tasks reduce what they read to vertices, parts of a group (by a salt) are reduced
    again, and the last step sees some vertices of at most `salts` parts, so one group may hold all points.  Points with a
    null or non-finite coordinate do not count.
    """

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        h = convex_hull(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))
        return pd.DataFrame({"key": pdf["key"].iloc[0], "x": h[:, 0], "y": h[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h = convex_hull(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))
        area = 0.5 * abs(float(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1)))) if len(h) > 2 else 0.0
        row = {"key": pdf["key"].iloc[0], "hull": [{"x": a, "y": b} for a, b in h.tolist()], "area": area}
        return pd.DataFrame([row | {"x_min": h[:, 0].min(), "x_max": h[:, 0].max(), "y_min": h[:, 1].min(), "y_max": h[:, 1].max()}])

    schema = "key string, x double, y double"
    options = {"ignoreNullFields": "false"}
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = points.select(F.to_json(F.struct(*keys), options).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    some = rows.where(finite("x") & finite("y")).mapInPandas(_task_hulls, schema)
    parts = some.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(salts))).groupBy("key", "salt").applyInPandas(part, schema)
    found = parts.groupBy("key").applyInPandas(whole, "key string, hull array<struct<x:double,y:double>>, area double, x_min double, x_max double, y_min double, y_max double")
    kinds = points.select(*keys).schema
    return found.withColumn("key", F.from_json("key", kinds)).select("key.*", "hull", "area", "x_min", "x_max", "y_min", "y_max")


def inside_hull(hull: Column, u: Column, v: Column) -> Column:
    """Truncated pixel (u, v) lies in the hull of truncated vertices, edges included."""
    a, b = u.cast("int").cast("double"), v.cast("int").cast("double")
    ints = F.transform(hull, lambda p: F.struct(p["x"].cast("int").cast("double").alias("x"), p["y"].cast("int").cast("double").alias("y")))
    shifted = F.concat(F.slice(ints, 2, F.greatest(F.size(ints) - 1, F.lit(0))), F.slice(ints, 1, 1))
    left = lambda e: (e["q"]["x"] - e["p"]["x"]) * (b - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (a - e["p"]["x"]) >= 0
    edges = F.zip_with(ints, shifted, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return (F.size(hull) > 2) & F.forall(edges, left)


def hull_join(points: DataFrame, groups: DataFrame, frame: str) -> DataFrame:
    """points(frame, u, v) with each group of their frame whose hull holds them; bounds are checked first."""
    joined = points.join(groups, frame).where(F.col("u").between(F.floor("x_min"), F.ceil("x_max") + 1) & F.col("v").between(F.floor("y_min"), F.ceil("y_max") + 1))
    return joined.where(inside_hull(F.col("hull"), F.col("u"), F.col("v"))).drop("hull", "area", "x_min", "x_max", "y_min", "y_max")
