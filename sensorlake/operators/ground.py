"""Ground removal on grid cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.config import Ground
from sensorlake.operators.filters import protected, z_gate
from sensorlake.operators.quantiles import quantiles
from sensorlake.operators.spatial import cell, neighbour_cells


def gridded(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("gx", cell("x", size)).withColumn("gy", cell("y", size))


def ground_cells(points: DataFrame, frame: str, g: Ground = Ground()) -> DataFrame:
    """(frame, gx, gy, n, ground, clearance): a quantile of z, or in sparse cells the minimum."""
    sparse = F.col("n") < g.min_points
    stats = quantiles(gridded(points, g.cell), [frame, "gx", "gy"], {"z": ("z", [0.0, g.quantile])})
    stats = stats.withColumns({"lo": F.col("z")[0], "q": F.col("z")[1]})
    return stats.select(frame, "gx", "gy", "n", F.when(sparse, F.col("lo")).otherwise(F.col("q")).alias("ground"),
                        F.when(sparse, F.lit(g.fallback_clearance)).otherwise(F.lit(g.clearance)).alias("clearance"))


def low_points(points: DataFrame, frame: str, index: str, g: Ground = Ground()) -> DataFrame:
    """Each cell with its representative: the point nearest in height to the cell's ground, the first on a tie."""
    near = gridded(points, g.cell).join(ground_cells(points, frame, g), [frame, "gx", "gy"])
    low = F.min_by(F.struct("x", "y", "z"), F.struct(F.abs(F.col("z") - F.col("ground")), F.col(index), "x", "y", "z")).alias("low")
    return near.groupBy(frame, "gx", "gy").agg(low, F.first("ground").alias("ground"), F.first("clearance").alias("clearance"), F.count("*").alias("n"))


def remove_ground_grid(points: DataFrame, frame: str, g: Ground = Ground(), regions: DataFrame | None = None) -> DataFrame:
    cells = ground_cells(points, frame, g).select(frame, "gx", "gy", (F.col("ground") + F.col("clearance")).alias("__top"))
    kept = gridded(points, g.cell).join(cells, [frame, "gx", "gy"]).where(F.col("z") > F.col("__top")).select(points.columns)
    return kept if regions is None else kept.unionByName(_spared(points, cells, frame, g, regions))


def _spared(points: DataFrame, cells: DataFrame, frame: str, g: Ground, regions: DataFrame) -> DataFrame:
    low = gridded(points, g.cell).join(cells, [frame, "gx", "gy"]).where(F.col("z") <= F.col("__top")).select(points.columns)
    return protected(low, regions)


#: Eigenvalues below this share of the largest count as none: the points lie on a line.
FLAT = 1e-12


def fit_planes(sums: pd.DataFrame) -> pd.DataFrame:
    """Least-squares z = a x + b y + c from sums over the points, minimum norm where they lie on a line; null for fewer than three."""
    n, sx, sy, sz, sxx, sxy, syy, sxz, syz = (sums[c].to_numpy(float) for c in ("n", "sx", "sy", "sz", "sxx", "sxy", "syy", "sxz", "syz"))
    normal = np.stack([np.stack(row, axis=-1) for row in ((sxx, sxy, sx), (sxy, syy, sy), (sx, sy, n))], axis=-2)
    found = (np.linalg.pinv(normal, rcond=FLAT, hermitian=True) @ np.stack([sxz, syz, sz], axis=-1)[..., None])[..., 0]
    found[n < 3] = np.nan
    return pd.DataFrame(found, columns=list("abc"))


def cell_planes(points: DataFrame, frame: str, index: str, g: Ground = Ground()) -> DataFrame:
    """(frame, gx, gy, ground, clearance, a, b, c): planes through the representatives of the cells around, from sums that
    are aggregated by cell; null where fewer than three are there."""
    cells = low_points(points, frame, index, g)
    near = neighbour_cells(cells, frame, g.radius_cells).join(
        cells.select(frame, F.col("gx").alias("nx"), F.col("gy").alias("ny"), "low.x", "low.y", "low.z"), [frame, "nx", "ny"])
    products = {"s" + "".join(p): p for p in ("x", "y", "z", "xx", "xy", "yy", "xz", "yz")}
    sums = near.groupBy(frame, "gx", "gy").agg(F.count("*").alias("n"), *[F.sum(F.col(p[0]) * (F.col(p[1]) if len(p) > 1 else 1.0)).alias(n) for n, p in products.items()])
    plane = F.pandas_udf(fit_planes, "a double, b double, c double")
    planes = sums.select(frame, "gx", "gy", plane(F.struct("n", *products)).alias("p")).select(frame, "gx", "gy", "p.*")
    return cells.select(frame, "gx", "gy", "ground", "clearance").join(planes, [frame, "gx", "gy"], "left")


def remove_ground_plane(points: DataFrame, frame: str, index: str, g: Ground = Ground(), regions: DataFrame | None = None) -> DataFrame:
    """Drops points at most the clearance above their cell's plane (without one: above its ground), but for those in regions."""
    fitted = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")
    base = F.coalesce(F.nanvl(fitted, F.lit(None)), F.col("ground"))
    joined = gridded(points, g.cell).join(cell_planes(points, frame, index, g), [frame, "gx", "gy"])
    high = F.col("z") - base > F.col("clearance")
    kept = joined.where(high).select(points.columns)
    return kept if regions is None else kept.unionByName(protected(joined.where(~high).select(points.columns), regions))


def remove_ground(points: DataFrame, frame: str, index: str, g: Ground = Ground(), regions: DataFrame | None = None) -> DataFrame:
    """The height gate comes before every method; z_threshold is the gate alone."""
    if g.cell <= 0:
        raise ValueError("cell must be positive")
    gated = z_gate(points, *g.z)
    if g.method == "z_threshold":
        return gated
    if g.method == "adaptive_grid":
        return remove_ground_grid(gated, frame, g, regions)
    if g.method == "adaptive_plane":
        return remove_ground_plane(gated, frame, index, g, regions)
    raise ValueError(f"unknown ground method: {g.method}")


def stage_counts(points: DataFrame, frame: str, **stages) -> DataFrame:
    """Counts of points that pass each named condition, in one pass."""
    return points.groupBy(frame).agg(F.count("*").alias("point_count_raw"), *[F.count_if(c).alias(n) for n, c in stages.items()])


def height_profile(points: DataFrame, frame: str, name: str = "z_p10_p50_p90") -> DataFrame:
    return quantiles(points, [frame], {name: ("z", [0.1, 0.5, 0.9])}).drop("n")
