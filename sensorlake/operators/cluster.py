"""Euclidean clustering, cluster statistics and person candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.config import Clustering, Person
from sensorlake.operators.components import connected_components
from sensorlake.operators.filters import depth, person_like, width
from sensorlake.operators.quantiles import quantiles
from sensorlake.operators.spatial import eps_pairs


def eps_clusters(points: DataFrame, frame: str, index: str, c: Clustering = Clustering()) -> DataFrame:
    """points with cluster_id: connected components of the points of a frame within the tolerance, those of
    fitting size numbered from 0 by their smallest index; other points are dropped.

    Distributed: links from a grid join, then label propagation; a frame of any size is many tasks.
    """
    if c.tolerance <= 0:
        raise ValueError("tolerance must be positive")
    links = eps_pairs(points, frame, index, c.tolerance)
    node = lambda i: F.struct(F.col(frame).alias("f"), F.col(i).alias("i"))
    found = connected_components(links.select(node("a").alias("a"), node("b").alias("b")))
    roots = found.select(F.col("node.f").alias(frame), F.col("node.i").alias(index), F.col("component.i").alias("__root"))
    rooted = points.join(roots, [frame, index], "left").withColumn("__root", F.coalesce("__root", index))
    sizes = rooted.groupBy(frame, "__root").agg(F.count("*").alias("__n")).where(F.col("__n").between(c.min_points, c.max_points))
    ids = sizes.withColumn("cluster_id", (F.row_number().over(Window.partitionBy(frame).orderBy("__root")) - 1).cast("int"))
    return rooted.join(ids, [frame, "__root"]).select(*points.columns, "cluster_id")


def cluster_stats(clusters: DataFrame, frame: str) -> DataFrame:
    """Count, centroid, bounds and size of each cluster."""
    aggregates = [F.count("*").alias("point_count")]
    for c in "xyz":
        aggregates += [F.avg(c).alias(f"centroid_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), (F.max(c) - F.min(c)).alias(f"size_{c}")]
    return clusters.groupBy(frame, "cluster_id").agg(*aggregates)


def centroids(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, points, x, y, z, x_min, x_max, ...): number, mean and bounds of the points of each key."""
    bounds = [f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy(*keys).agg(F.count("*").alias("points"), *[F.avg(c).alias(c) for c in "xyz"], *bounds)


def footpoints(clusters: DataFrame, stats: DataFrame, frame: str) -> DataFrame:
    """Median xy and minimum z of the lowest band of each cluster."""
    low = stats.select(frame, "cluster_id", (F.col("min_z") + F.greatest(F.lit(0.15), 0.2 * (F.col("max_z") - F.col("min_z")))).alias("__top"))
    band = clusters.join(low, [frame, "cluster_id"]).where(F.col("z") <= F.col("__top"))
    foot = quantiles(band, [frame, "cluster_id"], {"foot_x": ("x", [0.5]), "foot_y": ("y", [0.5]), "foot_z": ("z", [0.0])})
    return foot.select(frame, "cluster_id", *[F.col(c)[0].alias(c) for c in ("foot_x", "foot_y", "foot_z")])


def candidate_score(p: Person = Person()) -> Column:
    """Weighted closeness of height, width, depth and count to the preferred ones, and verticality."""
    close = lambda v, best: 1.0 / (1.0 + F.abs(v - best))
    count = 1.0 / (1.0 + F.abs(F.col("point_count") - p.points_preferred) / max(p.points_preferred, 1.0))
    upright = F.least(F.col("size_z") / F.greatest(width(), F.lit(1e-3)), F.lit(4.0)) / 4.0
    return (0.4 * close(F.col("size_z"), p.height_preferred) + 0.2 * close(width(), p.width_preferred)
            + 0.1 * close(depth(), p.depth_preferred) + 0.1 * count + 0.2 * upright)


def candidates(clusters: DataFrame, frame: str, p: Person = Person()) -> DataFrame:
    """Person-like clusters with footpoint and score."""
    stats = cluster_stats(clusters, frame)
    good = stats.where(person_like(p))
    return good.join(footpoints(clusters, stats, frame), [frame, "cluster_id"]).withColumn("score", candidate_score(p))


def merge_stacked(stats: pd.DataFrame, c: Clustering = Clustering()) -> pd.Series:
    """Merged cluster id of each cluster of one frame: a scan over the clusters in id order joins later ones whose
    xy centres and z ranges are close to the growing base, again and again until nothing changes."""
    boxes = [[set([i]), row] for i, row in enumerate(stats[["min_x", "min_y", "min_z", "max_x", "max_y", "max_z", "point_count"]].to_numpy(float))]
    merged = True
    while merged:
        merged, out, waiting = False, [], boxes
        while waiting:
            (members, box), rest = waiting[0], []
            for own, other in waiting[1:]:
                shift = np.hypot(*(0.5 * (box[:2] + box[3:5]) - 0.5 * (other[:2] + other[3:5])))
                gap = max(other[2] - box[5], box[2] - other[5], 0.0)
                if shift <= c.merge_xy and gap <= c.merge_z_gap and box[6] + other[6] <= c.merge_max_points:
                    members, merged = members | own, True
                    box = np.concatenate([np.minimum(box[:3], other[:3]), np.maximum(box[3:6], other[3:6]), [box[6] + other[6]]])
                else:
                    rest.append([own, other])
            out.append([members, box])
            waiting = rest
        boxes = out
    place = {i: k for k, (members, _) in enumerate(boxes) for i in members}
    return pd.Series([place[i] for i in range(len(stats))], index=stats.index)


def merge_clusters(clusters: DataFrame, frame: str, c: Clustering = Clustering()) -> DataFrame:
    """clusters with merged ids.  Only the clusters' boxes (a frame's few) meet in one task, never its points."""
    stats = cluster_stats(clusters, frame)
    kind = clusters.schema[frame].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster_id", ignore_index=True)
        return pd.DataFrame({frame: pdf[frame], "cluster_id": pdf["cluster_id"], "merged_id": merge_stacked(pdf, c).astype("int32")})

    ids = stats.groupBy(frame).applyInPandas(run, f"{frame} {kind}, cluster_id int, merged_id int")
    return clusters.join(ids, [frame, "cluster_id"]).withColumn("cluster_id", F.col("merged_id")).drop("merged_id")
