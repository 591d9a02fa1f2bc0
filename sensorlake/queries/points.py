"""Queries on point clouds: regions, ground, clusters, matching."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sensorlake.config import Clustering, EgoBox, Ground, LocalRoi, Motion, Person, Roi, Tracker
from sensorlake.functions.geo import norm2
from sensorlake.functions.records import canvas, candidate_key, height_colour, rounded
from sensorlake.operators import cluster, filters, ground, markers, raster, segments, spatial, trackers
from sensorlake.queries.base import PTS, VEC, pts, query, r, vec

KEEP = ["frame", "point_index", "x", "y", "z"]
XYZ = f"{r('x')} AS x, {r('y')} AS y, {r('z')} AS z"
#: Clearances between the two decimals of the stand-in heights, so that no comparison is a tie.
GRID = Ground(cell=1.0, clearance=0.0703, fallback_clearance=0.1103, z=(float("-inf"), float("inf")))
WIDE = Clustering(tolerance=0.45, min_points=1, max_points=5000)
PERSON = Person(min_points=2, height=(0.01, 6.0), width=(0.01, 6.0), depth=(0.0, 6.0))


def _points(df):
    return df.select("frame", "point_index", *rounded({c: F.col(c) for c in "xyz"}))


def _filtered(where: str) -> str:
    return f"WITH {PTS} SELECT frame, point_index, {XYZ} FROM pts WHERE {where}"


@query(_filtered("x BETWEEN -4 AND 4 AND y BETWEEN -5 AND 5 AND z BETWEEN -1.5 AND 2.0"))
def roi_box(spark, sf_dir):
    return _points(filters.region_of_interest(pts(spark, sf_dir), "box", Roi(x=(-4, 4), y=(-5, 5), z=(-1.5, 2.0))))


ANNULUS = "sqrt(x * x + y * y) BETWEEN 0.5 AND 10.0 AND z BETWEEN -1.5 AND 3.0"


@query(_filtered(ANNULUS))
def roi_annulus(spark, sf_dir):
    return _points(filters.region_of_interest(pts(spark, sf_dir), "circle"))


@query(_filtered("NOT (x BETWEEN -2.5 AND 1.5 AND y BETWEEN -1.2 AND 1.2 AND z BETWEEN -2.0 AND 2.0)"))
def ego_filter(spark, sf_dir):
    return _points(filters.without_ego(pts(spark, sf_dir), EgoBox(enabled=True)))


@query(_filtered("z BETWEEN 0.12 AND 3.0"))
def z_threshold(spark, sf_dir):
    return _points(ground.remove_ground(pts(spark, sf_dir), "frame", "point_index", Ground(method="z_threshold")))


@query(f"WITH {PTS}, q AS (SELECT CAST(s_suppkey % 9 - 4 AS DOUBLE) AS rx, CAST(s_suppkey % 17 - 8 AS DOUBLE) AS ry, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 3 AS DOUBLE) END AS rz FROM supplier) "
       f"SELECT frame, point_index, {XYZ} FROM pts WHERE EXISTS (SELECT 1 FROM q WHERE (x - rx) * (x - rx) + (y - ry) * (y - ry) <= 0.6 * 0.6 AND (rz IS NULL OR z <= rz + 0.7))")
def protect_regions(spark, sf_dir):
    return _points(filters.protected(pts(spark, sf_dir), _regions(spark, sf_dir)))


def _regions(spark, sf_dir):
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        (k % 9 - 4).cast("double").alias("x"), (k % 17 - 8).cast("double").alias("y"), F.when(k % 3 > 0, (k % 3).cast("double")).alias("z"),
        F.lit(0.6).alias("radius_m"), F.lit(0.7).alias("z_margin_m"))


STAGES = f"count(*) AS point_count_raw, count(*) FILTER (WHERE {ANNULUS}) AS after_roi, count(*) FILTER (WHERE {ANNULUS} AND z > 0.12) AS after_ground"


def _stages(spark, sf_dir):
    roi = (norm2(F.col("x"), F.col("y")).between(0.5, 10.0)) & F.col("z").between(-1.5, 3.0)
    return ground.stage_counts(pts(spark, sf_dir), "frame", after_roi=roi, after_ground=roi & (F.col("z") > 0.12))


@query(f"WITH {PTS} SELECT frame, {STAGES} FROM pts GROUP BY frame")
def stage_counts(spark, sf_dir):
    return _stages(spark, sf_dir)


@query(f"WITH {PTS}, c AS (SELECT frame, {STAGES} FROM pts GROUP BY frame) SELECT frame, coalesce({r('after_ground / nullif(after_roi, 0)')}, 0) AS keep_ratio FROM c")
def keep_ratio(spark, sf_dir):
    return _stages(spark, sf_dir).select("frame", F.coalesce(*rounded({"k": F.try_divide("after_ground", "after_roi")}), F.lit(0.0)).alias("keep_ratio"))


@query(f"WITH {PTS} SELECT frame, {r('quantile_cont(z, 0.1)', 4)} AS p10, {r('quantile_cont(z, 0.5)', 4)} AS p50, {r('quantile_cont(z, 0.9)', 4)} AS p90 FROM pts GROUP BY frame")
def z_percentiles(spark, sf_dir):
    p = ground.height_profile(pts(spark, sf_dir), "frame", "p")
    return p.select("frame", *rounded({n: F.col("p")[i] for i, n in enumerate(("p10", "p50", "p90"))}, 4))


CELLS = (f"{PTS}, k AS (SELECT *, CAST(floor(x / 1.0) AS INTEGER) AS gx, CAST(floor(y / 1.0) AS INTEGER) AS gy FROM pts), "
         "cells AS (SELECT frame, gx, gy, count(*) AS n, CASE WHEN count(*) < 6 THEN min(z) ELSE quantile_cont(z, 0.12) END AS ground, "
         "CASE WHEN count(*) < 6 THEN CAST(0.1103 AS DOUBLE) ELSE CAST(0.0703 AS DOUBLE) END AS clearance FROM k GROUP BY frame, gx, gy)")


@query(f"WITH {CELLS} SELECT frame, gx, gy, n, {r('ground')} AS ground, clearance FROM cells")
def ground_cells(spark, sf_dir):
    return ground.ground_cells(pts(spark, sf_dir), "frame", GRID).select("frame", "gx", "gy", "n", *rounded({"ground": F.col("ground")}), "clearance")


@query(f"WITH {CELLS} SELECT frame, gx, gy, {r('first(x ORDER BY abs(z - ground), point_index, x, y, z)')} AS x, {r('first(y ORDER BY abs(z - ground), point_index, x, y, z)')} AS y, "
       f"{r('first(z ORDER BY abs(z - ground), point_index, x, y, z)')} AS z FROM k JOIN cells USING (frame, gx, gy) GROUP BY frame, gx, gy")
def ground_low_points(spark, sf_dir):
    return ground.low_points(pts(spark, sf_dir), "frame", "point_index", GRID).select("frame", "gx", "gy", *rounded({c: F.col("low")[c] for c in "xyz"}))


@query(f"WITH {CELLS} SELECT frame, point_index, {XYZ} FROM k JOIN cells USING (frame, gx, gy) WHERE z > ground + clearance")
def ground_adaptive_grid(spark, sf_dir):
    return _points(ground.remove_ground(pts(spark, sf_dir), "frame", "point_index", GRID))


GATED = CELLS.replace("FROM pts)", "FROM pts WHERE z BETWEEN 0.31 AND 2.05)", 1)


@query(f"WITH {GATED}, q AS (SELECT CAST(s_suppkey % 9 - 4 AS DOUBLE) AS rx, CAST(s_suppkey % 17 - 8 AS DOUBLE) AS ry, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 3 AS DOUBLE) END AS rz FROM supplier) "
       f"SELECT frame, point_index, {XYZ} FROM k JOIN cells USING (frame, gx, gy) WHERE z > ground + clearance OR EXISTS (SELECT 1 FROM q WHERE (x - rx) * (x - rx) + (y - ry) * (y - ry) <= 0.6 * 0.6 AND (rz IS NULL OR z <= rz + 0.7))")
def ground_gated_grid(spark, sf_dir):
    """Height gate, then the grid method with protected regions."""
    return _points(ground.remove_ground(pts(spark, sf_dir), "frame", "point_index", replace(GRID, z=(0.31, 2.05)), _regions(spark, sf_dir)))


@query(f"WITH {PTS}, s AS (SELECT n_nationkey AS frame, n_regionkey - 2.0 AS sx, n_regionkey - 1.0 AS sy FROM nation) SELECT frame, point_index, {XYZ} FROM pts LEFT JOIN s USING (frame) "
       "WHERE sx IS NULL OR (x BETWEEN sx - 2.5 AND sx + 2.5 AND y BETWEEN sy - 2.5 AND sy + 2.5)")
def crop_state(spark, sf_dir):
    """Nations as the frames that have a state."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    states = n.select(F.col("n_nationkey").alias("frame"), (F.col("n_regionkey") - 2.0).alias("x"), (F.col("n_regionkey") - 1.0).alias("y"))
    return _points(filters.crop_around(pts(spark, sf_dir), states, "frame"))


@query()
def ground_adaptive_plane(spark, sf_dir):
    return _points(ground.remove_ground(pts(spark, sf_dir), "frame", "point_index", replace(GRID, method="adaptive_plane")))


@query(f"WITH {CELLS} SELECT a.frame, a.gx, a.gy, b.gx AS nx, b.gy AS ny FROM cells a JOIN cells b ON a.frame = b.frame AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1")
def neighbor_cells(spark, sf_dir):
    cells = ground.ground_cells(pts(spark, sf_dir), "frame", GRID)
    return spatial.neighbour_cells(cells, "frame", 1).select("frame", "gx", "gy", "nx", "ny")


D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
PAIRS = f"pairs AS (SELECT a.frame, a.id AS a, b.id AS b, {D2} AS d2 FROM vec a JOIN vec b ON a.frame = b.frame AND a.id < b.id WHERE {D2} <= 0.45 * 0.45)"


@query(f"WITH {VEC}, {PAIRS} SELECT frame, a, b, {r('d2')} AS d2 FROM pairs")
def eps_pairs(spark, sf_dir):
    return spatial.eps_pairs(vec(spark, sf_dir), "frame", "id", 0.45).select("frame", "a", "b", *rounded({"d2": F.col("d2")}))


CLUSTERS = (f"WITH RECURSIVE {VEC}, {PAIRS}, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach(a, b) AS (SELECT id, id FROM vec UNION SELECT t.a, e.b FROM reach t JOIN e ON t.b = e.a), "
            "root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a), ids AS (SELECT frame, root, CAST(row_number() OVER (PARTITION BY frame ORDER BY root) - 1 AS INTEGER) AS cluster_id FROM (SELECT DISTINCT frame, root FROM root JOIN vec USING (id))), "
            "c AS (SELECT v.*, cluster_id FROM vec v JOIN root USING (id) JOIN ids USING (frame, root)), "
            "st AS (SELECT frame, cluster_id, count(*) AS point_count, avg(x) AS centroid_x, avg(y) AS centroid_y, avg(z) AS centroid_z, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, "
            "max(x) - min(x) AS size_x, max(y) - min(y) AS size_y, max(z) - min(z) AS size_z FROM c GROUP BY frame, cluster_id), "
            "ft AS (SELECT frame, cluster_id, median(x) AS foot_x, median(y) AS foot_y, min(z) AS foot_z FROM c JOIN st USING (frame, cluster_id) WHERE z <= min_z + greatest(0.15, 0.2 * (max_z - min_z)) GROUP BY frame, cluster_id)")


def _clusters(spark, sf_dir):
    return cluster.eps_clusters(vec(spark, sf_dir), "frame", "id", WIDE)


@query(f"{CLUSTERS} SELECT frame, id, cluster_id FROM c")
def eps_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).select("frame", "id", "cluster_id")


@query(f"{CLUSTERS} SELECT frame, cluster_id, point_count, {r('centroid_x', 4)} AS centroid_x, {r('centroid_z', 4)} AS centroid_z, {r('min_y')} AS min_y, {r('max_z')} AS max_z, {r('size_x')} AS size_x FROM st")
def cluster_stats(spark, sf_dir):
    s = cluster.cluster_stats(_clusters(spark, sf_dir), "frame")
    return s.select("frame", "cluster_id", "point_count", *rounded({c: F.col(c) for c in ("centroid_x", "centroid_z")}, 4), *rounded({c: F.col(c) for c in ("min_y", "max_z", "size_x")}))


@query(f"{CLUSTERS} SELECT frame, cluster_id, {r('foot_x')} AS foot_x, {r('foot_y')} AS foot_y, {r('foot_z')} AS foot_z FROM ft")
def cluster_footpoints(spark, sf_dir):
    c = _clusters(spark, sf_dir)
    return cluster.footpoints(c, cluster.cluster_stats(c, "frame"), "frame").select("frame", "cluster_id", *rounded({f"foot_{v}": F.col(f"foot_{v}") for v in "xyz"}))


SCORE = ("0.4 * (1.0 / (1.0 + abs(size_z - 1.6))) + 0.2 * (1.0 / (1.0 + abs(greatest(size_x, size_y) - 0.7))) + 0.1 * (1.0 / (1.0 + abs(least(size_x, size_y) - 0.6))) "
         "+ 0.1 * (1.0 / (1.0 + abs(point_count - 80.0) / 80.0)) + 0.2 * (least(size_z / greatest(greatest(size_x, size_y), 1e-3), 4.0) / 4.0)")
GOOD = "point_count >= 2 AND size_z BETWEEN 0.01 AND 6.0 AND greatest(size_x, size_y) BETWEEN 0.01 AND 6.0 AND least(size_x, size_y) BETWEEN 0.0 AND 6.0"


@query(f"{CLUSTERS} SELECT frame, cluster_id, {r(SCORE)} AS score FROM st")
def cluster_scores(spark, sf_dir):
    s = cluster.cluster_stats(_clusters(spark, sf_dir), "frame").withColumn("score", cluster.candidate_score())
    return s.select("frame", "cluster_id", *rounded({"score": F.col("score")}))


@query(f"{CLUSTERS} SELECT frame, cluster_id, point_count, {r('foot_x')} AS foot_x, {r(SCORE)} AS score FROM st JOIN ft USING (frame, cluster_id) WHERE {GOOD}")
def person_filter(spark, sf_dir):
    return cluster.candidates(_clusters(spark, sf_dir), "frame", PERSON).select("frame", "cluster_id", "point_count", *rounded({"foot_x": F.col("foot_x"), "score": F.col("score")}))


@query(f"{CLUSTERS}, sized AS (SELECT frame, cluster_id, row_number() OVER (PARTITION BY frame ORDER BY point_count DESC, cluster_id) AS nth, point_count FROM st) SELECT frame, cluster_id, point_count FROM sized WHERE nth = 1 AND point_count >= 3")
def person_or_largest(spark, sf_dir):
    strict = replace(PERSON, height=(50.0, 60.0), min_points=2)
    s = filters.person_filter_or_largest(cluster.cluster_stats(_clusters(spark, sf_dir), "frame"), "frame", strict)
    return s.select("frame", "cluster_id", "point_count")


@query(f"{CLUSTERS} SELECT frame, cluster_id, count(*) AS members FROM c GROUP BY frame, cluster_id HAVING count(*) BETWEEN 2 AND 5000")
def cluster_ids(spark, sf_dir):
    return _clusters(spark, sf_dir).groupBy("frame", "cluster_id").agg(F.count("*").alias("members")).where("members BETWEEN 2 AND 5000")


@query()
def cluster_merge(spark, sf_dir):
    return cluster.merge_clusters(_clusters(spark, sf_dir), "frame").select("frame", "id", "cluster_id")


GATE = 0.8
TRACKS = "t AS (SELECT frame, id AS track_id, x + 0.25 AS tx, y - 0.25 AS ty, z AS tz FROM vec WHERE id % 5 = 0), cand AS (SELECT frame, id AS candidate_id, x, y, z, label FROM vec WHERE id % 5 <> 0)"
GATED_PAIRS = f"p AS (SELECT *, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS distance FROM cand JOIN t USING (frame) WHERE sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) <= {GATE})"


def _gated(spark, sf_dir):
    v = vec(spark, sf_dir)
    tracks = v.where("id % 5 = 0").select("frame", F.col("id").alias("track_id"), (F.col("x") + 0.25).alias("x"), (F.col("y") - 0.25).alias("y"))
    cand = v.where("id % 5 <> 0").select("frame", F.col("id").alias("candidate_id"), "x", "y", "z", "label")
    return spatial.gated_pairs(cand, tracks, "frame", GATE)


@query(f"WITH {VEC}, {TRACKS}, {GATED_PAIRS} SELECT frame, candidate_id, track_id, {r('distance')} AS distance FROM p")
def gated_pairs(spark, sf_dir):
    return _gated(spark, sf_dir).select("frame", "candidate_id", "track_id", *rounded({"distance": F.col("distance")}))


@query(f"WITH {VEC}, {TRACKS}, {GATED_PAIRS} SELECT frame, track_id, first(candidate_id ORDER BY distance, candidate_id) AS candidate_id FROM p GROUP BY frame, track_id")
def nearest_in_gate(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy("frame", "track_id").agg(F.min_by("candidate_id", F.struct("distance", "candidate_id")).alias("candidate_id"))


COMBINED = "0.55 * exp(-0.5 * pow(distance / 0.95, 2.0)) + 0.25 * exp(-0.5 * pow(abs(z) / 0.5, 2.0)) + 0.20 * (label / 10.0)"


@query(f"WITH {VEC}, {TRACKS}, {GATED_PAIRS}, m AS (SELECT *, {COMBINED} AS combined FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY combined DESC, candidate_id) AS k FROM m) SELECT track_id, candidate_id, {r('combined')} AS combined FROM n WHERE k = 1 AND combined >= 0.03")
def prior_weighted_pick(spark, sf_dir):
    p = _gated(spark, sf_dir).withColumn("residual", F.abs("z")).withColumn("score", F.col("label") / 10.0)
    return trackers.weighted_pick(p, "track_id").select("track_id", "candidate_id", *rounded({"combined": F.col("combined")}))


# Greedy matching one pair after the other, by rising distance.
@query(f"WITH RECURSIVE {VEC}, {TRACKS}, {GATED_PAIRS}, o AS (SELECT frame, candidate_id, track_id, distance, row_number() OVER (PARTITION BY frame ORDER BY distance, candidate_id, track_id) AS k FROM p), "
       "g(frame, k, cs, ts) AS (SELECT DISTINCT frame, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM o UNION ALL "
       "SELECT o.frame, o.k, CASE WHEN list_contains(cs, candidate_id) OR list_contains(ts, track_id) THEN cs ELSE list_append(cs, candidate_id) END, "
       "CASE WHEN list_contains(cs, candidate_id) OR list_contains(ts, track_id) THEN ts ELSE list_append(ts, track_id) END FROM g JOIN o ON o.frame = g.frame AND o.k = g.k + 1) "
       "SELECT o.frame, candidate_id, track_id, distance FROM g JOIN o ON o.frame = g.frame AND o.k = g.k + 1 WHERE NOT list_contains(cs, candidate_id) AND NOT list_contains(ts, track_id)".replace("distance FROM g", r("distance") + " AS distance FROM g"))
def greedy_match(spark, sf_dir):
    p = _gated(spark, sf_dir).select("frame", "candidate_id", "track_id", "distance")
    run = lambda pdf: spatial.greedy_matches(pdf)
    return p.groupBy("frame").applyInPandas(run, p.schema).select("frame", "candidate_id", "track_id", *rounded({"distance": F.col("distance")}))


@query(f"WITH {PTS}, m AS (SELECT frame, median(x) AS mx, median(y) AS my, median(z) AS mz, count(*) AS n FROM pts GROUP BY frame), "
       "d AS (SELECT p.*, n, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS d FROM pts p JOIN m USING (frame)), sd AS (SELECT frame, stddev_pop(d) AS s FROM d GROUP BY frame) "
       f"SELECT frame, point_index, {XYZ} FROM d JOIN sd USING (frame) WHERE n < 4 OR s <= 0 OR d <= 2.0 * s")
def outlier_sigma(spark, sf_dir):
    return _points(filters.outliers_removed(pts(spark, sf_dir), "frame"))


@query(f"WITH {PTS}, c AS (SELECT n_nationkey AS frame, CAST(n_nationkey % 7 - 3 AS DOUBLE) AS cx, CAST(n_nationkey % 5 - 2 AS DOUBLE) AS cy, CAST(0 AS DOUBLE) AS cz FROM nation), "
       "n AS (SELECT p.*, cx IS NULL OR (x BETWEEN cx - 3.2 AND cx + 3.2 AND y BETWEEN cy - 2.8 AND cy + 2.8 AND z BETWEEN cz - 1.2 AND cz + 1.8) AS near FROM pts p LEFT JOIN c USING (frame)), "
       f"k AS (SELECT frame, count(*) FILTER (WHERE near) AS kept FROM n GROUP BY frame) SELECT frame, point_index, {XYZ} FROM n JOIN k USING (frame) WHERE near OR kept < 180")
def local_roi(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("frame"))  # half of the frames have a centre
    centers = nation.select("frame", (F.col("frame") % 7 - 3.0).alias("x"), (F.col("frame") % 5 - 2.0).alias("y"), F.lit(0.0).alias("z"))
    return _points(filters.local_roi(pts(spark, sf_dir), centers, "frame", LocalRoi()))


LIMITS = ("l AS (SELECT *, id % 3 > 0 AS mk, id % 4 AS rc, id % 6 = 0 AS rs FROM vec), lim AS (SELECT *, CASE WHEN rs AND mk THEN 1.4 WHEN mk AND rc >= 2 THEN 1.4 WHEN mk THEN 1.5 ELSE 0.8 END AS foot_z, "
          "CASE WHEN rs AND mk THEN 2.0 WHEN mk AND rc >= 2 THEN 3.8 WHEN mk THEN 2.2 ELSE 1.0 END AS jump, CASE WHEN mk AND rc >= 2 THEN 7.0 WHEN mk THEN 6.5 ELSE 3.5 END AS speed, CASE WHEN rs AND mk THEN 1.5 END AS far FROM l)")


def _limits():
    marker = F.col("id") % 3 > 0
    return marker, filters.motion_limits(Motion(), marker, F.col("id") % 4, F.col("id") % 6 == 0)


@query(f"WITH {VEC}, {LIMITS} SELECT id, foot_z AS max_foot_z, jump AS max_planar_jump, speed AS max_planar_speed, far AS max_marker_distance FROM lim")
def motion_cfg(spark, sf_dir):
    return vec(spark, sf_dir).select("id", *[c.alias(n) for n, c in _limits()[1].items()])


@query(f"WITH {VEC}, {LIMITS}, q AS (SELECT *, CASE WHEN mk THEN sqrt((x - 0.5) * (x - 0.5) + y * y) END AS d, sqrt(x * x + y * y) AS pl, abs(z) AS ve, (id % 11 - 1) / 10.0 AS dt FROM lim), "
       "u AS (SELECT *, coalesce(d <= 0.9, false) AS nr FROM q), w AS (SELECT *, CASE WHEN nr THEN 1.45 ELSE foot_z END AS fz, CASE WHEN nr THEN 2.6 ELSE jump END AS pj, CASE WHEN nr THEN 7.0 ELSE speed END AS ps FROM u) "
       "SELECT id, CASE WHEN d > far THEN format('aruco_distance>{:.2f}', far) WHEN z > fz THEN format('footpoint_z>{:.2f}', CAST(fz AS DOUBLE)) WHEN id % 13 = 0 THEN NULL WHEN dt < 0 THEN 'negative_dt' "
       "WHEN pl > pj THEN format('planar_jump>{:.2f}', CAST(pj AS DOUBLE)) WHEN ve > 0.6 THEN 'vertical_jump>0.60' WHEN dt > 1e-3 AND pl / dt > ps THEN format('planar_speed>{:.2f}', CAST(ps AS DOUBLE)) WHEN dt > 1e-3 AND ve / dt > 2.5 THEN 'vertical_speed>2.50' END AS reason FROM w".replace("far)", "CAST(far AS DOUBLE))"))
def motion_reject_reason(spark, sf_dir):
    v = vec(spark, sf_dir)
    marker, limits = _limits()
    none = F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.lit(0.0))
    distance = F.when(marker, norm2(F.col("x") - 0.5, F.col("y")))
    reason = filters.motion_reject_reason((F.col("x"), F.col("y"), F.col("z")), (none, none, none), (F.col("id") % 11 - 1) / 10.0, distance, limits=limits)
    return v.select("id", reason.alias("reason"))


#: Edges of convex hulls in SQL: pairs of a group's points with all others on the left.
def _hull_sql(points: str, keys: str) -> str:
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    return (f"hp AS (SELECT DISTINCT {keys}, u, v FROM {points}), he AS (SELECT {own}, a.u AS au, a.v AS av, b.u AS bu, b.v AS bv FROM hp a JOIN hp b ON {same('a', 'b')} AND (a.u <> b.u OR a.v <> b.v) "
            f"JOIN hp c ON {same('a', 'c')} GROUP BY {own}, a.u, a.v, b.u, b.v HAVING min((b.u - a.u) * (c.v - a.v) - (b.v - a.v) * (c.u - a.u)) >= 0)")


@query(f"WITH {VEC}, hv AS (SELECT label, x * 100 AS u, y * 100 AS v FROM vec), {_hull_sql('hv', 'label')} "
       f"SELECT label, CAST(count(*) AS INTEGER) AS vertices, {r('0.5 * abs(sum(au * bv - av * bu))', 3)} AS area FROM he GROUP BY label")
def hull_area(spark, sf_dir):
    v = vec(spark, sf_dir).select("label", (F.col("x") * 100).alias("u"), (F.col("y") * 100).alias("v"))
    return spatial.hulls(v, ["label"]).select("label", F.size("hull").alias("vertices"), *rounded({"area": F.col("area")}, 3))


@query(f"WITH {VEC}, hv AS (SELECT frame, id, label AS group_index, x * 100 AS u, y * 100 AS v FROM vec), {_hull_sql('hv', 'frame, group_index')}, "
       "box AS (SELECT frame, group_index, min(au) AS x0, max(au) AS x1, min(av) AS y0, max(av) AS y1, count(*) AS n FROM he GROUP BY frame, group_index) "
       "SELECT p.frame, p.id, b.group_index FROM hv p JOIN box b ON b.frame = p.frame AND n > 2 AND u BETWEEN floor(x0) AND ceil(x1) + 1 AND v BETWEEN floor(y0) AND ceil(y1) + 1 "
       "JOIN he e ON e.frame = b.frame AND e.group_index = b.group_index GROUP BY p.frame, p.id, b.group_index HAVING min((trunc(bu) - trunc(au)) * (trunc(v) - trunc(av)) - (trunc(bv) - trunc(av)) * (trunc(u) - trunc(au))) >= 0")
def hull_roi(spark, sf_dir):
    v = vec(spark, sf_dir).select("frame", "id", "label", (F.col("x") * 100).alias("u"), (F.col("y") * 100).alias("v"))
    groups = spatial.hulls(v.withColumnRenamed("label", "group_index"), ["frame", "group_index"])
    return spatial.hull_join(v.select("frame", "id", "u", "v"), groups, "frame").select("frame", "id", "group_index")


@query()
def multi_tracker(spark, sf_dir):
    v = vec(spark, sf_dir)
    c = v.select("label", F.floor(F.col("id") / 10).cast("double").alias("ts"), F.col("id").alias("candidate_id"), "x", "y", "z")
    wide = Tracker(gate=3.0, max_prediction_s=6.0)
    out = trackers.track_multi(c.withColumn("ts", F.col("ts") * 0.1), "label", wide)
    return out.select("label", "ts", "track_id", *rounded({n: F.col(n) for n in ("x", "y", "z", "vx", "vy")}, 4), "hits", "misses")


@query(f"WITH {PTS} SELECT frame, point_index, CAST(trunc(greatest(least((x + 10.0) / 20.0 * 1199, 1199.0), 0.0)) AS INTEGER) AS px, CAST(trunc(greatest(least((1.0 - (y + 10.0) / 20.0) * 899, 899.0), 0.0)) AS INTEGER) AS py FROM pts")
def canvas_map(spark, sf_dir):
    px, py = canvas(F.col("x"), F.col("y"), (-10.0, 10.0), (-10.0, 10.0), (1200, 900))
    return pts(spark, sf_dir).select("frame", "point_index", px.alias("px"), py.alias("py"))


@query(f"WITH {PTS}, t AS (SELECT frame, point_index, greatest(least((z + 1.0) / 4.0, 1.0), 0.0) AS q FROM pts) SELECT frame, point_index, "
       "CASE WHEN q < 0.25 THEN 255 WHEN q < 0.5 THEN CAST(trunc(255 * (1 - (q - 0.25) / 0.25)) AS INTEGER) ELSE 0 END AS b, "
       "CASE WHEN q < 0.25 THEN CAST(trunc(255 * (q / 0.25)) AS INTEGER) WHEN q < 0.75 THEN 255 ELSE CAST(trunc(255 * (1 - (q - 0.75) / 0.25)) AS INTEGER) END AS g, "
       "CASE WHEN q < 0.5 THEN 0 WHEN q < 0.75 THEN CAST(trunc(255 * ((q - 0.5) / 0.25)) AS INTEGER) ELSE 255 END AS r FROM t")
def height_color(spark, sf_dir):
    c = height_colour(F.col("z"), -1.0, 3.0)
    return pts(spark, sf_dir).withColumn("c", c).select("frame", "point_index", "c.b", "c.g", "c.r")


KEY = lambda *exprs: "'[' || " + " || ', ' || ".join(f"CAST(round_even({e}, 3) AS VARCHAR)" for e in exprs) + " || ']'"


@query(f"WITH {VEC} SELECT id, {KEY('x', 'y', 'z')} || '|' || {KEY('abs(x)', 'abs(y)', 'abs(z)')} AS key FROM vec")
def candidate_keys(spark, sf_dir):
    v = vec(spark, sf_dir)
    return v.select("id", candidate_key(tuple(F.col(c) for c in "xyz"), (F.abs("x"), F.abs("y"), F.abs("z"))).alias("key"))



#: Line items as masks of ten queries on 5,000 pixels, orders as class scores.
MASKS = ("classes AS (SELECT o_custkey % 7 AS image, o_orderkey % 10 AS query, o_orderkey % 4 AS class_id, max(o_totalprice) / 600000 AS p FROM orders GROUP BY 1, 2, 3), "
         "masks AS (SELECT l_suppkey % 7 AS image, l_partkey % 10 AS query, l_orderkey % 5000 AS pixel, max(l_quantity) / 50 AS m FROM lineitem GROUP BY 1, 2, 3)")


def _masks(spark, sf_dir):
    o, i = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    classes = o.groupBy((F.col("o_custkey") % 7).alias("image"), (F.col("o_orderkey") % 10).alias("query"), (F.col("o_orderkey") % 4).alias("class_id")).agg((F.max("o_totalprice") / 600000).alias("p"))
    masks = i.groupBy((F.col("l_suppkey") % 7).alias("image"), (F.col("l_partkey") % 10).alias("query"), (F.col("l_orderkey") % 5000).alias("pixel")).agg((F.max("l_quantity") / 50).alias("m"))
    return classes, masks


@query(f"WITH {MASKS}, v AS (SELECT image, pixel, class_id, sum(p * m) AS s FROM masks JOIN classes USING (image, query) GROUP BY ALL) SELECT image, pixel, {r('max(s)', 4)} AS score FROM v GROUP BY image, pixel")
def semantic_segments(spark, sf_dir):
    return segments.semantic(*_masks(spark, sf_dir), "image").select("image", "pixel", *rounded({"score": F.col("score")}, 4))


@query(f"WITH {MASKS}, best AS (SELECT image, query, class_id, p FROM classes QUALIFY row_number() OVER (PARTITION BY image, query ORDER BY p DESC, class_id) = 1 AND p > 0.5), "
       "s AS (SELECT m.image, m.query, pixel, m, class_id, p * m AS w FROM masks m JOIN best b ON b.image = m.image AND b.query = m.query), "
       "area AS (SELECT image, query, count(*) AS area FROM s WHERE m >= 0.5 GROUP BY ALL), "
       "won AS (SELECT * FROM (SELECT image, pixel, query, class_id, m FROM s QUALIFY row_number() OVER (PARTITION BY image, pixel ORDER BY w DESC, query) = 1) WHERE m >= 0.5), "
       "kept AS (SELECT image, query, class_id, CASE WHEN class_id IN (0, 1) THEN query ELSE -1 END AS unit FROM won JOIN area USING (image, query) GROUP BY image, query, class_id, area HAVING count(*) >= 0.1 * area), "
       "ids AS (SELECT image, class_id, unit, CAST(row_number() OVER (PARTITION BY image ORDER BY min(query)) AS INTEGER) AS segment FROM kept GROUP BY image, class_id, unit) "
       "SELECT won.image, pixel, segment, won.class_id FROM won JOIN kept ON kept.image = won.image AND kept.query = won.query JOIN ids ON ids.image = kept.image AND ids.class_id = kept.class_id AND ids.unit = kept.unit")
def panoptic_segments(spark, sf_dir):
    return segments.panoptic(*_masks(spark, sf_dir), "image", 0.5, 0.1, (0, 1))


# E-4: the k best are the feature.
@query(f"WITH {MASKS}, q AS (SELECT image, query, sum(CASE WHEN m > 0.5 THEN m END) / (count(*) FILTER (WHERE m > 0.5) + 1e-6) AS q FROM masks GROUP BY ALL), "
       "t AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY p DESC, query, class_id) AS n FROM classes) "
       f"SELECT image, query, class_id, {r('p * coalesce(q, 0)', 4)} AS score FROM t JOIN q USING (image, query) WHERE n <= 12")
def instance_segments(spark, sf_dir):
    return segments.instances(*_masks(spark, sf_dir), "image", 12).select("image", "query", "class_id", *rounded({"score": F.col("score")}, 4))


@query(f"WITH {VEC}, ids AS (SELECT p_size, dense_rank() OVER (ORDER BY p_size) - 1 AS n FROM (SELECT DISTINCT p_size FROM part)) SELECT id, n AS category_id FROM vec JOIN ids ON p_size = label * 5")
def category_remap(spark, sf_dir):
    """Part sizes as a registry of category ids."""
    registry = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("id"))
    return segments.remap_categories(vec(spark, sf_dir).select("id", (F.col("label") * 5).alias("category_id")), registry).select("id", F.col("category_id").cast("long").alias("category_id"))


@query("WITH t AS (SELECT l_orderkey % 50 AS frame, l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS ids FROM lineitem GROUP BY ALL), e AS (SELECT frame, l_orderkey, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM t), "
       "f AS (SELECT frame, id, row_number() OVER (PARTITION BY frame ORDER BY l_orderkey, i) AS k FROM e), d AS (SELECT frame, id, min(k) AS k FROM f GROUP BY frame, id) SELECT frame, string_agg(id, ',' ORDER BY k) AS ids FROM d GROUP BY frame")
def distinct_ids(spark, sf_dir):
    """Orders as groups of supplier ids, frame by frame."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda s: s["l_suppkey"])
    groups = items.groupBy((F.col("l_orderkey") % 50).alias("frame"), "l_orderkey").agg(one.alias("g"))
    listed = groups.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "g"))).alias("gs"))
    return listed.select("frame", F.array_join(markers.distinct_ids(F.transform("gs", lambda s: s["g"])), ",").alias("ids"))


RASTER = (f"{PTS}, m AS (SELECT frame, CAST(trunc(greatest(least((x + 10.0) / 20.0 * 319, 319.0), 0.0)) AS INTEGER) AS px, "
          "CAST(trunc(greatest(least((1.0 - (y + 10.0) / 20.0) * 239, 239.0), 0.0)) AS INTEGER) AS py, z FROM pts), "
          "c AS (SELECT frame, px, py, count(*) AS points, max(z) AS z, greatest(least((max(z) + 1.0) / 4.0, 1.0), 0.0) AS q FROM m GROUP BY frame, px, py), "
          "k AS (SELECT *, CASE WHEN q < 0.25 THEN 255 WHEN q < 0.5 THEN CAST(trunc(255 * (1 - (q - 0.25) / 0.25)) AS INTEGER) ELSE 0 END AS b, "
          "CASE WHEN q < 0.25 THEN CAST(trunc(255 * (q / 0.25)) AS INTEGER) WHEN q < 0.75 THEN 255 ELSE CAST(trunc(255 * (1 - (q - 0.75) / 0.25)) AS INTEGER) END AS g, "
          "CASE WHEN q < 0.5 THEN 0 WHEN q < 0.75 THEN CAST(trunc(255 * ((q - 0.5) / 0.25)) AS INTEGER) ELSE 255 END AS r FROM c)")


def _raster(spark, sf_dir):
    return raster.raster(pts(spark, sf_dir), ["frame"], (-10.0, 10.0), (-10.0, 10.0), (320, 240), (-1.0, 3.0))


@query(f"WITH {RASTER} SELECT frame, px, py, points, {r('z')} AS z, b, g, r FROM k")
def raster_top_view(spark, sf_dir):
    """Pixels of the view from above: the highest point of each is in front."""
    return _raster(spark, sf_dir).select("frame", "px", "py", "points", *rounded({"z": F.col("z")}), "b", "g", "r")


@query(f"WITH {RASTER}, l AS (SELECT DISTINCT frame, py FROM k) SELECT l.frame, l.py, md5(string_agg(CASE WHEN k.px IS NULL THEN '000000' ELSE printf('%02X%02X%02X', b, g, r) END, '' ORDER BY i)) AS digest "
       "FROM l CROSS JOIN range(320) AS t(i) LEFT JOIN k ON k.frame = l.frame AND k.py = l.py AND k.px = i GROUP BY l.frame, l.py")
def raster_scanlines(spark, sf_dir):
    """The picture's lines as bytes, by digest."""
    return raster.scanlines(_raster(spark, sf_dir), ["frame"], (320, 240)).select("frame", "py", F.md5("hex").alias("digest"))
