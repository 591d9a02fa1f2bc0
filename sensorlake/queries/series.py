"""Queries on time series: as-of joins, trajectory cleaning, trackers, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.config import TARGET_GROUPS
from sensorlake.functions.records import frame_name, group_label, iso_utc, iso_zoned, kml_coordinate, palette, rounded
from sensorlake.operators import buckets, filters, markers, timejoin, trackers, trajectory
from sensorlake.queries.base import SERIES, query, r, series, table
from sensorlake.sources import sinks

WIDTH = 6 * 3600.0
LIDAR, CAMERA = "event_type IN ('view', 'purchase')", "event_type IN ('click')"
SIDES = f"a AS (SELECT * FROM s WHERE {LIDAR}), b AS (SELECT * FROM s WHERE {CAMERA})"


def _sides(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.where(LIDAR), s.where(CAMERA).select("user_id", "ts", "value", F.col("event_id").alias("camera_id"))


def _camera():
    """The matched frame, -1 for none."""
    return F.coalesce("m.camera_id", F.lit(-1)).alias("camera_id")


ASOF = "SELECT a.user_id, a.event_id, a.ts, b.event_id AS camera_id, b.ts AS bts, b.value AS bv FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts"


@query(f"WITH {SERIES}, {SIDES}, j AS ({ASOF}) SELECT event_id, coalesce(camera_id, -1) AS camera_id FROM j")
def asof_backward(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return timejoin.asof_backward(a, b, "user_id", width=WIDTH).select("event_id", _camera())


@query(f"WITH {SERIES}, {SIDES}, j AS ({ASOF}) SELECT event_id, CASE WHEN ts - bts <= 3600 THEN camera_id ELSE -1 END AS camera_id FROM j")
def sync_gate(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return timejoin.asof_backward(a, b, "user_id", width=WIDTH, tolerance=3600.0).select("event_id", _camera())


NEAREST = ("f AS (SELECT a.event_id, b.event_id AS camera_id, b.ts AS bts FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts <= b.ts), p AS (" + ASOF + "), "
           "n AS (SELECT event_id, p.ts, CASE WHEN f.bts IS NULL OR p.ts - p.bts <= f.bts - p.ts THEN coalesce(p.camera_id, f.camera_id) ELSE f.camera_id END AS camera_id, "
           "CASE WHEN f.bts IS NULL OR p.ts - p.bts <= f.bts - p.ts THEN coalesce(p.bts, f.bts) ELSE f.bts END AS bts FROM p JOIN f USING (event_id))")


@query(f"WITH {SERIES}, {SIDES}, {NEAREST} SELECT event_id, CASE WHEN abs(ts - bts) <= 7200 THEN camera_id ELSE -1 END AS camera_id FROM n")
def asof_nearest_tol(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return timejoin.asof_nearest(a, b, "user_id", width=WIDTH, tolerance=7200.0).select("event_id", _camera())


@query(f"WITH {SERIES}, {SIDES}, {NEAREST} SELECT event_id, coalesce(camera_id, -1) AS camera_id FROM n")
def nearest_pose(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return timejoin.asof_nearest(a, b, "user_id", width=WIDTH).select("event_id", _camera())


@query(f"WITH {SERIES}, {SIDES}, j AS ({ASOF}) SELECT event_id, {r('(bts - ts) * 1000.0', 3)} AS delta_ms FROM j")
def sync_delta_ms(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    j = timejoin.asof_backward(a, b, "user_id", width=WIDTH)
    return j.select("event_id", *rounded({"delta_ms": timejoin.sync_delta_ms(F.col("ts"), F.col("m.ts"))}, 3))


@query(f"WITH {SERIES}, {SIDES}, w AS (SELECT *, lead(ts) OVER q AS nts, lead(value) OVER q AS nv, lead(event_id % 360) OVER q AS nh, event_id % 360 AS h FROM b WINDOW q AS (PARTITION BY user_id ORDER BY ts)), "
       "one AS (SELECT user_id, min(ts) AS ft, arg_min(value, ts) AS fv, arg_min(h, ts) AS fh FROM w GROUP BY user_id), "
       "j AS (SELECT a.event_id, a.user_id, a.ts AS t, w.ts AS ts, w.value AS v, w.h AS h, nts, nv, nh FROM a ASOF LEFT JOIN w ON a.user_id = w.user_id AND a.ts >= w.ts), "
       "k AS (SELECT j.*, fv, fh, CASE WHEN nts - ts > 0 THEN greatest(least((t - ts) / (nts - ts), 1.0), 0.0) ELSE 0.0 END AS q FROM j LEFT JOIN one USING (user_id)) "
       f"SELECT event_id, {r('CASE WHEN ts IS NOT NULL AND nts IS NULL THEN ts ELSE t END')} AS pose_ts, {r('CASE WHEN ts IS NULL THEN fv WHEN nts IS NULL THEN v ELSE v + (nv - v) * q END')} AS value, "
       f"{r('CASE WHEN ts IS NULL THEN fh WHEN nts IS NULL THEN h ELSE h + ((nh - h + 180.0) - 360 * floor((nh - h + 180.0) / 360) - 180.0) * q END')} AS heading FROM k")
def pose_interpolate(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    poses = b.select("user_id", "ts", "value", (F.col("camera_id") % 360).cast("double").alias("heading"))
    out = timejoin.interpolate_poses(a.select("user_id", "event_id", "ts"), poses, "user_id", ["value"], ["heading"], width=WIDTH)
    return out.select("event_id", *rounded({c: F.col(c) for c in ("pose_ts", "value", "heading")}))


@query(f"WITH {SERIES}, q AS (SELECT floor(ts / 86400) * 86400 AS wanted FROM s GROUP BY 1) SELECT event_id, wanted FROM s JOIN q ON abs(ts - wanted) < 300")
def band_join_ts(spark, sf_dir):
    s = series(spark, sf_dir)
    wanted = s.select((F.floor(F.col("ts") / 86400) * 86400.0).alias("wanted")).distinct()
    return timejoin.band_join(s, wanted, at="wanted", width=300.0).select("event_id", "wanted")


SPEED, GAP = 0.0005, 200_000.0
SEEN = "event_type IN ('view', 'click')"
STEP = ("o AS (SELECT * FROM s WHERE " + SEEN + "), st AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > 0 THEN abs(value - lag(value) OVER w) / (ts - lag(ts) OVER w) END AS speed, "
        "CASE WHEN lead(ts) OVER w - ts > 0 THEN abs(value - lead(value) OVER w) / (lead(ts) OVER w - ts) END AS next_speed FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts))")


def _observed(spark, sf_dir):
    return series(spark, sf_dir).where(SEEN)


@query(f"WITH {SERIES}, {STEP} SELECT event_id, user_id, value FROM st WHERE NOT coalesce(speed > {SPEED} AND next_speed > {SPEED}, false)")
def spike_reject(spark, sf_dir):
    return trajectory.reject_spikes(_observed(spark, sf_dir), "user_id", "ts", ["value"], SPEED).select("event_id", "user_id", "value")


@query(f"WITH {SERIES}, {STEP} SELECT event_id, {r('speed')} AS speed, {r('next_speed')} AS next_speed FROM st")
def step_speed(spark, sf_dir):
    s = trajectory.step_speed(_observed(spark, sf_dir), "user_id", "ts", ["value"])
    return s.select("event_id", *rounded({c: F.col(c) for c in ("speed", "next_speed")}))


@query(f"WITH {SERIES}, {STEP}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM st WHERE speed > {SPEED}) SELECT user_id, event_id, nth FROM n WHERE nth <= 8")
def spike_report(spark, sf_dir):
    return trajectory.spike_report(_observed(spark, sf_dir), "user_id", "ts", ["value"], SPEED).select("user_id", "event_id", F.col("nth").cast("long").alias("nth"))


@query(f"WITH {SERIES}, {STEP} SELECT user_id, count(*) AS points, count(*) FILTER (WHERE speed > {SPEED}) AS spikes FROM st GROUP BY user_id")
def spike_counts(spark, sf_dir):
    return trajectory.spike_counts(_observed(spark, sf_dir), "user_id", "ts", ["value"], SPEED)


CLEAN = (f"{STEP}, c AS (SELECT event_id FROM st WHERE NOT coalesce(speed > {SPEED} AND next_speed > {SPEED}, false)), "
         "f AS (SELECT s.*, c.event_id IS NOT NULL AS seen FROM s LEFT JOIN c USING (event_id)), "
         "br AS (SELECT *, last_value(CASE WHEN seen THEN ts END IGNORE NULLS) OVER p AS bt, last_value(CASE WHEN seen THEN value END IGNORE NULLS) OVER p AS bv, "
         "first_value(CASE WHEN seen THEN ts END IGNORE NULLS) OVER n AS nt, first_value(CASE WHEN seen THEN value END IGNORE NULLS) OVER n AS av FROM f "
         "WINDOW p AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), "
         f"fill AS (SELECT event_id, user_id, ts, CASE WHEN seen THEN value ELSE bv + (av - bv) * CASE WHEN nt - bt > 0 THEN (ts - bt) / (nt - bt) ELSE 0.0 END END AS value, NOT seen AS interpolated FROM br WHERE seen OR nt - bt <= {GAP})")


def _frames(spark, sf_dir):
    """All frames with the flag seen: observed and not a spike."""
    s = series(spark, sf_dir)
    kept = trajectory.reject_spikes(s.where(SEEN), "user_id", "ts", ["value"], SPEED).select("event_id", F.lit(True).alias("seen"))
    return s.join(kept, "event_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def _filled(spark, sf_dir):
    return trajectory.fill_gaps(_frames(spark, sf_dir), "user_id", "ts", "seen", ["value"], GAP)


@query(f"WITH {SERIES}, {CLEAN} SELECT event_id, {r('value')} AS value, interpolated FROM fill")
def gap_fill(spark, sf_dir):
    return _filled(spark, sf_dir).select("event_id", *rounded({"value": F.col("value")}), "interpolated")


@query(f"WITH {SERIES}, {CLEAN}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM f), g AS (SELECT user_id, ts AS start, lead(ts) OVER w AS stop, lead(i) OVER w - i - 1 AS missing FROM i WHERE seen WINDOW w AS (PARTITION BY user_id ORDER BY ts)) "
       f"SELECT user_id, start, missing, {r('stop - start')} AS gap FROM g WHERE missing > 0 AND stop - start > 20000.0")
def gap_warnings(spark, sf_dir):
    g = trajectory.long_gaps(_frames(spark, sf_dir), "user_id", "ts", "seen", 20_000.0)
    return g.select("user_id", "start", F.col("missing").cast("long").alias("missing"), *rounded({"gap": F.col("gap")}))


@query(f"WITH {SERIES}, {CLEAN} SELECT user_id, count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts, {r('max(ts) - min(ts)')} AS duration, {r('arg_min(value, ts)')} AS first_heading, {r('arg_max(value, ts)')} AS last_heading FROM fill GROUP BY user_id")
def track_summary(spark, sf_dir):
    t = trajectory.track_summary(_filled(spark, sf_dir), "user_id", "ts", "value")
    return t.select("user_id", "points", "first_ts", "last_ts", *rounded({c: F.col(c) for c in ("duration", "first_heading", "last_heading")}))


@query(f"WITH {SERIES}, m AS (SELECT user_id, min(ts) AS f FROM s GROUP BY user_id) SELECT event_id, {r('ts - f')} AS elapsed FROM s JOIN m USING (user_id)")
def elapsed(spark, sf_dir):
    return trajectory.elapsed(series(spark, sf_dir), "user_id", "ts").select("event_id", *rounded({"elapsed": F.col("elapsed")}))


@query(f"WITH {SERIES} SELECT event_id, {r('CASE WHEN ts - lag(ts) OVER w > 1e-6 THEN (value - lag(value) OVER w) / (ts - lag(ts) OVER w) ELSE 0.0 END')} AS v_value FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def velocity(spark, sf_dir):
    return trajectory.velocity(series(spark, sf_dir), "user_id", "ts", ["value"]).select("event_id", *rounded({"v_value": F.col("v_value")}))


@query(f"WITH {SERIES}, h AS (SELECT *, event_type = 'view' AS hit FROM s), i AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM h) SELECT event_id, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i")
def reconnect_streak(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("hit", F.col("event_type") == "view")
    return trajectory.miss_streak(s, "user_id", ["ts", "event_id"], "hit").select("event_id", "streak")


@query(f"WITH {SERIES}, h AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h FROM s) SELECT event_id, len(h) AS n, {r('list_sum(h)', 4)} AS total FROM h")
def bounded_history(spark, sf_dir):
    h = trajectory.last_k(series(spark, sf_dir), "user_id", "ts", "value", 10)
    return h.select("event_id", F.size("history").cast("long").alias("n"), *rounded({"total": F.aggregate("history", F.lit(0.0), lambda a, b: a + b)}, 4))


# T-1 on one scalar, as a fold; the driver's SQL walks the samples with a recursive table.
@query(f"WITH RECURSIVE {SERIES}, n AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM s), "
       "t(user_id, i, ts, p, u) AS (SELECT user_id, i, ts, value, CAST(0.0 AS DOUBLE) FROM n WHERE i = 1 UNION ALL "
       "SELECT n.user_id, n.i, n.ts, (p + u * greatest(n.ts - t.ts, 1e-3)) + 0.65 * (value - (p + u * greatest(n.ts - t.ts, 1e-3))), "
       "((p + u * greatest(n.ts - t.ts, 1e-3)) + 0.65 * (value - (p + u * greatest(n.ts - t.ts, 1e-3))) - p) / greatest(n.ts - t.ts, 1e-3) FROM t JOIN n ON n.user_id = t.user_id AND n.i = t.i + 1) "
       f"SELECT user_id, {r('arg_max(p, i)', 4)} AS position FROM t GROUP BY user_id")
def alpha_tracker(spark, sf_dir):
    samples = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").alias("v")))), lambda x: x)
    folded = series(spark, sf_dir).groupBy("user_id").agg(trackers.alpha_fold(samples, 0.65).alias("f"))
    return folded.select("user_id", *rounded({"position": F.col("f.p")}, 4))


@query()
def single_tracker(spark, sf_dir):
    s = series(spark, sf_dir)
    hit = F.col("event_type") != "error"
    c = s.select("user_id", "ts", F.col("event_id").alias("candidate_id"), F.when(hit, F.col("value")).alias("x"), F.when(hit, F.lit(0.0)).alias("y"),
                 F.when(hit, F.lit(0.0)).alias("z"), F.lit(1.0).alias("score"))
    out = trackers.track_single(c, "user_id")
    return out.select("user_id", "ts", *rounded({"x": F.col("x"), "quality": F.col("quality")}, 4), "lifecycle")


# T-2: the quality and lifecycle of a run of hits and misses.
@query(f"WITH RECURSIVE {SERIES}, n AS (SELECT user_id, event_id, event_type <> 'error' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM s), "
       "z AS (SELECT user_id, 0 AS i, CAST(0.0 AS DOUBLE) AS q, 0 AS hits, 0 AS misses, 'tentative' AS life FROM n GROUP BY user_id), "
       "t(user_id, i, q, hits, misses, life) AS (SELECT * FROM z UNION ALL SELECT t.user_id, t.i + 1, CASE WHEN hit THEN q + 0.22 * (1.0 - q) WHEN misses + 1 >= 8 THEN 0.0 ELSE q * 0.86 END, "
       "CASE WHEN hit THEN hits + 1 ELSE 0 END, CASE WHEN hit THEN 0 ELSE misses + 1 END, CASE WHEN hit AND hits + 1 >= 3 THEN 'confirmed' WHEN hit AND life = 'lost' THEN 'tentative' WHEN NOT hit AND misses + 1 >= 8 THEN 'lost' ELSE life END "
       f"FROM t JOIN n ON n.user_id = t.user_id AND n.i = t.i + 1) SELECT user_id, {r('arg_max(q, i)', 4)} AS quality, arg_max(life, i) AS lifecycle, arg_max(hits, i) AS hits FROM t GROUP BY user_id")
def lifecycle(spark, sf_dir):
    zero = F.struct(F.lit(0.0).alias("q"), F.lit(0).alias("hits"), F.lit(0).alias("misses"), F.lit("tentative").alias("life"))

    def step(s, m):
        hit, hits, misses = m["hit"], s["hits"] + 1, s["misses"] + 1
        return F.struct(
            F.when(hit, s["q"] + 0.22 * (1.0 - s["q"])).when(misses >= 8, F.lit(0.0)).otherwise(s["q"] * 0.86).alias("q"),
            F.when(hit, hits).otherwise(F.lit(0)).alias("hits"), F.when(hit, F.lit(0)).otherwise(misses).alias("misses"),
            F.when(hit & (hits >= 3), F.lit("confirmed")).when(hit & (s["life"] == "lost"), F.lit("tentative"))
            .when(~hit & (misses >= 8), F.lit("lost")).otherwise(s["life"]).alias("life"))

    marks = F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("event_type") != "error").alias("hit"))))
    t = series(spark, sf_dir).groupBy("user_id").agg(F.aggregate(marks, zero, step).alias("t"))
    return t.select("user_id", *rounded({"quality": F.col("t.q")}, 4), F.col("t.life").alias("lifecycle"), "t.hits")


DET = ("d AS (SELECT event_id // 7 AS frame, event_id AS det, CAST((event_id * 31) % 100 AS INTEGER) AS marker_id, value AS tx, value * 2 AS ty, value - 5 AS tz, user_id AS u, value AS v FROM events), "
       "grp(group_index, ids) AS (VALUES (0, [3, 17, 42, 88]), (1, [2, 19, 55, 81])), e AS (SELECT group_index, unnest(ids) AS marker_id FROM grp), "
       "m AS (SELECT d.*, group_index FROM d JOIN e USING (marker_id))")


def _detections(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    corner = lambda dx, dy: F.struct((F.col("user_id") + dx).cast("double").alias("u"), (v + dy).alias("v"))
    return table(spark, sf_dir, "events").select(
        F.floor(e / 7).cast("long").alias("frame"), e.alias("det"), (e * 31 % 100).cast("int").alias("marker_id"), v.alias("tx"), (v * 2).alias("ty"), (v - 5).alias("tz"),
        F.array(corner(0, 0), corner(2, 0), corner(2, 3), corner(0, 3)).alias("corners"))


def _groups(spark, sf_dir):
    d = _detections(spark, sf_dir)
    return d, markers.group_table(d, TARGET_GROUPS)


TARGET = "g AS (SELECT frame, group_index, list(marker_id ORDER BY det) AS visible_ids, count(*) AS visible, count(*) / 4 AS coverage, avg(tx) AS tx, avg(ty) AS ty, avg(tz) AS tz FROM m GROUP BY frame, group_index)"


@query(f"WITH {DET}, {TARGET} SELECT frame, group_index, array_to_string(visible_ids, ',') AS ids, visible, {r('coverage')} AS coverage, {r('tx', 4)} AS tx, {r('tz', 4)} AS tz FROM g")
def marker_groups(spark, sf_dir):
    d, g = _groups(spark, sf_dir)
    t = markers.group_targets(d, g, "frame", "det")
    return t.select("frame", "group_index", F.array_join("visible_ids", ",").alias("ids"), "visible", *rounded({"coverage": F.col("coverage")}), *rounded({c: F.col(c) for c in ("tx", "tz")}, 4))


@query(f"WITH {DET}, {TARGET} SELECT frame, group_index, visible FROM g WHERE len(visible_ids) >= 2")
def valid_marker_groups(spark, sf_dir):
    d, g = _groups(spark, sf_dir)
    return filters.valid_groups(markers.group_targets(d, g, "frame", "det")).select("frame", "group_index", "visible")


@query(f"WITH {DET}, {TARGET}, n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY visible DESC, coverage DESC, group_index) AS k FROM g) SELECT frame, group_index, visible FROM n WHERE k = 1")
def best_group(spark, sf_dir):
    d, g = _groups(spark, sf_dir)
    return markers.best_group(markers.group_targets(d, g, "frame", "det"), "frame", "visible", "coverage").select("frame", "group_index", "visible")


@query(f"WITH {DET} SELECT frame, group_index, min(CAST(u AS DOUBLE)) AS u_min, max(CAST(u + 2 AS DOUBLE)) AS u_max, {r('min(v)')} AS v_min, {r('max(v + 3)')} AS v_max, {r('(max(CAST(u + 2 AS DOUBLE)) - min(CAST(u AS DOUBLE))) * (max(v + 3) - min(v))', 4)} AS area FROM m GROUP BY frame, group_index")
def group_box(spark, sf_dir):
    d, g = _groups(spark, sf_dir)
    b = markers.group_boxes(d, g, "frame")
    return b.select("frame", "group_index", "u_min", "u_max", *rounded({c: F.col(c) for c in ("v_min", "v_max")}), *rounded({"area": F.col("area")}, 4))


@query(f"WITH {DET}, f AS (SELECT frame, list(DISTINCT marker_id) AS ids FROM d GROUP BY frame) SELECT frame, group_index, '[' || array_to_string(list_sort(list_filter(grp.ids, lambda x: list_contains(f.ids, x))), ', ') || ']' AS visible, "
       "'[' || array_to_string(list_filter(grp.ids, lambda x: NOT list_contains(f.ids, x)), ', ') || ']' AS missing FROM f, grp WHERE len(list_filter(grp.ids, lambda x: list_contains(f.ids, x))) > 0")
def marker_missing(spark, sf_dir):
    d, g = _groups(spark, sf_dir)
    frames = d.groupBy("frame").agg(F.collect_set("marker_id").alias("marker_ids"))
    m = markers.matched_groups(frames, g)
    return m.select("frame", "group_index", group_label(F.col("visible_ids")).alias("visible"), group_label(F.col("missing_ids")).alias("missing"))


@query(f"WITH {DET} SELECT DISTINCT frame FROM d WHERE frame NOT IN (SELECT frame FROM m)")
def frames_without_detection(spark, sf_dir):
    d, g = _groups(spark, sf_dir)
    return filters.frames_without(d.select("frame").distinct(), markers.members(d, g), "frame")


@query(f"WITH {SERIES} SELECT event_id, user_id, ts, value FROM s WHERE event_id % 5 = 0")
def every_n(spark, sf_dir):
    return filters.every_n(series(spark, sf_dir), "event_id", 5).select("event_id", "user_id", "ts", "value")


# O-5: the limit is the feature, a sample of 40 frames from frame 10 in steps of 3.
@query(f"WITH {SERIES}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM s) SELECT user_id, i AS frame_index, event_id FROM f WHERE i >= 10 AND (i - 10) % 3 = 0 AND i < 10 + 3 * 40")
def frame_sample(spark, sf_dir):
    f = trajectory.frame_index(series(spark, sf_dir), "user_id", ["ts", "event_id"])
    return filters.every_n(f, "frame_index", 3, 10, 40).select("user_id", F.col("frame_index").cast("long").alias("frame_index"), "event_id")


@query(f"WITH {SERIES}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM s) SELECT event_id FROM f WHERE i % (CASE WHEN n > 20 THEN n // 20 ELSE 1 END) = 0")
def downsample_stride(spark, sf_dir):
    return trajectory.downsample(series(spark, sf_dir), "user_id", ["ts", "event_id"], 20).select("event_id")


@query(f"WITH {SERIES}, t AS (SELECT min(ts) - 5.0 AS lo, max(ts) + 5.0 AS hi FROM s WHERE event_type = 'error') SELECT event_id FROM s, t WHERE ts BETWEEN lo AND hi AND event_type = 'view'")
def clip_range(spark, sf_dir):
    s = series(spark, sf_dir)
    return filters.clip_to(s.where("event_type = 'view'"), s.where("event_type = 'error'"), "ts").select("event_id")


@query("WITH w AS (SELECT epoch_us(ts) / 1e6 AS t, event_id % 3 AS g, value AS lat, value + 1 AS lon, value * 2 AS height FROM events) SELECT t AS utc_seconds, "
       + ", ".join(f"max(CASE WHEN g = {g} THEN {c} END) AS target_{g}_{c}" for g in (0, 1) for c in ("lat", "lon", "height")) + " FROM w GROUP BY t")
def world_csv_pivot(spark, sf_dir):
    s = series(spark, sf_dir)
    v = F.col("value")
    w = s.select(F.col("ts").alias("utc_seconds"), (F.col("event_id") % 3).alias("group_index"), v.alias("lat"), (v + 1).alias("lon"), (v * 2).alias("height"))
    return trajectory.world_csv_rows(w)


@query(f"WITH {SERIES}, a AS (SELECT event_id, ts, 'b0' AS source_bag FROM s WHERE event_type = 'view' UNION ALL SELECT event_id, ts, 'b1' FROM s WHERE event_type = 'click') SELECT event_id, source_bag, row_number() OVER (PARTITION BY source_bag ORDER BY ts, event_id) AS nth FROM a")
def merge_union_sorted(spark, sf_dir):
    s = series(spark, sf_dir).select("event_id", "ts", "event_type")
    a = s.where("event_type = 'view'").withColumn("source_bag", F.lit("b0")).drop("event_type")
    b = s.where("event_type = 'click'").select("event_id", "ts")
    merged = a.unionByName(b, allowMissingColumns=True).withColumn("source_bag", F.coalesce("source_bag", F.lit("b1")))
    return buckets.row_numbers(merged, ["source_bag"], "ts", ["ts", "event_id"], WIDTH).select("event_id", "source_bag", F.col("nth").cast("long").alias("nth"))


@query("SELECT event_id // 5 AS frame, coalesce(arg_min(value, event_id) FILTER (WHERE event_type = 'view'), arg_min(value, event_id) FILTER (WHERE event_type = 'click')) AS value FROM events GROUP BY 1")
def mirror_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("frame", F.floor(F.col("event_id") / 5).cast("long"))
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct("event_id", "value"))))
    arrays = e.groupBy("frame").agg(pick("view").alias("multi"), pick("click").alias("groups"))  # five rows a frame
    return arrays.select("frame", F.coalesce(F.get("multi", F.lit(0))["value"], F.get("groups", F.lit(0))["value"]).alias("value"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events")
def iso_time(spark, sf_dir):
    return series(spark, sf_dir).select("event_id", iso_utc(F.col("ts")).alias("iso"))


@query("SELECT event_id, ['ff00ff00', 'ff00ffff', 'ffff0000', 'ffff00ff', 'ffffff00'][CAST(user_id % 5 AS INTEGER) + 1] AS color FROM events")
def palette_color(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", palette(F.col("user_id")).alias("color"))


@query("SELECT c_custkey AS id, format('{:.9f},{:.9f},{:.3f}', CAST(c_custkey % 360 - 180 AS DOUBLE) / 8, CAST(c_custkey % 170 - 85 AS DOUBLE) / 4, CAST(c_custkey AS DOUBLE) / 4) AS coord FROM customer")
def kml_coords(spark, sf_dir):
    k = F.col("c_custkey")
    c = kml_coordinate((k % 360 - 180).cast("double") / 8, (k % 170 - 85).cast("double") / 4, k.cast("double") / 4)
    return table(spark, sf_dir, "customer").select(k.alias("id"), c.alias("coord"))


@query()
def stream_tracker(spark, sf_dir):
    from sensorlake.streaming.trackers import single_tracker_over_files

    return single_tracker_over_files(spark, f"{sf_dir}/events.parquet")


@query("SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS iso, printf('frame_%06d_%d.%03d', event_id, (epoch_us(ts) + 500) // 1000 // 1000, (epoch_us(ts) + 500) // 1000 % 1000) AS name FROM events")
def zoned_names(spark, sf_dir):
    """ISO times with their offset and frame file names."""
    return series(spark, sf_dir).select("event_id", iso_zoned(F.col("ts")).alias("iso"), frame_name(F.col("event_id"), F.col("ts")).alias("name"))


@query(f"WITH {SERIES}, o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM s), l AS (SELECT 1 AS section, event_id, CASE WHEN k = 1 THEN '' ELSE ',' END || '{{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}}' AS value FROM o) "
       "SELECT * FROM l UNION ALL VALUES (0, -1, '['), (2, -1, ']')")
def json_array(spark, sf_dir):
    """Events as the lines of one JSON array in time order."""
    lines = sinks.json_array_lines(series(spark, sf_dir).select("ts", "event_id", "event_type"), ["ts", "event_id"])
    short = F.regexp_replace("value", r'\{"ts":[^,]*,', "{")
    return lines.select("section", F.coalesce("event_id", F.lit(-1)).alias("event_id"), short.alias("value"))
