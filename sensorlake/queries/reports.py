"""Queries on what a run reads and writes: listings, pose text, job lists, point and track files, summary lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.functions.records import point_line, rounded
from sensorlake.operators import cluster, filters, markers
from sensorlake.queries.base import ORACLES, PTS, SERIES, pts, query, r, series, table
from sensorlake.queries.points import ANNULUS, motion_reject_reason
from sensorlake.queries.series import DET, _detections, _groups
from sensorlake.sources import points as listings
from sensorlake.sources import sinks
from sensorlake.sources.pose_text import parse_poses


def _bags(spark, sf_dir):
    """Suppliers as the bags of their nation's job."""
    balance = F.col("s_acctbal")
    status = F.when(balance < 0, "failed").when(balance < 2000, "skipped").otherwise("ok")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("job_name"), F.col("s_name").alias("bag_name"), status.alias("status"))


BAGS = "b AS (SELECT s_nationkey AS job_name, s_name AS bag_name, CASE WHEN s_acctbal < 0 THEN 'failed' WHEN s_acctbal < 2000 THEN 'skipped' ELSE 'ok' END AS status FROM supplier)"


@query(f"WITH {BAGS} SELECT n_nationkey AS job_name, count(bag_name) AS bag_count, coalesce(string_agg(bag_name || ':' || status, ',' ORDER BY bag_name), '') AS bags "
       "FROM nation LEFT JOIN b ON job_name = n_nationkey GROUP BY n_nationkey")
def run_manifest(spark, sf_dir):
    jobs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("job_name"))
    m = sinks.manifest(_bags(spark, sf_dir), jobs)
    return m.select("job_name", "bag_count", F.array_join(F.transform("bags", lambda b: F.concat(b["bag_name"], F.lit(":"), b["status"])), ",").alias("bags"))


@query(f"WITH {BAGS} SELECT job_name, status, count(*) AS bags, string_agg(bag_name, ',' ORDER BY bag_name) AS names FROM b GROUP BY job_name, status")
def status_tally(spark, sf_dir):
    t = sinks.tally(_bags(spark, sf_dir), "job_name")
    return t.select("job_name", "status", "bags", F.array_join("names", ",").alias("names"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def skip_existing(spark, sf_dir):
    """Orders as jobs; those with a returned item are done."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.not_yet_done(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


RANGES = {"both": (1704240000.0, 1704758400.0), "start": (1704240000.0, None), "end": (None, 1704758400.0), "none": (None, None)}


@query(f"WITH {SERIES} SELECT 'both' AS bounds, event_id FROM s WHERE ts BETWEEN 1704240000 AND 1704758400 UNION ALL SELECT 'start', event_id FROM s WHERE ts >= 1704240000 "
       "UNION ALL SELECT 'end', event_id FROM s WHERE ts <= 1704758400 UNION ALL SELECT 'none', event_id FROM s")
def debug_range(spark, sf_dir):
    s = series(spark, sf_dir)
    both, *others = (filters.in_time_range(s, "ts", *v).select(F.lit(k).alias("bounds"), "event_id") for k, v in RANGES.items())
    for o in others:
        both = both.unionByName(o)
    return both


@query(f"SELECT id, reason IS NULL AS allowed FROM ({ORACLES['motion_reject_reason']})")
def motion_allowed(spark, sf_dir):
    return motion_reject_reason(spark, sf_dir).select("id", filters.allowed(F.col("reason")).alias("allowed"))


@query(f"WITH {PTS} SELECT frame, count(*) AS points, {', '.join(f'{r(f"{f}({c})", 4)} AS {c}{n}' for c in 'xyz' for f, n in (('avg', ''), ('min', '_min'), ('max', '_max')))} FROM pts WHERE {ANNULUS} GROUP BY frame")
def roi_centroid(spark, sf_dir):
    c = cluster.centroids(filters.roi_annulus(pts(spark, sf_dir)), "frame")
    return c.select("frame", "points", *rounded({n: F.col(n) for n in c.columns if n not in ("frame", "points")}, 4))


@query(f"WITH {PTS}, {DET}, c AS (SELECT frame, point_index % 2 AS group_index, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts WHERE {ANNULUS} GROUP BY ALL), "
       "t AS (SELECT frame, group_index, avg(tx) AS x, avg(ty) AS y, avg(tz) AS z FROM m GROUP BY frame, group_index) "
       f"SELECT frame, group_index, {', '.join(f'{r(f"coalesce(c.{v}, t.{v})", 4)} AS {v}' for v in 'xyz')} FROM t LEFT JOIN c USING (frame, group_index)")
def centroid_fallback(spark, sf_dir):
    """Marker groups at the centroid of their points, at their marker centre where there are none."""
    seen = filters.roi_annulus(pts(spark, sf_dir)).withColumn("group_index", (F.col("point_index") % 2).cast("int"))
    d, g = _groups(spark, sf_dir)
    centres = markers.group_targets(d, g, "frame", "det").select("frame", "group_index", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    out = markers.centre_or(cluster.centroids(seen, "frame", "group_index"), centres, ["frame", "group_index"])
    return out.select("frame", "group_index", *rounded({c: F.col(c) for c in "xyz"}, 4))


@query(f"WITH {PTS} SELECT frame, point_index, printf('%6d %10.4f %10.4f %10.4f %10.4f', point_index, x, y, z, sqrt(x * x + y * y + z * z)) AS line FROM pts")
def roi_dump(spark, sf_dir):
    return pts(spark, sf_dir).select("frame", "point_index", point_line(F.col("point_index"), F.col("x"), F.col("y"), F.col("z")).alias("line"))


@query(f"WITH {PTS} SELECT frame, point_index AS \"order\", printf('%.6f %.6f %.6f', x, y, z) AS value FROM pts UNION ALL SELECT frame, -1, '# .PCD v0.7' || chr(10) || 'VERSION 0.7' || chr(10) || 'FIELDS x y z' || chr(10) || 'SIZE 4 4 4' "
       "|| chr(10) || 'TYPE F F F' || chr(10) || 'COUNT 1 1 1' || chr(10) || 'WIDTH ' || count(*) || chr(10) || 'HEIGHT 1' || chr(10) || 'VIEWPOINT 0 0 0 1 0 0 0' || chr(10) || 'POINTS ' || count(*) || chr(10) || 'DATA ascii' FROM pts GROUP BY frame")
def pcd_rows(spark, sf_dir):
    return sinks.pcd_lines(pts(spark, sf_dir), "frame")


TRACK = ("t AS (SELECT event_type AS target, epoch_us(ts) AS us, ts AS at, epoch_us(ts) / 1e6 AS ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, CAST(user_id AS DOUBLE) / 8 AS lon, CAST(user_id AS DOUBLE) / 16 - 40 AS lat, "
         "CAST(event_id AS DOUBLE) / 4 AS alt FROM events)")


@query(f"WITH {TRACK} SELECT target, 2 AS section, us AS \"order\", '        <when>' || iso || '</when>' AS value FROM t "
       "UNION ALL SELECT target, 3, us, '        <gx:coord>' || printf('%.9f %.9f %.3f', lon, lat, alt) || '</gx:coord>' FROM t "
       "UNION ALL SELECT target, 5, us, '          <gx:value>' || printf('%d.%03d', (us + 500) // 1000 // 1000, (us + 500) // 1000 % 1000) || '</gx:value>' FROM t")
def kml_tracks(spark, sf_dir):
    """The event types as tracks: times, coordinates and seconds of their points in a KML document."""
    return sinks.kml_lines(_tracks(spark, sf_dir)).where(F.col("section").isin(2, 3, 5))


def _tracks(spark, sf_dir):
    user = F.col("user_id").cast("double")
    return series(spark, sf_dir).select(F.col("event_type").alias("target"), "ts", (user / 8).alias("lon"), (user / 16 - 40).alias("lat"), (F.col("event_id").cast("double") / 4).alias("alt"))


ENDS = "e AS (SELECT target, {f}(iso, us) AS iso, {f}(us, us) AS us, {f}(lon, us) AS lon, {f}(lat, us) AS lat, {f}(alt, us) AS alt FROM t GROUP BY target)"
PLACEMARK = ("replace('      <Placemark>|        <name>' || iso || '</name>|        <styleUrl>#{n}Point</styleUrl>|        <TimeStamp><when>' || iso || '</when></TimeStamp>|        <description><![CDATA[utc=' || CAST(round_even(us / 1e6, 0) AS BIGINT) "
             "|| 's<br/>datetime=' || iso || printf('<br/>lon=%.9f<br/>lat=%.9f<br/>alt=%.3f', lon, lat, alt) || ']]></description>|        <Point><altitudeMode>absolute</altitudeMode><coordinates>' || printf('%.9f,%.9f,%.3f', lon, lat, alt) "
             "|| '</coordinates></Point>|      </Placemark>', '|', chr(10))")


@query(f"WITH {TRACK} SELECT target, 'start' AS kind, {PLACEMARK.replace('{n}', 'start')} AS value FROM (WITH {ENDS.replace('{f}', 'arg_min')} SELECT * FROM e) "
       f"UNION ALL SELECT target, 'end', {PLACEMARK.replace('{n}', 'end')} FROM (WITH {ENDS.replace('{f}', 'arg_max')} SELECT * FROM e)")
def kml_ends(spark, sf_dir):
    """Placemarks of the tracks' first and last points."""
    tail = sinks.kml_lines(_tracks(spark, sf_dir)).where("section = 6")
    marks = F.regexp_extract_all("value", F.lit(r"(?s)( {6}<Placemark>.*?</Placemark>)"), F.lit(1))
    return tail.select("target", F.posexplode(marks).alias("i", "value")).select("target", F.when(F.col("i") == 0, "start").otherwise("end").alias("kind"), "value")


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS line FROM events")
def frame_summaries(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    lines = sinks.summary_lines(e)
    return lines.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.col("value").alias("line"))


@query(f"WITH {DET} SELECT frame, count(*) AS n, string_agg(marker_id || ':' || CAST(round_even(round_even(tx, 1) * 10, 0) AS BIGINT), ',' ORDER BY marker_id, tx, ty, tz) AS markers, "
       f"{r('sum(4 * u + 4 + 2 * round_even(v, 1) + 2 * round_even(v + 3, 1))', 2)} AS corners FROM d WHERE frame % 5 = 0 GROUP BY frame")
def detection_records(spark, sf_dir):
    """Every fifth frame's detections as one nested record, read back."""
    records = sinks.detection_records(_detections(spark, sf_dir), every=5, digits=1)
    near = lambda m: F.concat(m["marker_id"].cast("string"), F.lit(":"), F.bround(m["position"][0] * 10).cast("long").cast("string"))
    total = F.aggregate(F.flatten(F.flatten("detections.corners")), F.lit(0.0), lambda a, b: a + b)
    return records.select("frame", F.size("detections").cast("long").alias("n"), F.array_join(F.transform("detections", near), ",").alias("markers"), *rounded({"corners": total}, 2))


FILES = "x AS (SELECT p_partkey AS k, p_partkey % 300 AS d, p_size % 5 AS kind FROM part)"


@query(f"WITH {FILES}, g AS (SELECT d, count(*) FILTER (WHERE kind = 0) AS poses, count(*) FILTER (WHERE kind IN (1, 2, 3)) AS inside, count(*) FILTER (WHERE kind IN (1, 2)) AS bags FROM x GROUP BY d), "
       "w AS (SELECT *, CASE WHEN poses = 0 THEN 'no pose file' WHEN inside = 0 THEN 'no recording folder' WHEN bags = 0 THEN 'no recordings' END AS reason FROM g) "
       "SELECT 'set' || d AS dataset, CASE WHEN reason IS NULL THEN 'ready' ELSE 'skipped' END AS status, reason, bags FROM w")
def discover_sets(spark, sf_dir):
    """Parts as files of 300 data sets: pose files, recordings at two depths, other files."""
    k, kind = F.col("p_partkey").cast("string"), F.col("p_size") % 5
    name = F.concat(F.lit("set"), (F.col("p_partkey") % 300).cast("string"))
    rest = F.when(kind == 0, F.concat(F.lit("IE/"), name, F.lit(".txt"))).when(kind == 1, F.concat(F.lit("rosbag/"), k, F.lit(".bag"))).when(
        kind == 2, F.concat(F.lit("day/rosbag/"), k, F.lit(".bag"))).when(kind == 3, F.concat(F.lit("rosbag/"), k, F.lit(".txt"))).otherwise(F.concat(F.lit("notes/"), k))
    return listings.discover(table(spark, sf_dir, "part").select(F.concat(F.lit("/data/"), name, F.lit("/CollectionSystem/"), rest).alias("path")))


@query(f"SELECT CAST(k AS DOUBLE) AS ts, {r('k % 80 + (k % 60) / 60e0 + 0.25e0 / 3600')} AS latitude_deg, {r('-(k % 170 + 1 + 7 / 60e0 + 0.5e0 / 3600)')} AS longitude_deg, {r('p', 2)} AS height_m, "
       "k % 7 - 3.5e0 AS roll_deg, k % 5 + 0.25e0 AS pitch_deg, k % 360 + 0.5e0 AS heading_deg FROM (SELECT o_orderkey AS k, o_totalprice AS p, o_orderpriority AS o FROM orders) WHERE o NOT IN ('1-URGENT', '5-LOW')")
def pose_text(spark, sf_dir):
    """Orders as lines of a pose file, the urgent ones as comments and the low ones cut short, read back."""
    k, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    line = F.format_string("%d 0 0 %d %d 0.25 -%d 7 0.5 %.2f 0 0 0 0 %.1f %.2f %.1f 9", k, k % 80, k % 60, k % 170 + 1, "o_totalprice", k % 7 - F.lit(3.5), k % 5 + F.lit(0.25), k % 360 + F.lit(0.5))
    text = F.when(priority == "1-URGENT", F.concat(F.lit("# "), line)).when(priority == "5-LOW", F.substring_index(line, " ", 12)).otherwise(line)
    p = parse_poses(table(spark, sf_dir, "orders").select(text.alias("value")))
    return p.select("ts", *rounded({c: F.col(c) for c in ("latitude_deg", "longitude_deg")}), *rounded({"height_m": F.col("height_m")}, 2), "roll_deg", "pitch_deg", "heading_deg")
