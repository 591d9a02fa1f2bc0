"""Writers: JSON, CSV, point-cloud text, KML and merged outputs.  Rows are formatted by Spark, in parallel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.records import iso_utc, kml_coordinate, palette
from sensorlake.operators.filters import clip_to
from sensorlake.operators.trajectory import downsample, track_summary
from sensorlake.sources.world import CSV_COLUMNS


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def json_array_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(section, order columns, value): the lines of one JSON array, a record each, separated by commas; order is unique."""
    first = df.agg(F.min(F.struct(*order)).alias("__first"))  # one row
    comma = F.when(F.struct(*order) == F.col("__first"), F.lit("")).otherwise(F.lit(","))
    rows = df.join(F.broadcast(first)).select(F.lit(1).alias("section"), *order, F.concat(comma, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value"))
    ends = df.sparkSession.createDataFrame([(0, "["), (2, "]")], "section int, value string")
    return rows.unionByName(ends, allowMissingColumns=True)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """A folder of text parts that make one JSON array in the order of their names."""
    keys = ["section", *order]
    json_array_lines(df, order).repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.mode("overwrite").text(path)


def detection_records(detections: DataFrame, frame: str = "frame", every: int = 1, digits: int = 6) -> DataFrame:
    """One record per sampled frame with its detections as nested, rounded arrays."""
    near = lambda c: F.array(*[F.bround(c[i], digits) for i in range(3)])
    one = F.struct("marker_id", near(F.array("tx", "ty", "tz")).alias("position"),
                   F.transform("corners", lambda p: F.array(F.bround(p["u"], digits), F.bround(p["v"], digits))).alias("corners"))
    sampled = detections.where(F.col(frame) % every == 0)
    return sampled.groupBy(frame).agg(F.array_sort(F.collect_list(one)).alias("detections"))  # a frame's few markers


def write_world_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The fixed 13 columns; further columns have no place."""
    missing = [F.lit(None).cast("double").alias(c) for c in CSV_COLUMNS if c not in df.columns]
    df.select("*", *missing).select(*CSV_COLUMNS).orderBy("utc_seconds").write.mode(mode).csv(path, header=True)


def pcd_lines(points: DataFrame, frame: str) -> DataFrame:
    """(frame, order, value): header and rows of one ASCII point cloud per frame."""
    head = points.groupBy(frame).agg(F.count("*").alias("n")).select(frame, F.lit(-1).cast("long").alias("order"), F.format_string(
        "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH %d\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS %d\nDATA ascii", "n", "n").alias("value"))
    return head.unionByName(points.select(frame, F.col("point_index").alias("order"), F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("value")))


def write_pcd(points: DataFrame, frame: str, path: str) -> None:
    """One folder per frame, its lines in order."""
    lines = pcd_lines(points, frame).repartition(frame).sortWithinPartitions(frame, "order")
    lines.select(frame, "value").write.mode("overwrite").partitionBy(frame).text(path)


def merge(parts: list[tuple[str, DataFrame]], ts: str, source: str = "source_bag") -> DataFrame:
    """Union of the bags' outputs with their source, where they have none yet, in time order."""
    named = [df.withColumn(source, F.coalesce(F.col(source), F.lit(name)) if source in df.columns else F.lit(name)) for name, df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named).orderBy(ts, source)


def manifest(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job: bag count and one struct per bag with its status; none for a job without results."""
    bag = F.struct(*[c for c in results.columns if c != "job_name"])
    lists = results.groupBy("job_name").agg(F.count("*").alias("bag_count"), F.array_sort(F.collect_list(bag)).alias("bags"))
    none = F.array().cast(lists.schema["bags"].dataType)
    return jobs.join(lists, "job_name", "left").select(*jobs.columns, F.coalesce("bag_count", F.lit(0)).alias("bag_count"), F.coalesce("bags", none).alias("bags"))


def tally(results: DataFrame, *keys: str) -> DataFrame:
    """Counts and names of the bags by status, within the keys."""
    return results.groupBy(*keys, "status").agg(F.count("*").alias("bags"), F.array_sort(F.collect_list("bag_name")).alias("names"))


_KML_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2">
  <Document>
    <Style id="gtLine"><LineStyle><color>ff0000ff</color><width>4</width></LineStyle></Style>
    <Style id="startPoint"><IconStyle><color>ff00ff00</color><scale>1.0</scale></IconStyle></Style>
    <Style id="endPoint"><IconStyle><color>ff0000ff</color><scale>1.0</scale></IconStyle></Style>"""


def kml_lines(track: DataFrame, key: str = "target", altitude_mode: str = "absolute", line: Column | None = None) -> DataFrame:
    """(key, section, order, value): the lines of a KML folder per key: its schema and style, a gx:Track with times, coordinates and
    seconds, and placemarks of the first and the last point.  line: the tracks' line style (its own by default).

    Every point is a line of its own, so a long trajectory is many rows, not one string; points stand in the order of their
    times, in microseconds.
    """
    point = track.withColumn("order", F.bround(F.col("ts") * 1e6).cast("long"))
    iso = iso_utc(F.col("ts"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("value")
    many = lambda section, *parts: point.select(key, F.lit(section).alias("section"), "order", text(*parts))
    when = many(2, "        <when>", iso, "</when>")
    coord = many(3, "        <gx:coord>", kml_coordinate(F.col("lon"), F.col("lat"), F.col("alt"), " "), "</gx:coord>")
    seconds = many(5, F.format_string("          <gx:value>%.3f</gx:value>", "ts"))
    heading = F.col("heading") if "heading" in track.columns else F.lit(None).cast("double")
    summary = track_summary(track.withColumn("heading", heading), key, "ts", "heading")
    ends = track.withColumn("heading", heading).groupBy(key).agg(*[f(F.struct("ts", "lon", "lat", "alt", "heading"), "ts").alias(n) for f, n in ((F.min_by, "start"), (F.max_by, "end"))])
    names = track.agg(F.array_sort(F.collect_set(key)).alias("names"))  # one row, the tracks' names
    info = summary.drop("heading_start", "heading_end").join(ends, key).join(F.broadcast(names)).withColumn("colour", palette(F.array_position("names", F.col(key)) - 1))
    own = text("#", F.col(key), "_line") if line is None else line
    part = lambda section, *parts: info.select(key, F.lit(section).alias("section"), F.lit(0).cast("long").alias("order"), text(*parts))
    turned = F.when(F.col("start.heading").isNotNull() | F.col("end.heading").isNotNull(), F.format_string(
        "<br/>heading_start_deg=%.6f<br/>heading_end_deg=%.6f", "start.heading", "end.heading")).otherwise("")
    told = F.concat(F.format_string("points=%d<br/>utc_start=%.0fs<br/>utc_end=%.0fs<br/>duration_s=%.0f", "points", "first_ts", "last_ts", "duration"), turned)
    head = part(1, "    <Schema name=\"", F.col(key), "_schema\" id=\"", F.col(key), "_schema\"><gx:SimpleArrayField name=\"utc_seconds\" type=\"xsd:string\">"
                "<displayName>UTC Seconds</displayName></gx:SimpleArrayField></Schema>\n    <Style id=\"", F.col(key), "_line\"><LineStyle><color>", F.col("colour"),
                "</color><width>4</width></LineStyle></Style>\n    <Folder>\n      <name>", F.col(key), "</name>\n      <description><![CDATA[", told,
                "]]></description>\n      <Placemark>\n      <name>", F.col(key), "_track</name>\n      <styleUrl>", own,
                f"</styleUrl>\n      <gx:Track>\n        <altitudeMode>{altitude_mode}</altitudeMode>")
    data = part(4, "        <ExtendedData><SchemaData schemaUrl=\"#", F.col(key), "_schema\"><gx:SimpleArrayData name=\"utc_seconds\">")
    tail = part(6, "        </gx:SimpleArrayData></SchemaData></ExtendedData>\n      </gx:Track>\n      </Placemark>",
                *_placemark("start", altitude_mode), *_placemark("end", altitude_mode), "\n    </Folder>")
    return reduce(DataFrame.unionByName, (head, when, coord, data, seconds, tail))


def _placemark(end: str, altitude_mode: str) -> tuple:
    """Parts of the placemark of a track's first or last point."""
    p = lambda c: F.col(f"{end}.{c}")
    iso = iso_utc(p("ts"))
    turned = F.when(p("heading").isNotNull(), F.format_string("<br/>heading_deg=%.6f", p("heading"))).otherwise("")
    place = kml_coordinate(p("lon"), p("lat"), p("alt"))
    return ("\n      <Placemark>\n        <name>", iso, f"</name>\n        <styleUrl>#{end}Point</styleUrl>\n        <TimeStamp><when>", iso, "</when></TimeStamp>\n        <description><![CDATA[",
            F.format_string("utc=%.0fs<br/>datetime=", p("ts")), iso, F.format_string("<br/>lon=%.9f<br/>lat=%.9f<br/>alt=%.3f", p("lon"), p("lat"), p("alt")), turned,
            f"]]></description>\n        <Point><altitudeMode>{altitude_mode}</altitudeMode><coordinates>", place, "</coordinates></Point>\n      </Placemark>")


def reference_curve(reference: DataFrame, track: DataFrame, most: int = 10_000, padding: float = 5.0) -> DataFrame:
    """reference(ts, ...) within the tracks' times and the padding, thinned to at most about `most` points."""
    near = clip_to(reference, track, "ts", padding).withColumn("target", F.lit("gt"))
    return downsample(near, "target", ["ts"], most)


def write_kml(track: DataFrame, path: str, key: str = "target", altitude_mode: str = "absolute", reference: DataFrame | None = None) -> None:
    """A folder of text parts which make one KML document in the order of their names; the reference curve comes last."""
    spark = track.sparkSession
    lines = kml_lines(track, key, altitude_mode).withColumn("part", F.lit(1))
    if reference is not None:
        curve = reference_curve(reference, track).withColumnRenamed("target", key)
        lines = lines.unionByName(kml_lines(curve, key, altitude_mode, F.lit("#gtLine")).withColumn("part", F.lit(2)))
    ends = spark.createDataFrame([(0, "", 0, 0, _KML_HEAD), (3, "", 0, 0, "  </Document>\n</kml>")], f"part int, {key} string, section int, order long, value string")
    by = ["part", key, "section", "order"]
    lines.unionByName(ends).repartitionByRange(*by).sortWithinPartitions(*by).select("value").write.mode("overwrite").text(path)


def flushed(stream: DataFrame, path: str, checkpoint: str, form: str = "json", every: str | None = None):
    """Starts a query that appends each micro-batch to path as it comes; stopped or killed, it goes on from its checkpoint.
    Without `every` it takes what is there and ends."""
    writer = stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def summary_lines(rows: DataFrame) -> DataFrame:
    """One JSON line a row, as the recordings' programs print them; a stream of them goes to `writeStream.format("console")`."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
