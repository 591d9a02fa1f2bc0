import json
import struct

import numpy as np
import pytest

from sensorlake.plans import flows
from sensorlake.sources import points, pose_text, sinks, world


def test_pose_text(spark, tmp_path):
    good = "100.5 a b 22 30 0 114 10 12 55.5 x x x x 1.5 -2.5 270.0 z"
    (tmp_path / "p.txt").write_text(f"header line\n{good}\n101 too short\n{good.replace('55.5', 'bad')}\n")
    rows = pose_text.read_poses(spark, str(tmp_path / "p.txt")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.ts, r.latitude_deg, r.height_m, r.roll_deg, r.pitch_deg, r.heading_deg) == (100.5, 22.5, 55.5, 1.5, -2.5, 270.0)


def test_world_csv_round_trip(spark, tmp_path):
    rows = [(float(t), 1.0, 2.0, 3.0) for t in range(3)]
    df = spark.createDataFrame(rows, "utc_seconds double, target_0_lat double, target_0_lon double, target_0_height double")
    sinks.write_world_csv(df, str(tmp_path / "w"))
    tracks = world.target_tracks(world.read_world_csv(spark, str(tmp_path / "w")))
    assert [(r.target, r.lat, r.lon, r.alt) for r in tracks.orderBy("ts").collect()] == [("target_0", 1.0, 2.0, 3.0)] * 3
    sinks.write_kml(tracks, str(tmp_path / "k"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "k")).collect())
    assert text.count("<gx:coord>2.000000000 1.000000000 3.000</gx:coord>") == 3 and "points=3" in text


def test_records(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"timestamp": 1.0, "aruco_group_targets": [{"target_group_index": 0, "target_world_enu_m": [1, 2, 3]}]}\n\nnonsense\n')
    r = world.group_points(world.read_records(spark, str(tmp_path / "r.jsonl"))).collect()
    assert [(x.timestamp, x.group_index, x.e, x.interpolated) for x in r] == [(1.0, 0, 1.0, False)]
    with pytest.raises(Exception):
        world.read_records(spark, str(tmp_path / "r.jsonl"), strict=True).collect()


def test_point_messages(spark):
    body = np.array([(0, 1.0, 2.0, 3.0, 0, 0, 0), (1, 4.0, 5.0, 6.0, 0, 0, 0)], dtype=points.WIRE).tobytes()
    payload = struct.pack("<III", 1, 2, 3) + struct.pack("<I", 2) + b"id" + struct.pack("<QIBBBB", 9, 2, 0, 0, 0, 0) + body
    df = spark.createDataFrame([("b", 0, 1.5, bytearray(payload))], "bag string, frame_index long, ts double, payload binary")
    assert [(r.point_index, r.x, r.z) for r in points.decode_points(df).orderBy("point_index").collect()] == [(0, 1.0, 3.0), (1, 4.0, 6.0)]
    img = spark.createDataFrame([("b", 0, 1.5, "rgb8", 1, 1, bytearray(b"\x01\x02\x03"))], "bag string, frame_index long, ts double, encoding string, height int, width int, data binary")
    assert bytes(points.decode_images(img).first().bgr) == b"\x03\x02\x01"


def test_listing_merge_and_manifest(spark, tmp_path):
    (tmp_path / "a.bag").write_bytes(b"12")
    assert [r.name for r in points.list_recordings(spark, str(tmp_path)).collect()] == ["a.bag"]
    with pytest.raises(FileNotFoundError):
        points.list_recordings(spark, str(tmp_path), "*.none")
    a = spark.createDataFrame([(2.0, "x")], "ts double, v string")
    b = spark.createDataFrame([(1.0, "own")], "ts double, source_bag string")
    assert [(r.ts, r.source_bag) for r in sinks.merge([("a", a), ("b", b)], "ts").collect()] == [(1.0, "own"), (2.0, "a")]
    results = spark.createDataFrame([("j", "a.bag", "ok"), ("j", "b.bag", "failed")], "job_name string, bag_name string, status string")
    jobs = spark.createDataFrame([("j",), ("empty",)], "job_name string")
    assert {r.job_name: (r.bag_count, [tuple(b) for b in r.bags]) for r in sinks.manifest(results, jobs).collect()} == {
        "j": (2, [("a.bag", "ok"), ("b.bag", "failed")]), "empty": (0, [])}
    assert {r.status: r.bags for r in sinks.tally(results).collect()} == {"ok": 1, "failed": 1}


def test_world_solution(spark):
    poses = spark.createDataFrame([("b", 0.0, 22.3, 114.17, 10.0, 0.0, 0.0, 90.0), ("b", 9.0, 22.3, 114.17, 10.0, 0.0, 0.0, 90.0)],
                                  "bag string, ts double, latitude_deg double, longitude_deg double, height_m double, roll_deg double, pitch_deg double, heading_deg double")
    t = spark.createDataFrame([("b", 1.0, 1.0, 0.0, 0.0)], "bag string, ts double, x double, y double, z double")
    r = flows.world_solution(t, poses).first()
    assert (r.e, r.n, r.u) == pytest.approx((1.1232, 0, -0.0492), abs=1e-4)


def test_lidar_flow(spark):
    rng = np.random.default_rng(1)
    rows = [(f, i, *(np.array([3.0 + 0.1 * f, 1.0, 0.9]) + rng.uniform(-0.15, 0.15, 3) * [1, 1, 4]).tolist()) for f in range(4) for i in range(60)]
    p = spark.createDataFrame(rows, "frame int, point_index long, x double, y double, z double")
    times = spark.createDataFrame([("b", f, 0.1 * f) for f in range(5)], "bag string, frame int, ts double")
    out = flows.lidar_states(p, times).orderBy("ts").collect()
    assert len(out) == 5 and out[3].lifecycle == "confirmed" and out[4].x is None
    assert flows.ground_lab(p).count() == 4


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_json_array_in_parts(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, i, None if i % 3 else "é\"x") for i in range(50)], "ts int, id int, s string")
    sinks.write_json_array(df.repartition(5), f"{tmp_path}/a", ["ts", "id"])
    assert json.loads(text_of(tmp_path / "a")) == [{"ts": i % 7, "id": i, "s": None if i % 3 else "é\"x"} for i in sorted(range(50), key=lambda i: (i % 7, i))]
    sinks.write_json_array(df.where("false"), f"{tmp_path}/b", ["ts", "id"])
    assert json.loads(text_of(tmp_path / "b")) == []


def test_detection_records(spark):
    df = spark.createDataFrame([(0, 3, 0.1234567, 0.0, 1.0, [(1.0, 2.0)]), (1, 3, 0.0, 0.0, 1.0, [(1.0, 2.0)])],
                               "frame int, marker_id int, tx double, ty double, tz double, corners array<struct<u:double,v:double>>")
    rows = sinks.detection_records(df, every=2).collect()
    assert len(rows) == 1 and rows[0].detections[0].position == [0.123457, 0.0, 1.0] and rows[0].detections[0].corners == [[1.0, 2.0]]


def test_kml_is_one_document(spark, tmp_path):
    from xml.etree import ElementTree

    track = spark.createDataFrame([(t, 100.0 + i, 114.0 + i / 1e3, 22.0, 5.0) for t in ("target_0", "target_1") for i in range(6)], "target string, ts double, lon double, lat double, alt double")
    curve = spark.createDataFrame([(float(i), 114.0, 22.0, 5.0, 90.0) for i in range(300)], "ts double, lon double, lat double, alt double, heading double")
    sinks.write_kml(track.repartition(3), f"{tmp_path}/k", reference=curve)
    root = ElementTree.fromstring(text_of(tmp_path / "k"))
    ns = {"k": "http://www.opengis.net/kml/2.2", "gx": "http://www.google.com/kml/ext/2.2"}
    folders = root.findall(".//k:Folder", ns)
    assert [f.find("k:name", ns).text for f in folders] == ["target_0", "target_1", "gt"]
    for f, n in zip(folders, (6, 6, 16)):
        assert [len(f.findall(f".//{tag}", ns)) for tag in ("k:when", "gx:coord", "gx:value")] == [n + 2, n, n]
        assert [p.find("k:styleUrl", ns).text for p in f.findall("k:Placemark", ns)][1:] == ["#startPoint", "#endPoint"]
        times = [w.text for w in f.findall(".//gx:Track/k:when", ns)]
        assert times == sorted(times) and len(set(times)) == n
    assert folders[2].find("k:Placemark/k:styleUrl", ns).text == "#gtLine" and "heading_start_deg=90" in folders[2].find("k:description", ns).text


def test_discovery_reasons(spark):
    root = "file:/data"
    paths = ["a/CollectionSystem/IE/a.txt", "a/CollectionSystem/x/rosbag/1.bag", "a/CollectionSystem/x/rosbag/2.bag", "b/CollectionSystem/IE/other.txt", "b/CollectionSystem/rosbag/1.bag",
             "c/CollectionSystem/IE/c.txt", "d/CollectionSystem/IE/d.txt", "d/CollectionSystem/rosbag/readme"]
    files = spark.createDataFrame([(f"{root}/{p}",) for p in paths], "path string")
    got = {r.dataset: (r.status, r.reason, r.bags) for r in points.discover(files).collect()}
    assert got == {"a": ("ready", None, 2), "b": ("skipped", "no pose file", 1), "c": ("skipped", "no recording folder", 0), "d": ("skipped", "no recordings", 0)}


def test_object_messages_replay_and_plot_scan(spark):
    m = spark.createDataFrame([("b", 0, 1.0, [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)])], "bag string, frame_index long, ts double, points array<struct<x:double,y:double,z:double>>")
    assert [(r.point_index, r.z) for r in points.decode_objects(m).collect()] == [(0, 3.0), (1, 6.0)]
    assert points.replayed(m, 3).count() == 3
    one = lambda ts: (ts, "b", [(0, [1.0, 2.0, 3.0], [1.0, 2.0, ts], None, False)])
    records = spark.createDataFrame([one(5.0), one(7.0)], world.RECORD)
    assert [(r.elapsed, r.c) for r in world.plotted_track(records).orderBy("ts").collect()] == [(0.0, 5.0), (2.0, 7.0)]
    with pytest.raises(ValueError):
        world.plotted_track(records, group=1)


def test_configuration(spark, tmp_path):
    from sensorlake import config
    from sensorlake.functions import geo, records

    (tmp_path / "c.json").write_text(json.dumps({"ground": {"method": "adaptive_plane", "z": [0.0, 2.0]}, "roi": None}))
    found = config.read_config(f"{tmp_path}/c.json")
    assert found["ground"] == config.Ground(method="adaptive_plane", z=(0.0, 2.0)) and found["roi"] == config.Roi()
    for wrong in ({"what": {}}, {"roi": {"what": 1}}):
        with pytest.raises(ValueError):
            config.configured(wrong)
    assert records.set_nested({"a": 1, "b": {"c": 2}}, ["a", "x"], 3) == {"a": {"x": 3}, "b": {"c": 2}}
    assert geo.extrinsics_from({"t_base_lidar": [1, 2, 3], "r_base_lidar": [[1]]}) == config.Extrinsics(t_base_lidar=(1.0, 2.0, 3.0))
    assert records.axis_labels("bev") == ("x", "y") and records.axis_limits("side", (0, 1), (2, 3), (-1, 4.25)) == ("[0.0,1.0]", "[-1.0,4.2]")
    p = spark.createDataFrame([([1.0, 2.0],)], "p array<double>")
    with pytest.raises(Exception, match="three coordinates"):
        p.select(geo.point3(p.p)).collect()


def test_filled_gaps_have_world_positions(spark):
    poses = spark.createDataFrame([("b", float(t), 22.3, 114.17, 10.0, 0.0, 0.0, 90.0) for t in range(9)],
                                  "bag string, ts double, latitude_deg double, longitude_deg double, height_m double, roll_deg double, pitch_deg double, heading_deg double")
    t = spark.createDataFrame([("b", ts, ts, 0.5, 0.2) for ts in (1.0, 1.5, 2.5)], "bag string, ts double, x double, y double, z double")
    frames = spark.createDataFrame([("b", 1.0 + i / 4) for i in range(7)], "bag string, ts double")
    found = flows.world_solution(t, poses)
    filled, _ = flows.cleaned(found, "bag", frames, poses=poses)
    rows = {r.ts: r for r in filled.collect()}
    assert len(rows) == 7 and rows[2.0].interpolated and not rows[1.5].interpolated
    for r in found.collect():
        assert (rows[r.ts].lat, rows[r.ts].lon, rows[r.ts].height) == pytest.approx((r.lat, r.lon, r.height), abs=1e-7)
    assert rows[2.0].lon == pytest.approx((rows[1.5].lon + rows[2.5].lon) / 2, abs=1e-9)


def test_many_targets_over_a_stream(spark, tmp_path):
    from sensorlake.operators.trackers import track_multi
    from sensorlake.streaming.trackers import track_stream

    schema = "key string, ts double, candidate_id int, x double, y double, z double, score double"
    rows = [("k", i / 10, c, 5.0 * c + i / 50, 0.0, 0.0, 1.0) for i in range(12) for c in (0, 1)]
    for n, part in enumerate((rows[:10], rows[10:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = sinks.flushed(track_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "key", many=True), f"{tmp_path}/out", f"{tmp_path}/state", "parquet")
        query.awaitTermination()  # the second run goes on from the first one's checkpoint
    order = ["ts", "track_id"]
    got = spark.read.parquet(f"{tmp_path}/out").orderBy(order).collect()
    assert got == track_multi(spark.createDataFrame(rows, schema), "key").orderBy(order).collect() and len(got) == 20
