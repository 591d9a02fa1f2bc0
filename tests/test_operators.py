from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorlake.config import TARGET_GROUPS, Clustering, Ground, Person, Tracker
from sensorlake.operators import cluster, filters, ground, markers, spatial, timejoin, trackers, trajectory
from sensorlake.operators.components import connected_components


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ground_quantile_cell(spark):
    z = [.10, .11, .13, .20, 1.0, 1.2]
    p = frame(spark, [(0, i, 0.1, 0.1, v) for i, v in enumerate(z)], "frame int, point_index long, x double, y double, z double")
    assert ground.ground_cells(p, "frame").first().ground == pytest.approx(0.106)
    open_ = Ground(z=(float("-inf"), float("inf")))
    kept = ground.remove_ground(p, "frame", "point_index", open_)
    assert sorted(r.z for r in kept.collect()) == [.20, 1.0, 1.2]
    regions = frame(spark, [(0.1, 0.1, None, 0.3, 0.7)], "x double, y double, z double, radius_m double, z_margin_m double")
    for method in ("adaptive_grid", "adaptive_plane"):  # without a gate all six are protected, with it those above it
        assert ground.remove_ground(p, "frame", "point_index", replace(open_, method=method), regions).count() == 6
        assert ground.remove_ground(p, "frame", "point_index", Ground(method=method), regions).count() == 4
        assert ground.remove_ground(p, "frame", "point_index", Ground(method=method, z=(0.0, 1.1))).where("z > 1.1").count() == 0
    with pytest.raises(ValueError):
        ground.remove_ground(p, "frame", "point_index", Ground(method="none"))


def test_plane_of_collinear_points_is_minimum_norm():
    rng = np.random.default_rng(5)
    groups = [np.ones((2, 3)), np.array([[0.0, 0, 1]] * 3), *(rng.uniform(-10, 10, (n, 3)) for n in (3, 4, 9)), np.array([[0.2, 0.2, 1], [0.4, 0.4, 2], [0.8, 0.8, 4]])]
    sums = [{"n": len(p), **{"s" + c: p[:, "xyz".index(c)].sum() for c in "xyz"},
             **{"s" + a + b: (p[:, "xyz".index(a)] * p[:, "xyz".index(b)]).sum() for a, b in ("xx", "xy", "yy", "xz", "yz")}} for p in groups]
    found = ground.fit_planes(pd.DataFrame(sums)).to_numpy()
    assert np.isnan(found[0]).all()
    for p, got in zip(groups[1:], found[1:]):
        want = np.linalg.lstsq(np.column_stack([p[:, 0], p[:, 1], np.ones(len(p))]), p[:, 2], rcond=None)[0]
        assert got == pytest.approx(want, abs=1e-7)


def test_plane_ground_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 2, i, *map(float, np.round(rng.uniform(-2, 2, 2), 1)), float(np.round(rng.uniform(-1, 2), 2))) for i in range(300)]
    g = Ground(method="adaptive_plane", cell=1.0, z=(-0.5, 1.8), clearance=0.0703, fallback_clearance=0.1103)
    df = frame(spark, rows, "frame int, point_index long, x double, y double, z double")
    got = {r.point_index for r in ground.remove_ground(df, "frame", "point_index", g).collect()}
    want, cells = set(), {}
    for f, i, x, y, z in rows:
        if g.z[0] <= z <= g.z[1]:
            cells.setdefault((f, int(np.floor(x)), int(np.floor(y))), []).append((i, x, y, z))
    low = {}
    for key, own in cells.items():
        zs = [p[3] for p in own]
        level, room = (min(zs), 0.1103) if len(own) < g.min_points else (np.quantile(zs, g.quantile), 0.0703)
        low[key] = (min(own, key=lambda p: (abs(p[3] - level), p[0])), level, room)
    for (f, a, b), own in cells.items():
        near = [low[k][0] for k in [(f, a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)] if k in low]
        _, level, room = low[f, a, b]
        m = np.array([[p[1], p[2], 1.0] for p in near])
        plane = np.linalg.lstsq(m, np.array([p[3] for p in near]), rcond=None)[0] if len(near) >= 3 else np.array([0, 0, level])
        want |= {i for i, x, y, z in own if z - plane @ [x, y, 1.0] > room}
    assert got == want


def test_outliers(spark):
    p = frame(spark, [(0, 0., 0., 0.), (0, 1., 0., 0.), (0, 0., 1., 0.), (0, 0., 0., 1.), (0, 9., 9., 9.)], "g int, x double, y double, z double")
    assert filters.outliers_removed(p, "g").where("x = 9").count() == 0
    assert filters.outliers_removed(p, "g").count() == 4


def brute_clusters(xyz, tolerance):
    label = list(range(len(xyz)))
    for i in range(len(xyz)):
        for j in range(i):
            if np.linalg.norm(xyz[i] - xyz[j]) <= tolerance and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    return label


def test_clusters_against_brute_force_and_translation(spark):
    rng = np.random.default_rng(3)
    xyz = rng.uniform(0, 4, (150, 3))
    want = brute_clusters(xyz, 0.45)
    c = Clustering(min_points=1)
    for shift in (0.0, -7.3):
        p = frame(spark, [(0, i, *(v + shift).tolist()) for i, v in enumerate(xyz)], "frame int, id long, x double, y double, z double")
        got = {r.id: r.cluster_id for r in cluster.eps_clusters(p, "frame", "id", c).collect()}
        roots = sorted(set(want))
        assert [got[i] for i in range(150)] == [roots.index(v) for v in want]
    with pytest.raises(ValueError):
        cluster.eps_clusters(p, "frame", "id", Clustering(tolerance=0))


def test_components_of_a_long_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(links).collect()} == {0}
    assert connected_components(links.where("a < 0")).count() == 0


def test_candidate_score_and_footpoint(spark):
    stats = frame(spark, [(0, 0, 80, 0.6, 0.4, 1.6)], "frame int, cluster_id int, point_count long, size_x double, size_y double, size_z double")
    assert stats.select(cluster.candidate_score(Person())).first()[0] == pytest.approx(0.898485, abs=1e-6)
    rows = [(0, 0, 0.0, 0.0, 0.0), (0, 0, 1.0, 1.0, 0.31), (0, 0, 5.0, 5.0, 0.33), (0, 0, 5.0, 5.0, 1.6)]
    c = frame(spark, rows, "frame int, cluster_id int, x double, y double, z double")
    f = cluster.footpoints(c, cluster.cluster_stats(c, "frame"), "frame").first()
    assert (f.foot_x, f.foot_y, f.foot_z) == (0.5, 0.5, 0.0)


def test_merge_grows_its_base():
    box = lambda x, z: {"min_x": x, "min_y": 0, "min_z": z, "max_x": x, "max_y": 0, "max_z": z + 1, "point_count": 10}
    stats = pd.DataFrame([box(0, 0), box(0.3, 1.5), box(0.7, 3.0), box(9, 0)])
    assert cluster.merge_stacked(stats).tolist() == [0, 0, 0, 1]


def test_marker_groups(spark):
    d = frame(spark, [(0, i, m, 0.0, 0.0, 0.0) for i, m in enumerate((3, 17, 2))], "frame int, det int, marker_id int, tx double, ty double, tz double")
    g = markers.group_table(d, TARGET_GROUPS)
    targets = markers.group_targets(d, g, "frame", "det")
    assert targets.count() == 2
    assert [r.group_index for r in filters.valid_groups(targets).collect()] == [0]
    frames = d.groupBy("frame").agg(F.collect_list("marker_id").alias("marker_ids"))
    rows = {r.group_index: (r.visible_ids, r.missing_ids) for r in markers.matched_groups(frames, g).collect()}
    assert rows == {0: ([3, 17], [42, 88]), 1: ([2], [19, 55, 81])}
    assert markers.normalise_groups(4) == [[4]] and markers.normalise_groups([[1], [2]]) == [[1], [2]]


def series(spark, rows):
    return frame(spark, rows, "k string, ts double, v double")


def test_asof_and_nearest(spark):
    cam = series(spark, [("a", .0, 0.), ("a", .1, 1.), ("a", .2, 2.)])
    lid = series(spark, [("a", .14, 0.), ("a", .29, 0.), ("a", -1., 0.), ("b", 0., 0.)])
    got = {r.ts: r.m and r.m.ts for r in timejoin.asof_backward(lid, cam, "k", width=0.07).collect()}
    assert got == {.14: .1, .29: .2, -1.: None, 0.: None}
    assert timejoin.asof_backward(lid, cam, "k", width=0.07, tolerance=.08).where("ts > 0.2 AND m IS NOT NULL").count() == 0
    tie = timejoin.asof_nearest(series(spark, [("a", 1., 0.)]), series(spark, [("a", 0., 5.), ("a", 2., 6.)]), "k", width=0.5).first()
    assert tie.m.v == 5.
    alone = timejoin.asof_nearest(series(spark, [("a", -4., 0.)]), series(spark, [("a", 0., 5.)]), "k").first()
    assert alone.m.v == 5.


def test_pose_clamps(spark):
    poses = series(spark, [("a", 0., 350.), ("a", 10., 10.)])
    f = frame(spark, [("a", t) for t in (-1., 5., 11.)], "k string, ts double")
    got = {r.ts: (r.pose_ts, r.v) for r in timejoin.interpolate_poses(f, poses, "k", [], ["v"]).collect()}
    assert got == {-1.: (-1., 350.), 5.: (5., 360.), 11.: (10., 10.)}


def test_spikes_gaps(spark):
    t = frame(spark, [("a", .0, 0., 0.), ("a", .1, 10., 0.), ("a", .2, .1, 0.)], "k string, ts double, e double, n double")
    assert sorted(r.e for r in trajectory.reject_spikes(t, "k", "ts", ["e", "n"], 5.0).collect()) == [0., .1]
    rows = [("a", 0., 0., 0., 0., True), ("a", .25, None, None, None, False), ("a", 1., 1., 2., 0., True), ("a", 2., None, None, None, False), ("a", 3.5, 0., 0., 0., True)]
    g = frame(spark, rows, "k string, ts double, e double, n double, u double, seen boolean")
    filled = {r.ts: (r.e, r.n, r.interpolated) for r in trajectory.fill_gaps(g, "k", "ts", "seen", ["e", "n", "u"], 2.0).collect()}
    assert filled[.25] == (.25, .5, True) and 2. not in filled and filled[1.] == (1., 2., False)
    gap = trajectory.long_gaps(g, "k", "ts", "seen", 2.0).collect()
    assert [(r.start, r.stop, r.missing) for r in gap] == [(1., 3.5, 1)]


def test_alpha_filter_and_quality():
    t = trackers.Single(Tracker())
    states = [t.step(ts, [((x, 0., 0.), 1.0)]) for ts, x in ((0., 0.), (.1, 1.), (.2, 2.))]
    assert [s.pos[0] for s in states] == pytest.approx([0, .65, 1.755]) and states[2].vel[0] == pytest.approx(11.05)
    assert (t.quality, t.lifecycle) == (pytest.approx(.525448), "confirmed")
    t.step(.3, [])
    assert t.quality == pytest.approx(.451885)


def test_multi_tracker_quirks():
    m = trackers.Multi(Tracker())
    out = [m.step(ts, [(x, 0., 0.)]) for ts, x in ((0., 0.), (.1, 1.), (.2, 2.))]
    assert [len(o) for o in out] == [0, 0, 1] and out[2][0][0] == 1
    i, track = m.step(.3, [])[0]
    assert (i, track.state.source, track.misses, track.state.pos[0]) == (1, "observed", 1, pytest.approx(1.755))
    assert [i for i, _ in m.step(.9, [(2., 0., 0.)])] == [1] and sorted(m.tracks) == [1, 2]


def test_greedy_matches():
    p = pd.DataFrame({"candidate_id": [0, 0, 1], "track_id": [1, 2, 1], "distance": [.2, .3, .1]})
    got = spatial.greedy_matches(p)
    assert list(zip(got.candidate_id, got.track_id)) == [(1, 1), (0, 2)]


def test_hull_join_keeps_edges(spark):
    corners = frame(spark, [(0, 0, float(u), float(v)) for u, v in ((0, 0), (4, 0), (4, 4), (0, 4), (2, 2))], "frame int, group_index int, u double, v double")
    h = spatial.hulls(corners, ["frame", "group_index"])
    assert h.first().area == 16.0 and len(h.first().hull) == 4
    p = frame(spark, [(0, 1, 4.0, 2.0), (0, 2, 5.0, 2.0), (0, 3, 1.5, 1.5)], "frame int, id int, u double, v double")
    assert sorted(r.id for r in spatial.hull_join(p, h, "frame").collect()) == [1, 3]


def test_sampling_and_clips(spark):
    d = spark.range(20).withColumnRenamed("id", "i")
    assert [r.i for r in filters.every_n(d, "i", 4, 2, 3).orderBy("i").collect()] == [2, 6, 10]
    t = spark.range(12).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("ts"))
    assert trajectory.downsample(t, "k", ["ts"], 5).count() == 6
    with pytest.raises(ValueError):
        filters.region_of_interest(d, "star")


def test_marker_history_and_prediction():
    m = trackers.Marker(size=2, allow_prediction=True)
    assert m.predict(0.0) is None
    for ts, x in ((0., 0.), (1., 1.), (2., 3.)):
        m.observe(ts, (x, 0., 0.))
    assert len(m.history) == 2 and m.predict(2.5).pos[0] == 4.0 and m.predict(3.5) is None
    assert trackers.Marker().predict(0.0) is None


def test_segments(spark):
    from sensorlake.operators import segments

    classes = frame(spark, [(0, 0, 1, .9), (0, 1, 2, .95), (0, 2, 1, .9)], "image int, query int, class_id int, p double")
    masks = frame(spark, [(0, q, px, m) for q, px, m in ((0, 0, .9), (0, 1, .1), (1, 1, .9), (1, 0, .2), (2, 2, .8))], "image int, query int, pixel int, m double")
    assert {r.pixel: r.class_id for r in segments.semantic(classes, masks, "image").collect()} == {0: 1, 1: 2, 2: 1}
    stuff = {r.pixel: r.segment for r in segments.panoptic(classes, masks, "image").collect()}
    assert stuff[0] == stuff[2] != stuff[1]
    things = {r.pixel: r.segment for r in segments.panoptic(classes, masks, "image", things=(1, 2)).collect()}
    assert len(set(things.values())) == 3
    assert [r.query for r in segments.instances(classes, masks, "image", 1).collect()] == [1]


def test_hulls_of_parts_of_one_group(spark, monkeypatch):
    rng = np.random.default_rng(4)
    cloud = np.concatenate([rng.normal(0, 5, (6000, 2)), rng.integers(-12, 13, (3000, 2)).astype(float), [[40.0, -3.0]]])
    rows = [("a", float(x), float(y), 1) for x, y in cloud] + [("b", 1.0, 2.0, 1), ("b", 1.0, 2.0, 1), (None, 0.0, 0.0, 2), (None, 3.0, 0.0, 2), (None, None, 5.0, 2), ("c", float("nan"), 1.0, 3)]
    points = spark.createDataFrame(rows, "key string, u double, v double, salt long").repartition(9)
    want = spatial.convex_hull(cloud[:, 0], cloud[:, 1])
    found = {r["key"]: r for r in spatial.hulls(points, ["key", "salt"], salts=5).collect()}
    assert set(found) == {"a", "b", None} and [(p["x"], p["y"]) for p in found["a"]["hull"]] == [tuple(p) for p in want.tolist()]
    assert len(found["b"]["hull"]) == 1 and found[None]["area"] == 0.0 and found[None]["salt"] == 2 and found["a"]["x_max"] == 40.0
    assert spatial.hulls(points.where("false"), ["key"]).collect() == []


def test_what_lies_well_inside_is_left_out_before_a_hull():
    rng = np.random.default_rng(5)
    for scale in (1e-6, 1.0, 1e9):
        xy = rng.normal(0, scale, (2000, 2))
        some = xy[spatial.outermost(xy[:, 0], xy[:, 1])]
        assert len(some) < 1500
        np.testing.assert_array_equal(spatial.convex_hull(some[:, 0], some[:, 1]), spatial.convex_hull(xy[:, 0], xy[:, 1]))
