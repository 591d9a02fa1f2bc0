import numpy as np

from sensorlake.operators import marker_pose as mp


def planted(n, seed, tilt=1.0):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(n, 3))
    w = w / np.linalg.norm(w, axis=1, keepdims=True) * rng.uniform(0, tilt, (n, 1))
    t = np.stack([rng.uniform(-0.8, 0.8, n), rng.uniform(-0.8, 0.8, n), rng.uniform(1.5, 6.0, n)], axis=1)
    p = mp.square(0.4) @ mp.turned(w).transpose(0, 2, 1) + t[:, None, :]
    return w, t, p[..., :2] / p[..., 2:]


def test_projected_poses_are_recovered():
    for tilt in (1.2, 3.1):  # up to markers seen from behind
        w, t, seen = planted(3000, 1, tilt)
        out = mp.poses(seen, 0.4)
        r, want = mp.turned(out[:, :3]), mp.turned(w)
        facing = np.abs(np.einsum("ni,ni->n", want[:, :, 2], t) / np.linalg.norm(t, axis=1)) > 0.05  # not seen edge-on
        assert np.abs(r - want)[facing].max() < 1e-6 and np.abs(out[:, 3:6] - t)[facing].max() < 1e-6 and out[facing, 6].max() < 1e-9
        assert facing.mean() > 0.9 and (out[:, 7] >= out[:, 6]).all()


def test_the_better_of_the_two_solutions_is_kept_under_noise():
    w, t, seen = planted(2000, 2)
    noisy = seen + np.random.default_rng(3).normal(0, 2e-4, seen.shape)
    out = mp.poses(noisy, 0.4)
    corners = mp.square(0.4)
    exact = corners @ mp.turned(w).transpose(0, 2, 1) + t[:, None, :]
    of_truth = np.sqrt(np.square(exact[..., :2] / exact[..., 2:] - noisy).sum(axis=(1, 2)) / 4)
    assert (out[:, 6] <= of_truth + 1e-9).mean() > 0.999  # no worse than the planted pose
    tilted = np.abs(mp.turned(out[:, :3]) - mp.turned(w)).max(axis=(1, 2)) > 0.3  # the other solution fitted better
    assert tilted.mean() < 0.15 and np.median(np.abs(out[:, 3:6] - t).max(axis=1)) < 0.02


def test_vectors_invert_turned():
    rng = np.random.default_rng(4)
    w = rng.normal(size=(500, 3))
    w = w / np.linalg.norm(w, axis=1, keepdims=True) * np.r_[np.zeros(1), np.full(1, np.pi), rng.uniform(0, np.pi, 498)][:, None]
    np.testing.assert_allclose(mp.turned(mp.vectors(mp.turned(w))), mp.turned(w), atol=1e-12)


def test_columns_nulls_and_degenerate_corners(spark):
    w, t, seen = planted(40, 5)
    rows = [(i, [float(x) for x in c.ravel()], "a") for i, c in enumerate(seen)]
    rows += [(100, None, "a"), (101, [1.0] * 8, "a"), (102, [0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 0.0, 1.0], "a"), (103, [1.0], "a"), (104, [None] * 8, "a"), (105, [float("nan")] * 8, "a")]
    df = spark.createDataFrame(rows, "id long, corners array<double>, `no te` string").repartition(5)
    got = {r["id"]: r for r in mp.marker_poses(df, 0.4).collect()}
    assert len(got) == 46 and all(got[i]["rx"] is None and got[i]["error"] is None for i in range(100, 106))
    assert max(abs(got[i][c] - t[i, k]) for i in range(40) for k, c in enumerate(("tx", "ty", "tz"))) < 1e-6
    assert mp.marker_poses(df.where("false"), 0.4).collect() == []
