"""Pose of square markers from their corners: homography by DLT, both planar solutions refined, the better one kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 15
POSE = "rx double, ry double, rz double, tx double, ty double, tz double, error double, other_error double"


def square(size: float) -> np.ndarray:
    """Corners in the marker's plane, from the upper left one clockwise."""
    h = size / 2
    return np.array([[-h, h, 0.0], [h, h, 0.0], [h, -h, 0.0], [-h, -h, 0.0]])


def homographies(seen: np.ndarray, plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3, 3) homographies from plane (4, 2) to seen (n, 4, 2), and which of them exist (no three corners on a line)."""
    x, y = np.broadcast_to(plane[:, 0], seen.shape[:2]), np.broadcast_to(plane[:, 1], seen.shape[:2])
    u, v, one, none = seen[..., 0], seen[..., 1], np.ones(seen.shape[:2]), np.zeros(seen.shape[:2])
    rows = np.concatenate([np.stack([x, y, one, none, none, none, -u * x, -u * y], axis=-1), np.stack([none, none, none, x, y, one, -v * x, -v * y], axis=-1)], axis=1)
    turn = lambda i, j, k: np.abs((seen[:, j, 0] - seen[:, i, 0]) * (seen[:, k, 1] - seen[:, i, 1]) - (seen[:, j, 1] - seen[:, i, 1]) * (seen[:, k, 0] - seen[:, i, 0]))
    spread = np.square(seen - seen.mean(axis=1, keepdims=True)).sum(axis=(1, 2))
    ok = np.isfinite(spread) & (np.min([turn(*c) for c in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))], axis=0) > 1e-12 * spread) & (spread > 0)
    rows = np.where(ok[:, None, None], rows, np.eye(8))
    h = np.linalg.solve(rows, np.concatenate([u, v], axis=1)[..., None])[..., 0]
    return np.concatenate([h, np.ones((len(h), 1))], axis=1).reshape(-1, 3, 3), ok


def turned(w: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors."""
    angle = np.linalg.norm(w, axis=1)
    k = w / np.where(angle > 0, angle, 1.0)[:, None]
    zero = np.zeros(len(w))
    cross = np.stack([zero, -k[:, 2], k[:, 1], k[:, 2], zero, -k[:, 0], -k[:, 1], k[:, 0], zero], axis=1).reshape(-1, 3, 3)
    return np.eye(3) + np.sin(angle)[:, None, None] * cross + (1 - np.cos(angle))[:, None, None] * (cross @ cross)


def vectors(m: np.ndarray) -> np.ndarray:
    """Rotation vectors of rotation matrices, through quaternions by their largest part."""
    d = np.einsum("nii->ni", m)
    q2 = np.stack([1 + d.sum(axis=1), *(1 + 2 * d[:, i] - d.sum(axis=1) for i in range(3))], axis=1) / 4
    s = lambda i, j: m[:, i, j] + m[:, j, i]
    a = lambda i, j: m[:, i, j] - m[:, j, i]
    rows = np.stack([np.stack([4 * q2[:, 0], a(2, 1), a(0, 2), a(1, 0)], axis=1), np.stack([a(2, 1), 4 * q2[:, 1], s(0, 1), s(0, 2)], axis=1),
                     np.stack([a(0, 2), s(0, 1), 4 * q2[:, 2], s(1, 2)], axis=1), np.stack([a(1, 0), s(0, 2), s(1, 2), 4 * q2[:, 3]], axis=1)], axis=1)
    q = rows[np.arange(len(m)), q2.argmax(axis=1)]
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    q = np.where(q[:, :1] < 0, -q, q)
    n = np.linalg.norm(q[:, 1:], axis=1)
    return q[:, 1:] * np.where(n > 1e-12, 2 * np.arctan2(n, q[:, 0]) / np.where(n > 0, n, 1.0), 2.0)[:, None]


def from_homography(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation, with the marker in front of the camera."""
    scale = 2 / (np.linalg.norm(h[:, :, 0], axis=1) + np.linalg.norm(h[:, :, 1], axis=1))
    g = h * scale[:, None, None]
    u, _, vt = np.linalg.svd(np.stack([g[:, :, 0], g[:, :, 1], np.cross(g[:, :, 0], g[:, :, 1])], axis=2))
    u[:, :, 2] *= np.linalg.det(u @ vt)[:, None]
    return u @ vt, g[:, :, 2]


def mirrored(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """About where the other planar solution lies: the marker's tilt reversed about the line of sight."""
    sight = t / np.linalg.norm(t, axis=1, keepdims=True)
    return turned(np.pi * sight) @ r @ np.diag([-1.0, -1.0, 1.0])


def refined(r: np.ndarray, t: np.ndarray, seen: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gauss-Newton with damping on the reprojection; (rotation, translation, root mean square error)."""
    damping = np.full(len(t), 1e-6)

    def off(r, t):
        p = corners @ r.transpose(0, 2, 1) + t[:, None, :]
        return p, p[..., :2] / p[..., 2:] - seen

    p, e = off(r, t)
    for _ in range(STEPS):
        own, z = p - t[:, None, :], p[..., 2]
        zero = np.zeros_like(z)
        image = np.stack([np.stack([1 / z, zero, -p[..., 0] / z**2], axis=-1), np.stack([zero, 1 / z, -p[..., 1] / z**2], axis=-1)], axis=-2)
        cross = np.stack([zero, own[..., 2], -own[..., 1], -own[..., 2], zero, own[..., 0], own[..., 1], -own[..., 0], zero], axis=-1).reshape(*z.shape, 3, 3)
        j = np.concatenate([image @ cross, image], axis=-1).reshape(len(t), 8, 6)
        normal = j.transpose(0, 2, 1) @ j
        normal = normal + damping[:, None, None] * np.eye(6) * np.einsum("nii->n", normal)[:, None, None]
        step = np.linalg.solve(normal, -(j.transpose(0, 2, 1) @ e.reshape(-1, 8, 1)))[..., 0]
        r2, t2 = turned(step[:, :3]) @ r, t + step[:, 3:]
        p2, e2 = off(r2, t2)
        better = (np.square(e2).sum(axis=(1, 2)) <= np.square(e).sum(axis=(1, 2))) & (p2[..., 2] > 0).all(axis=1)
        pick = lambda a, b: np.where(better.reshape(-1, *[1] * (a.ndim - 1)), a, b)  # noqa: E731, B023
        r, t, p, e = pick(r2, r), pick(t2, t), pick(p2, p), pick(e2, e)
        damping = np.where(better, damping / 10, damping * 10)
    return r, t, np.sqrt(np.square(e).sum(axis=(1, 2)) / 4)


def poses(seen: np.ndarray, size: float) -> np.ndarray:
    """(n, 8) POSE from corners (n, 4, 2) in normalised image coordinates; NaN where the corners make no quadrilateral."""
    corners = square(size)
    out = np.full((len(seen), 8), np.nan)
    h, ok = homographies(seen, corners[:, :2])
    if not ok.any():
        return out
    r, t = from_homography(h[ok])
    found = [refined(m, t, seen[ok], corners) for m in (r, mirrored(r, t))]
    first = found[0][2] <= found[1][2]
    pick = lambda i: np.where(first.reshape(-1, *[1] * (found[0][i].ndim - 1)), found[0][i], found[1][i])
    out[ok] = np.concatenate([vectors(pick(0)), pick(1), pick(2)[:, None], np.where(first, found[1][2], found[0][2])[:, None]], axis=1)
    return out


def marker_poses(detections: DataFrame, size: float, corners: str = "corners") -> DataFrame:
    """detections with POSE in place of `corners`: rotation vector and translation from marker to camera, the error of this
    solution and of the other one (root mean square, in normalised image coordinates).

    corners: x1, y1, ... x4, y4, undistorted and divided by the focal length, from the upper left clockwise.  Null, too short or
    too long lists and corners on a line have a null pose.
    """
    kept = [c for c in detections.columns if c != corners]
    names = [c.split()[0] for c in POSE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.full((batch.num_rows, 8), np.nan)
            ok = batch.column(len(kept)).is_valid().to_numpy(zero_copy_only=False)
            seen[ok] = batch.column(len(kept)).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, 8)
            found = poses(seen.reshape(-1, 4, 2), size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(found[:, i], from_pandas=True) for i in range(8)]], names=[*kept, *names])

    schema = ", ".join(f"`{c}` {detections.schema[c].dataType.simpleString()}" for c in kept)
    eight = F.when((F.size(corners) == 8) & F.forall(corners, lambda x: x.isNotNull()), F.col(corners).cast("array<double>"))
    return detections.select(*kept, eight.alias(corners)).mapInArrow(run, f"{schema}, {POSE}")
