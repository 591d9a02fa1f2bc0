"""Typed configuration with the default values of the field set-up (fixed values)."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Roi:
    center: tuple[float, float] = (0.0, 0.0)
    min_radius: float = 0.5
    radius: float = 10.0
    x: tuple[float, float] | None = None
    y: tuple[float, float] | None = None
    z: tuple[float, float] | None = (-1.5, 3.0)


@dataclass(frozen=True)
class LocalRoi:
    half_x: float = 3.2
    half_y: float = 2.8
    z_offsets: tuple[float, float] = (-1.2, 1.8)
    expand_after: int = 2
    expanded_half_x: float = 4.8
    expanded_half_y: float = 4.2
    expanded_z_offsets: tuple[float, float] = (-1.4, 2.0)
    min_points: int = 180


@dataclass(frozen=True)
class EgoBox:
    enabled: bool = False
    x: tuple[float, float] = (-2.5, 1.5)
    y: tuple[float, float] = (-1.2, 1.2)
    z: tuple[float, float] = (-2.0, 2.0)


@dataclass(frozen=True)
class Ground:
    method: str = "adaptive_grid"
    z: tuple[float, float] = (0.12, 3.0)
    cell: float = 0.45
    quantile: float = 0.12
    clearance: float = 0.07
    min_points: int = 6
    fallback_clearance: float = 0.11
    radius_cells: int = 1


@dataclass(frozen=True)
class Clustering:
    tolerance: float = 0.45
    min_points: int = 6
    max_points: int = 5000
    merge_xy: float = 0.55
    merge_z_gap: float = 0.9
    merge_max_points: int = 8000


@dataclass(frozen=True)
class Person:
    min_points: int = 4
    height: tuple[float, float] = (0.5, 2.6)
    width: tuple[float, float] = (0.10, 1.8)
    depth: tuple[float, float] = (0.08, 1.8)
    height_preferred: float = 1.6
    width_preferred: float = 0.7
    depth_preferred: float = 0.6
    points_preferred: float = 80.0


#: The person filter when a marker is in view.
PERSON_WITH_MARKER = Person(min_points=3, height=(0.4, 2.8), width=(0.08, 2.2), depth=(0.08, 2.2))


@dataclass(frozen=True)
class Tracker:
    gate: float = 1.2
    allow_prediction: bool = False
    max_prediction_s: float = 0.6
    gain: float = 0.65
    confirm_hits: int = 3
    forget_misses: int = 8
    quality_gain: float = 0.22
    quality_decay: float = 0.86
    marker_sigma: float = 0.95
    hard_gate: float = 2.2
    min_combined: float = 0.03
    motion_sigma: float = 0.5


@dataclass(frozen=True)
class Motion:
    """Limits of the motion-consistency rules; None: the rule is off."""

    max_marker_distance: float | None = None
    max_foot_z: float = 0.8
    max_planar_jump: float = 1.0
    max_vertical_jump: float = 0.6
    max_planar_speed: float = 3.5
    max_vertical_speed: float = 2.5
    near_marker: float = 0.9
    near_foot_z: float = 1.45
    near_planar_jump: float = 2.6
    near_planar_speed: float = 7.0
    with_marker: tuple[float, float, float] = (1.5, 2.2, 6.5)  # foot z, planar jump, planar speed
    reconnect_after: int = 2
    reconnect: tuple[float, float, float] = (1.4, 3.8, 7.0)
    rescue: tuple[float, float, float] = (1.4, 2.0, 1.5)  # foot z, planar jump, marker distance


@dataclass(frozen=True)
class Extrinsics:
    """Base from lidar (FLU) and span (RFU) from base."""

    r_base_lidar: tuple = ((0.9063, 0.0, 0.4226), (0.0, 1.0, 0.0), (-0.4226, 0.0, 0.9063))
    t_base_lidar: tuple = (0.0315, 0.0, 0.1314)
    r_span_base: tuple = ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0))
    t_span_base: tuple = (0.0, 0.1854, 0.242)


@dataclass(frozen=True)
class Camera:
    fx: float = 464.8906509662917
    fy: float = 465.0582538242402
    cx: float = 631.6777733624097
    cy: float = 523.4363256680425
    k: tuple[float, ...] = (-0.017366953282639, 0.000574174219028, -0.00154438708609, 0.000549409825028)
    r_lidar_camera: tuple = (
        (-0.0248760658442102, 0.4141228407617354, 0.9098810109610734),
        (-0.9996892397064623, -0.008835361707340894, -0.0233100922052239),
        (-0.001614113759963343, -0.9101781194595544, 0.4142139368657687),
    )
    t_lidar_camera: tuple = (0.051401176491, 0.015593452288, -0.06077996213)


TARGET_GROUPS = ((3, 17, 42, 88), (2, 19, 55, 81))
SYNC_TOLERANCE_S = 0.08
MAX_SPIKE_SPEED = 5.0
MAX_GAP_S = 2.0


_SECTIONS = {"roi": Roi, "local_roi": LocalRoi, "ego": EgoBox, "ground": Ground, "clustering": Clustering, "person": Person, "tracker": Tracker,
             "motion": Motion, "extrinsics": Extrinsics, "camera": Camera}


def configured(mapping: dict) -> dict:
    """Typed sections of a configuration; sections and entries that are left out have their defaults, unknown ones are an error."""
    unknown = set(mapping) - set(_SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    found = {}
    for name, kind in _SECTIONS.items():
        own = mapping.get(name) or {}
        strange = set(own) - {f.name for f in fields(kind)}
        if strange:
            raise ValueError(f"unknown entries of {name}: {sorted(strange)}")
        found[name] = kind(**{k: _frozen(v) for k, v in own.items()})
    return found


def _frozen(value):
    return tuple(map(_frozen, value)) if isinstance(value, list) else value


def read_config(path: str) -> dict:
    """Typed sections of a JSON or (where a YAML parser is installed) YAML file on the driver."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return configured(yaml.safe_load(text) or {})
    return configured(json.loads(text))
