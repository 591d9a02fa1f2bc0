"""Registered queries of the library's own operators and their SQL."""

from sensorlake.queries import base, geometry, points, recordings, reports, series  # noqa: F401
from sensorlake.queries.base import ORACLES, QUERIES  # noqa: F401
