"""Point validation predicates (P7, P8) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_point(lat: Column, lon: Column) -> Column:
    """Both present and strictly inside (-90, 90) x (-180, 180)."""
    return (F.coalesce((lat > -90.0) & (lat < 90.0) & (lon > -180.0) & (lon < 180.0)
                       & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False)))


# The three point messages of the location check.
POINT_MESSAGES = {
    "start_point": "Start point coordinates, start_latitude/start_longitude, are invalid",
    "end_point": "End point coordinates, end_latitude/end_longitude, are invalid",
    "o_point": "Orientation point coordinates, o_latitude/o_longitude, are invalid",
}


def point_errors(points: dict[str, tuple[Column, Column]]) -> Column:
    """array<string> of the messages of the invalid points, in order."""
    msgs = [F.when(~valid_point(lat, lon), F.lit(POINT_MESSAGES[name]))
            for name, (lat, lon) in points.items()]
    return F.filter(F.array(*msgs), lambda m: m.isNotNull())
