"""Geofence checks on a stream of fixes: a stateless stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from meridian.operators import joins


def geofence(fixes: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """(fix_id, zone_id) of fixes (fix_id, x, y; batch or stream) inside zones (zone_id, polygon)."""
    return joins.spatial_join(fixes, zones, size, point_id="fix_id")


def start(fixes: DataFrame, zones: DataFrame, size: float, path: str, checkpoint: str) -> StreamingQuery:
    """Writes breaches as Parquet until stopped; append mode, no state."""
    return geofence(fixes, zones, size).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
