"""Meridian: geospatial vector and raster analytics as Spark DataFrame plans."""
