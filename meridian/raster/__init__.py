"""raster"""
