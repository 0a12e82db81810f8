"""crs"""
