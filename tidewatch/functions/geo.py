"""Geodesy as Column expressions; points are longitude first, angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE_LAT, KM_PER_DEGREE_LON = 110.574, 111.320


def round_to(x: Column, digits: int) -> Column:
    """Half up on the scaled double, the same in any engine."""
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def haversine_km(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    half_lat, half_lon = F.radians(lat_b - lat_a) / 2.0, F.radians(lon_b - lon_a) / 2.0
    h = F.pow(F.sin(half_lat), 2.0) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(half_lon), 2.0)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """A point of the unit sphere. Joins compare squared chords of such points instead of taking sines for every pair."""
    x, y = F.radians(lon), F.radians(lat)
    return F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)


def chord2_of(km: Column) -> Column:
    """The squared chord that spans so many km on the unit sphere."""
    half = F.sin(km / F.lit(2 * EARTH_RADIUS_KM))
    return 4.0 * half * half


def chord2_km(chord2: Column) -> Column:
    """The km that a squared chord spans."""
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), chord2 / 4.0)))


def bearing_deg(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Initial bearing, 0 to 360 clockwise from north."""
    turn = F.radians(lon_b - lon_a)
    y = F.sin(turn) * F.cos(F.radians(lat_b))
    x = F.cos(F.radians(lat_a)) * F.sin(F.radians(lat_b)) - F.sin(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def angular_difference_deg(a: Column, b: Column) -> Column:
    """Between two bearings, 0 to 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def axial_difference_deg(a: Column, b: Column) -> Column:
    """Between two axes without head or tail, 0 to 90."""
    return F.abs(F.pmod(a - b + 90.0, F.lit(180.0)) - 90.0)


def destination_point(lon: Column, lat: Column, bearing: Column, km: Column) -> Column:
    """struct(lon, lat) reached along a great circle; longitude in [-180, 180)."""
    angle, course, phi = km / EARTH_RADIUS_KM, F.radians(bearing), F.radians(lat)
    sin_lat = F.sin(phi) * F.cos(angle) + F.cos(phi) * F.sin(angle) * F.cos(course)
    turn = F.atan2(F.sin(course) * F.sin(angle) * F.cos(phi), F.cos(angle) - F.sin(phi) * sin_lat)
    return F.struct((F.pmod(lon + F.degrees(turn) + 180.0, F.lit(360.0)) - 180.0).alias("lon"), F.degrees(F.asin(sin_lat)).alias("lat"))


def offset_by_metres(lon: Column, lat: Column, east: Column, north: Column) -> Column:
    """struct(lon, lat) moved on a flat earth; for steps of a few kilometres."""
    per_lon = KM_PER_DEGREE_LON * 1000 * F.cos(F.radians(lat))
    moved = F.when(F.abs(per_lon) > 1e-9, lon + east / per_lon).otherwise(lon)
    return F.struct(moved.alias("lon"), (lat + north / (KM_PER_DEGREE_LAT * 1000)).alias("lat"))


def pixel_to_lonlat(row: Column, col: Column, rows: Column, cols: Column, box: tuple[float, float, float, float]) -> Column:
    """struct(lon, lat) of a pixel; row 0 is the north edge."""
    west, south, east, north = box
    lon = west + (east - west) * col / F.greatest(F.lit(1), cols - 1)
    return F.struct(lon.alias("lon"), (north - (north - south) * row / F.greatest(F.lit(1), rows - 1)).alias("lat"))


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return lon.between(west, east) & lat.between(south, north)


def expand_box(west: Column, south: Column, east: Column, north: Column, km: Column) -> Column:
    """struct(west, south, east, north) grown by km on each side, within the globe."""
    per_lon = KM_PER_DEGREE_LON * F.cos(F.radians((south + north) / 2.0))
    d_lon, d_lat = F.when(F.abs(per_lon) > 1e-9, km / per_lon).otherwise(F.lit(180.0)), km / KM_PER_DEGREE_LAT
    return F.struct(
        F.greatest(F.lit(-180.0), west - d_lon).alias("west"), F.greatest(F.lit(-90.0), south - d_lat).alias("south"),
        F.least(F.lit(180.0), east + d_lon).alias("east"), F.least(F.lit(90.0), north + d_lat).alias("north"),
    )
