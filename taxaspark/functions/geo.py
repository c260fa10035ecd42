"""Great-circle distance as a column expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = (p2 - p1) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))
