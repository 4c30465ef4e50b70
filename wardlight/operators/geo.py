"""Photo position checks, coordinate conversion and grid aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions.columns import as_of_ts, col, euclid, haversine_m
from wardlight.functions.measures import n_rows
from wardlight.sources.tables import latest_per_key


def gps_verified(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """1 when photo and request are closer than `tolerance` degrees; NULL if a coordinate is missing.

    A stated photo position wins over the one in the photo's metadata.
    """
    lat = F.coalesce("photo_lat", "meta_lat").cast("double")
    lng = F.coalesce("photo_lng", "meta_lng").cast("double")
    apart = euclid(lat, lng, F.col("request_lat").cast("double"), F.col("request_lng").cast("double"))
    return df.withColumns(
        {"photo_gps_lat": lat, "photo_gps_lng": lng, "gps_verified": (apart < tolerance).cast("int")}
    )


def gps_check(photos: DataFrame, r: DataFrame, loc: DataFrame, limit_m: float = 500.0) -> DataFrame:
    """The newest photo of each request against its location, with a flag for mismatches."""
    newest = latest_per_key(photos, ["request_id"], ["uploaded_at", "photo_id"])
    placed = (
        newest.join(r.select("request_id", "location_id"), "request_id")
        .join(loc.select("location_id", "latitude", "longitude"), "location_id")
        .withColumn("distance_m", F.round(haversine_m("photo_lat", "photo_lng", "latitude", "longitude"), 3))
    )
    match = F.col("distance_m") <= limit_m
    return placed.select(
        "photo_id",
        "request_id",
        "location_id",
        "distance_m",
        match.cast("int").alias("is_match"),
        F.when(~match, "gps_mismatch").alias("flag_reason"),
        F.when(~match, "high").alias("flag_severity"),
    )


def dms_to_degrees(degrees, minutes, seconds, ref):
    """Degrees, minutes and seconds to signed decimal degrees with 7 places; S and W are negative."""
    value = col(degrees).cast("double") + col(minutes) / 60.0 + col(seconds) / 3600.0
    return F.round(F.when(col(ref).isin("S", "W"), -value).otherwise(value), 7)


# Metres per degree of latitude on a sphere of radius 6371 km.
METRES_PER_DEGREE = 111_194.93


def grid_aggregate(
    points: DataFrame, cell_m: float = 100.0, bbox: tuple | None = None, as_of=None, days: int = 30, ts: str = "event_time"
) -> DataFrame:
    """Points counted per square grid cell, optionally inside (min lat, min lng, max lat, max lng)
    and only those older than `days`, whose pins the map no longer shows one by one."""
    rows = points.filter("lat IS NOT NULL AND lng IS NOT NULL")
    if bbox is not None:
        rows = rows.filter(F.col("lat").between(bbox[0], bbox[2]) & F.col("lng").between(bbox[1], bbox[3]))
    if as_of is not None:
        rows = rows.filter(F.col(ts) < as_of_ts(as_of) - F.expr(f"INTERVAL {int(days)} DAY"))
    step = cell_m / METRES_PER_DEGREE
    cells = rows.groupBy(
        F.floor(F.col("lat") / step).alias("cell_y"), F.floor(F.col("lng") / step).alias("cell_x")
    ).agg(n_rows().alias("n"))
    return cells.withColumns(
        {
            "cell_lat": F.round((F.col("cell_y") + 0.5) * step, 7),
            "cell_lng": F.round((F.col("cell_x") + 0.5) * step, 7),
        }
    )


def grid_pyramid(points: DataFrame, levels: int, cell_m: float = 100.0, bbox: tuple | None = None, as_of=None, days: int = 30) -> DataFrame:
    """The grid at every level of zoom: level 0 has cells of `cell_m`, each next one of twice the side.

    Points are read and counted once, into the finest cells; a cell's number, shifted right by the
    level, is the number of the larger cell around it, also south and west of zero.
    """
    finest = grid_aggregate(points, cell_m, bbox, as_of, days).select("cell_y", "cell_x", "n")
    every = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    up = lambda c: F.expr(f"shiftright({c}, level)").alias(c)
    cells = every.groupBy("level", up("cell_y"), up("cell_x")).agg(F.sum("n").alias("n"))
    side = F.lit(cell_m / METRES_PER_DEGREE) * F.pow(F.lit(2.0), F.col("level"))
    return cells.withColumns(
        {
            "cell_lat": F.round((F.col("cell_y") + 0.5) * side, 7),
            "cell_lng": F.round((F.col("cell_x") + 0.5) * side, 7),
        }
    )


def grid_view(pyramid: DataFrame, zoom: int, bbox: tuple, finest_zoom: int = 17) -> DataFrame:
    """Cells of a map view: the level that fits the zoom, inside (min lat, min lng, max lat, max lng).

    At `finest_zoom` and beyond level 0 is shown; each step out doubles the cells' side, up to the
    coarsest level there is.
    """
    coarsest = pyramid.agg(F.max("level")).scalar()
    level = F.least(F.lit(max(0, finest_zoom - zoom)), coarsest)
    inside = F.col("cell_lat").between(bbox[0], bbox[2]) & F.col("cell_lng").between(bbox[1], bbox[3])
    return pyramid.filter((F.col("level") == level) & inside)
