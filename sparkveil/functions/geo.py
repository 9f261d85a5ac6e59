"""Geo arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean Earth radius, WGS84 semi-major axis and flattening, unit factors.
EARTH_M = 6_371_008.8
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
FEET_M, KNOT_MS, FPM_MS, NM_M, MILE_M = 0.3048, 0.514444, 0.00508, 1852.0, 1609.344


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.sin((c - a) / 2) ** 2 + F.cos(a) * F.cos(c) * F.sin((d - b) / 2) ** 2
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_M)


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to 360."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(d - b) * F.cos(c)
    x = F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lat, lon, bearing, metres) -> tuple[Column, Column]:
    """(latitude, longitude) after a distance along a bearing; longitude within -180 to 180."""
    a, b, t = F.radians(_c(lat)), F.radians(_c(lon)), F.radians(_c(bearing))
    d = _c(metres) / EARTH_M
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    on = b + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.degrees(to), F.pmod(F.degrees(on) + 540, F.lit(360.0)) - 180


def ecef(lat, lon, alt) -> tuple[Column, Column, Column]:
    """Geodetic coordinates on WGS84 as earth-centred ones."""
    a, b, h = F.radians(_c(lat)), F.radians(_c(lon)), F.coalesce(_c(alt), F.lit(0.0))
    e2 = WGS84_F * (2 - WGS84_F)
    n = F.lit(WGS84_A) / F.sqrt(1 - e2 * F.sin(a) ** 2)
    return (n + h) * F.cos(a) * F.cos(b), (n + h) * F.cos(a) * F.sin(b), (n * (1 - e2) + h) * F.sin(a)


def tile(lat, lon, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile (x, y) of a position."""
    n = 1 << zoom
    held = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), _c(lat))))
    x = F.floor((_c(lon) + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(held) + 1 / F.cos(held)) / F.lit(3.141592653589793)) / 2 * n)
    hold = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int")
    return hold(x), hold(y)


def in_box(lat, lon, south: float, west: float, north: float, east: float) -> Column:
    """Whether a position is in a box; west > east means a box across the antimeridian."""
    across = (_c(lon) >= west) | (_c(lon) <= east) if west > east else _c(lon).between(west, east)
    return _c(lat).between(south, north) & across


def kinematics(fixes: DataFrame) -> DataFrame:
    """Distance, bearing and implied speed between consecutive fixes of a track, by time."""
    before = {c: F.expr(f"lag({c}) over (partition by id order by t, seq)") for c in ("lat", "lon", "t")}
    rows = fixes.select("id", "seq", "t", "lat", "lon", *[v.alias(f"last_{k}") for k, v in before.items()]).where("last_t is not null")
    d = haversine_m("last_lat", "last_lon", "lat", "lon")
    return rows.select(
        "id", "seq", "t", d.alias("metres"), bearing_deg("last_lat", "last_lon", "lat", "lon").alias("bearing"),
        F.when(F.col("t") > F.col("last_t"), d / (F.col("t") - F.col("last_t"))).alias("speed_ms"),
    )


def sidereal(seconds) -> Column:
    """Greenwich mean sidereal time (IAU 1982) in radians, at Unix seconds of universal time."""
    t = (_c(seconds) / 86_400 + 2_440_587.5 - 2_451_545.0) / 36_525.0
    turned = 67_310.54841 + (876_600.0 * 3_600 + 8_640_184.812866) * t + 0.093104 * t * t - 6.2e-6 * t * t * t
    return F.radians(F.pmod(turned, F.lit(86_400.0)) / 240.0)


def earth_fixed(x, y, z, seconds) -> tuple[Column, Column, Column]:
    """Earth-fixed metres of a place given in kilometres on the equinox of its date: turned by the sidereal time."""
    angle = sidereal(seconds)
    c, s = F.cos(angle), F.sin(angle)
    return (_c(x) * c + _c(y) * s) * 1000, (_c(y) * c - _c(x) * s) * 1000, _c(z) * 1000


#: Units along a tile's side, and units beyond its edge that a tile still shows.
EXTENT, BUFFER = 4096, 64


def on_tiles(points: DataFrame, zoom: int, extent: int = EXTENT, buffer: int = BUFFER) -> DataFrame:
    """``points`` (lat, lon, ...) with tile_x, tile_y and the place within (px, py), once for each tile that shows them.

    A point within ``buffer`` units of an edge is shown by the tiles on both sides; its place there is below 0 or beyond
    ``extent``. Points without a place, and those beyond the latitudes of the map, are on no tile.
    """
    n = 1 << zoom
    a = F.radians("lat")
    x = (F.col("lon") + 180) / 360 * (n * extent)
    y = (1 - F.log(F.tan(a) + 1 / F.cos(a)) / F.lit(3.141592653589793)) / 2 * (n * extent)
    placed = points.where("lat between -85.05112878 and 85.05112878 and lon between -180 and 180").withColumn("_w", F.struct(x.alias("x"), y.alias("y")))

    def tiles(v: str) -> Column:
        first, last = (F.floor((F.col(v) + d) / extent).cast("int") for d in (-buffer, buffer))
        return F.sequence(F.greatest(first, F.lit(0)), F.greatest(F.least(last, F.lit(n - 1)), F.greatest(first, F.lit(0))))

    shown = placed.withColumn("tile_x", F.explode(tiles("_w.x"))).withColumn("tile_y", F.explode(tiles("_w.y")))
    inside = lambda v, t: F.floor(F.col(f"_w.{v}") - F.col(t) * extent + 0.5).cast("int")
    return shown.where(f"tile_x < {n} and tile_y < {n}").select(*points.columns, "tile_x", "tile_y", inside("x", "tile_x").alias("px"), inside("y", "tile_y").alias("py"))
