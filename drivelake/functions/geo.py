"""Geodesy, angles and uncertainty as column expressions: everything stays inside Spark's own functions.

Latitudes, longitudes and bearings are degrees; bearings run clockwise from north. Null arguments give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius and the WGS-84 ellipsoid in metres; the 68 and 95 % radii of a circular normal in sigmas.
EARTH_RADIUS = 6371008.8
WGS84_A, WGS84_E2 = 6378137.0, 6.69437999014e-3
R68_PER_SIGMA, R95_PER_SIGMA = 1.5096, 2.4477


def clamp(c: Column, low: float, high: float) -> Column:
    """A value kept between two bounds; null stays null (least and greatest would drop it)."""
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    up, across = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(clamp(a, 0.0, 1.0)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing of the great circle, in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))) + 360, F.lit(360.0))


def wrap_deg(a: Column) -> Column:
    """The same angle in (-180, 180]."""
    x = F.pmod(a, F.lit(360.0))
    return F.when(x > 180, x - 360).otherwise(x)


def destination(lat: Column, lon: Column, distance_m: Column, bearing: Column) -> tuple[Column, Column]:
    """Latitude and longitude after a distance along a bearing."""
    d, b, p = distance_m / EARTH_RADIUS, F.radians(bearing), F.radians(lat)
    end = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(end))
    return F.degrees(end), wrap_deg(lon + F.degrees(turn))


def plane_scale(lat0: Column) -> tuple[Column, Column]:
    """Metres a radian of longitude and of latitude at a place."""
    s = F.sin(F.radians(lat0))
    across = WGS84_A / F.sqrt(1 - WGS84_E2 * s * s)
    return across * F.cos(F.radians(lat0)), across * (1 - WGS84_E2) / (1 - WGS84_E2 * s * s)


def to_enu(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """East and north metres in the tangent plane at (lat0, lon0)."""
    e, n = plane_scale(lat0)
    return F.radians(wrap_deg(lon - lon0)) * e, F.radians(lat - lat0) * n


def offset_by(lat: Column, lon: Column, east_m: Column, north_m: Column) -> tuple[Column, Column]:
    """The place so many metres east and north."""
    e, n = plane_scale(lat)
    return lat + F.degrees(north_m / n), wrap_deg(lon + F.degrees(east_m / e))


def add_velocity(speed: Column, bearing: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """Speed and bearing after adding a velocity; a bearing stays where the sum is 0.5 m/s or less."""
    ve = speed * F.sin(F.radians(F.coalesce(bearing, F.lit(0.0)))) + east
    vn = speed * F.cos(F.radians(F.coalesce(bearing, F.lit(0.0)))) + north
    v = F.hypot(ve, vn)
    return v, F.when(v > 0.5, F.pmod(F.degrees(F.atan2(ve, vn)) + 360, F.lit(360.0))).otherwise(bearing)


def sigma_of_r68(r68: Column) -> Column:
    return r68 / R68_PER_SIGMA


def confidence_of_r68(r68: Column) -> Column:
    return 1 / (1 + r68 / 50)


def euler_deg(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Azimuth, roll and pitch of a device-to-world quaternion, in degrees."""
    azimuth = F.atan2(2 * (x * y - w * z), 1 - 2 * (x * x + z * z))
    pitch = F.asin(clamp(-2 * (y * z + w * x), -1.0, 1.0))
    roll = F.atan2(-2 * (x * z - w * y), 1 - 2 * (x * x + y * y))
    return F.degrees(azimuth), F.degrees(roll), F.degrees(pitch)


def gaussian(*seed: Column) -> Column:
    """A standard normal number that depends on the seed columns only, so partitioning and retries don't change it."""
    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(salt), *seed), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def tile_key(lat: Column, lon: Column) -> Column:
    """Name of the road tile of a place: 0.05 degrees of latitude by 0.08 of longitude."""
    return F.concat(F.lit("r"), F.floor(lat / 0.05).cast("string"), F.lit("_"), F.floor(lon / 0.08).cast("string"))


def obd_lines(response: Column) -> Column:
    """Lines of an adapter's answer, trimmed, without empty ones, lone prompts and search notes."""
    lines = F.transform(F.split(response, r"[\r\n]"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & (x != ">") & ~F.upper(x).startswith("SEARCHING"))


def speed_of_obd(response: Column) -> Column:
    """km/h of an answer to request 010D: the first line with 410D and two more characters decides; null without one, or if they aren't hex digits."""
    lines = F.transform(obd_lines(response), lambda x: F.upper(F.replace(x, F.lit(" "), F.lit(""))))
    line = F.get(F.filter(lines, lambda x: x.rlike("410D..")), F.lit(0))
    code = F.regexp_extract(line, "^.*?410D(..)", 1)
    return F.when(code.rlike("^[0-9A-F]{2}$"), F.conv(code, 16, 10).cast("int"))


# Small pieces of arithmetic on times, covariances, vectors and maps


def whole_div(a: Column, b: int | Column) -> Column:
    """Whole-number division that drops the rest, towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def midpoint_ns(a: Column, b: Column) -> Column:
    return whole_div(a + b, 2)


def ceil_to(t: Column, period: int) -> Column:
    """The first multiple of a period that isn't before t, also for times before zero."""
    up = t + (period - 1)
    return up - F.pmod(up, F.lit(period))


def quantize_kmh(speed_mps: Column) -> Column:
    """A speed as an instrument with whole km/h shows it; halves go up."""
    return F.floor(speed_mps * 3.6 + 0.5) / F.lit(3.6)


def cov_sigma(ee: Column, nn: Column) -> Column:
    """Mean standard deviation of an axis; times R68_PER_SIGMA or R95_PER_SIGMA it is a radius."""
    return F.sqrt(clamp((ee + nn) / 2, 0.0, float("inf")))


def nis(e: Column, n: Column, ee: Column, en: Column, nn: Column) -> Column:
    """Squared length of an innovation in units of its covariance; null where that isn't positive definite."""
    det = ee * nn - en * en
    return F.when(det > 0, (nn * e * e - 2 * en * e * n + ee * n * n) / det)


def max_eigenvalue(ee: Column, en: Column, nn: Column) -> Column:
    half = (ee - nn) / 2
    return (ee + nn) / 2 + F.sqrt(half * half + en * en)


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow; minus infinity adds nothing."""
    low = F.lit(float("-inf"))
    m = F.greatest(a, b)
    return F.when(a == low, b).when(b == low, a).otherwise(m + F.log(F.exp(a - m) + F.exp(b - m)))


def up_of_quaternion(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The world's up in the device's frame."""
    return 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: tuple) -> Column:
    return F.sqrt(dot(a, a))


def perpendicular(a: tuple, unit: tuple) -> tuple[Column, Column, Column]:
    """What is left of a vector without its part along a unit vector."""
    along = dot(a, unit)
    return a[0] - along * unit[0], a[1] - along * unit[1], a[2] - along * unit[2]


def on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """Where a point meets a segment: the share of the way from a to b (0 to 1), the distance, and the signed distance from its line (right positive; 0 without length)."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, clamp(((px - ax) * dx + (py - ay) * dy) / square, 0.0, 1.0)).otherwise(0.0)
    x, y = ax + t * dx, ay + t * dy
    side = F.when(square > 0, (dy * (px - x) - dx * (py - y)) / F.sqrt(square)).otherwise(0.0)
    return t, F.hypot(px - x, py - y), side


#: Lane width in metres, lanes of road classes that don't tell them.
LANE_M = 3.5
CLASS_LANES = {4: ("motorway", "trunk", "primary"), 2: ("secondary", "tertiary", "unclassified", "residential", "road")}


def half_width_m(lanes: Column, road_class: Column) -> Column:
    """Half of a carriageway: its lanes, or those usual for its class."""
    usual = F.lit(1)
    for n, classes in CLASS_LANES.items():
        usual = F.when(road_class.isin(*classes), n).otherwise(usual)
    return F.when(lanes > 0, lanes).otherwise(usual) * LANE_M / 2


def nice_scale_m(metres_per_px: Column, max_px: Column) -> Column:
    """The longest of 1, 2 or 5 times a power of ten metres that fits."""
    limit = metres_per_px * max_px
    ten = F.pow(F.lit(10.0), F.floor(F.log10(limit)))
    return F.when(5 * ten <= limit, 5 * ten).when(2 * ten <= limit, 2 * ten).otherwise(ten)


def map_xy(lat0: Column, lon0: Column, metres_per_px: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Pixels right and down of the map's middle."""
    e, n = to_enu(lat0, lon0, lat, lon)
    return e / metres_per_px, -n / metres_per_px


TILE_LAT, TILE_LON = 0.05, 0.08
#: Road classes for cars.
ROAD_CLASSES = (
    "living_street", "motorway", "motorway_link", "primary", "primary_link", "residential", "road", "secondary", "secondary_link", "service", "tertiary", "tertiary_link", "trunk", "trunk_link", "unclassified",
)


def overpass_query(south: Column, west: Column, north: Column, east: Column, timeout_s: int = 90) -> Column:
    """The request for the roads of a box and their nodes."""
    head = f'[out:json][timeout:{timeout_s}];way["highway"~"^({"|".join(ROAD_CLASSES)})$"]('
    return F.concat(F.lit(head), F.concat_ws(",", *(c.cast("string") for c in (south, west, north, east))), F.lit(");out body;>;out skel qt;"))
