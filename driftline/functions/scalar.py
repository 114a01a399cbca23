"""Column expressions: units, angles, geodesy, kinematics, text. All stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MEAN = 6_371_000.0
EARTH_EQUATOR = 6_378_137.0
FLAT_DEGREE = 111_000.0


def lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def r6(c: Column, places: int = 6) -> Column:
    """Rounded for reports; never a negative zero."""
    return F.round(c, places) + F.lit(0.0)


# --- units ---


def kmh_to_ms(c: Column) -> Column:
    return c / F.lit(3.6)


def ms_to_s(c: Column) -> Column:
    return c / F.lit(1000.0)


def g_to_ms2(c: Column) -> Column:
    return c * F.lit(9.80665)


# --- angles ---


def wrap_deg(c: Column) -> Column:
    """Into [-180, 180) with a floored modulus."""
    return F.pmod(c + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def wrap_pi(c: Column) -> Column:
    """Into [-pi, pi) with a floored modulus."""
    return F.pmod(c + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)


def floored_mod(c: Column, m: float) -> Column:
    """c - m * floor(c / m) as SQL rounds it; pmod is exact instead, which tells apart what is half a turn but for rounding."""
    q = c / F.lit(float(m))
    # floor gives a long; beyond 2^53 every double is whole.
    return c - F.lit(float(m)) * F.when(F.abs(q) < F.lit(float(1 << 53)), F.floor(q).cast("double")).otherwise(q)


def angle_diff(a: Column, b: Column) -> Column:
    return F.abs(wrap_pi(a - b))


def bearing_to_heading(bearing_deg: Column) -> Column:
    """Compass degrees to radians from North towards East."""
    return wrap_pi(F.radians(bearing_deg))


def heading_to_bearing(psi: Column) -> Column:
    return F.pmod(F.degrees(psi), F.lit(360.0))


# --- vectors and kinematics ---


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def clip(c: Column, low: float | Column, high: float | Column) -> Column:
    return F.greatest(lit(low), F.least(lit(high), c))


def rotate(x: Column, y: Column, psi: Column) -> tuple[Column, Column]:
    """Body to world by a heading."""
    return x * F.cos(psi) - y * F.sin(psi), x * F.sin(psi) + y * F.cos(psi)


def level(x: Column, y: Column, z: Column, rows: list[list[Column]]) -> list[Column]:
    """A 3x3 rotation applied to a vector; columns of coefficients allow one mount for each session."""
    return [r[0] * x + r[1] * y + r[2] * z for r in rows]


def pitch_roll(gx: Column, gy: Column, gz: Column) -> tuple[Column, Column]:
    n = F.greatest(norm3(gx, gy, gz), F.lit(1e-8))
    return F.asin(clip(-gx / n, -1, 1)), F.asin(clip(gy / n, -1, 1))


def velocity(speed: Column, psi: Column) -> tuple[Column, Column]:
    return speed * F.cos(psi), speed * F.sin(psi)


def zscore(x: Column, mean: Column, std: Column, floor: float = 1e-6) -> Column:
    return (x - mean) / F.greatest(std, F.lit(floor))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def affine_clipped(v: Column, scale: float | Column, offset: float | Column, low: float = 0.0, high: float = 40.0) -> Column:
    return clip(lit(scale) * v + lit(offset), low, high)


def match_confidence(diff: Column, width: float = 0.15) -> Column:
    return F.exp(F.lit(-0.5) * F.pow(diff / F.lit(width), F.lit(2.0)))


def wheel_speed(left: Column, right: Column, radius: float = 0.3) -> Column:
    return (left + right) / F.lit(2.0) * F.lit(radius)


def trust_sigma(a: Column, b: Column, r_a: float = 0.5, r_b: float = 1.75, factor: float = 1.5, inflate: float = 5.0) -> Column:
    """Sigma of channel a, inflated where it disagrees with channel b; a missing b is no disagreement."""
    return F.when(F.abs(a - b) > F.lit(factor * r_b), F.lit(r_a * inflate)).otherwise(F.lit(r_a))


def reacquire_multiplier(since: Column, ramp_s: float = 2.5, start: float = 50.0) -> Column:
    """Noise multiplier `since` seconds after fixes came back; 1 once the ramp is over or without an outage."""
    frac = F.least(F.lit(1.0), since / F.lit(ramp_s))
    return F.when(since.isNull() | (frac >= 1), F.lit(1.0)).otherwise(F.lit(start) + F.lit(1.0 - start) * frac)


def process_noise(dt: Column, blackout: Column) -> list[Column]:
    """Diagonal of the process noise: position and velocity by regime, heading and the two biases."""
    pos = F.when(blackout, F.lit(0.5)).otherwise(F.lit(0.05))
    vel = F.when(blackout, F.lit(0.2)).otherwise(F.lit(0.1))
    return [pos * dt, pos * dt, vel * dt, vel * dt, F.lit(1e-3) * dt, F.lit(1e-5) * dt, F.lit(1e-6) * dt]


# --- geodesy ---


def north_east(lat: Column, lon: Column, lat0: float | Column, lon0: float | Column, earth: float = EARTH_MEAN) -> tuple[Column, Column]:
    """Local plane about an origin, equirectangular."""
    return F.radians(lat - lit(lat0)) * F.lit(earth), F.radians(lon - lit(lon0)) * F.lit(earth) * F.cos(F.radians(lit(lat0)))


def north_east_flat(lat: Column, lon: Column, lat0: float | Column, lon0: float | Column, metres: float = FLAT_DEGREE) -> tuple[Column, Column]:
    return (lat - lit(lat0)) * F.lit(metres), (lon - lit(lon0)) * F.lit(metres) * F.cos(F.radians(lit(lat0)))


def lat_lon(n: Column, e: Column, lat0: float | Column, lon0: float | Column, earth: float = EARTH_MEAN) -> tuple[Column, Column]:
    return lit(lat0) + F.degrees(n / F.lit(earth)), lit(lon0) + F.degrees(e / (F.lit(earth) * F.cos(F.radians(lit(lat0)))))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, earth: float = EARTH_MEAN) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * earth) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def project_clamped(pn: Column, pe: Column, an: Column, ae: Column, bn: Column, be: Column) -> tuple[Column, Column, Column, Column]:
    """Fraction along a segment in [0, 1], foot point and distance of a point."""
    dn, de = bn - an, be - ae
    sq = dn * dn + de * de
    t = F.when(sq > 0, clip(((pn - an) * dn + (pe - ae) * de) / F.nullif(sq, F.lit(0.0)), 0, 1)).otherwise(F.lit(0.0))
    fn, fe = an + t * dn, ae + t * de
    return t, fn, fe, F.sqrt((pn - fn) * (pn - fn) + (pe - fe) * (pe - fe))


# --- text, JSON, maps ---


def norm_header(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def session_of_file(c: Column) -> Column:
    """Session id of V-<id>.csv or S-<id>.csv, in any case; empty otherwise."""
    return F.regexp_extract(c, r"(?i)^[VS]-(.+)\.csv$", 1)


def sorted_pairs(m: Column) -> Column:
    """k=v of a map, sorted by key, comma-joined."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def json_number(c: Column, key: str) -> Column:
    """A finite number by key; null if absent or not one."""
    v = F.get_json_object(c, f"$.{key}").try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)


def map_get(m: Column, key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def now_utc() -> Column:
    """The time of the query as ISO text in UTC, to the second."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
