"""Deterministic synthetic inputs as closed-form expressions over a range: routes, phone sessions, recording pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("straight", "constant_turn", "varying_speed")


def _noise(seq: Column, salt: int, sigma: float) -> Column:
    """Zero-mean noise of a standard deviation from a hash of the row, the same on every run and partitioning."""
    if not sigma:
        return F.lit(0.0)
    u = lambda s: (F.pmod(F.xxhash64(seq, F.lit(salt), F.lit(s)), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    return F.lit(sigma) * F.sqrt(F.lit(-2.0) * F.ln(u(0))) * F.cos(F.lit(2 * math.pi) * u(1))


def synth_route(spark: SparkSession, kind: str = "varying_speed", duration_s: float = 120.0, dt: float = 0.1, speed: float = 16.7, turn_deg_s: float = 3.0, accel_noise: float = 0.0, gyro_noise: float = 0.0, accel_bias: float = 0.0, route_id: int = 0) -> DataFrame:
    """seq, t, speed, psi, gyro_yaw, ax, ay of a drive; positions follow by win_euler_dr's running sums."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    t = F.col("seq") * F.lit(dt)
    rate = 0.0 if kind == "straight" else math.radians(turn_deg_s)
    wave = 2 * math.pi * t / 20
    v = F.lit(speed) + (5 * F.sin(wave) if kind == "varying_speed" else F.lit(0.0))
    a = F.lit(5 * 2 * math.pi / 20) * F.cos(wave) if kind == "varying_speed" else F.lit(0.0)
    base = spark.range(int(round(duration_s / dt)) + 1).select(F.col("id").alias("seq"))
    return base.select(
        F.lit(route_id).alias("route_id"),
        "seq",
        t.alias("t"),
        v.alias("speed"),
        (F.lit(rate) * t).alias("psi"),
        (F.lit(rate) + _noise(F.col("seq"), 1, gyro_noise)).alias("gyro_yaw"),
        (a + F.lit(accel_bias) + _noise(F.col("seq"), 2, accel_noise)).alias("ax"),
        (v * F.lit(rate) + _noise(F.col("seq"), 3, accel_noise)).alias("ay"),
    )


def synth_phone(spark: SparkSession, duration_s: float = 180.0, rate_hz: float = 100.0, parked_s: float = 8.0, stop: tuple[float, float] = (95.0, 115.0), jitter_s: float = 0.0015, gnss_sigma: float = 0.0, mount: tuple[float, float, float] = (0.1, -0.2, 0.4)) -> tuple[DataFrame, DataFrame]:
    """IMU rows (t, ax, ay, az, gx, gy, gz) with a tilted mount and ragged but monotone clock, and GNSS rows at 1 Hz."""
    nominal = F.col("id") / F.lit(rate_hz)
    moving = lambda t: F.least(F.greatest((t - parked_s) / 10, F.lit(0.0)), F.lit(1.0)) * (F.lit(1.0) - ((t >= stop[0]) & (t < stop[1])).cast("double"))
    speed = lambda t: F.lit(12.0) * moving(t)
    raw = spark.range(int(duration_s * rate_hz)).withColumn("raw", nominal + _noise(F.col("id"), 5, jitter_s))
    imu = raw.withColumn("t", F.greatest(F.max("raw").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    roll, pitch, yaw = mount
    cr, sr, cp, sp, cy, sy = math.cos(roll), math.sin(roll), math.cos(pitch), math.sin(pitch), math.cos(yaw), math.sin(yaw)
    m = [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]
    fwd = (speed(F.col("t") + 0.05) - speed(F.col("t") - 0.05)) / 0.1
    turn = F.when(speed(F.col("t")) > 0, F.lit(0.05) * F.sin(F.col("t") / 9)).otherwise(F.lit(0.0))
    lateral = speed(F.col("t")) * turn
    body = lambda x, y, z, j: F.lit(m[0][j]) * x + F.lit(m[1][j]) * y + F.lit(m[2][j]) * z
    imu = imu.select("t", *(body(fwd, lateral, F.lit(9.80665), j).alias(n) for j, n in enumerate(("ax", "ay", "az"))), *(body(F.lit(0.0), F.lit(0.0), turn, j).alias(n) for j, n in enumerate(("gx", "gy", "gz"))))
    at = F.col("id").cast("double")
    gnss = spark.range(int(duration_s)).select(at.alias("t"), (F.lit(52.4) + at * 1e-5 + _noise(F.col("id"), 8, gnss_sigma / 111_000)).alias("lat"), (F.lit(-1.5) + at * 1e-5).alias("lon"), speed(at).alias("speed"), F.lit(45.0).alias("bearing"), F.lit(3.0).alias("accuracy"), F.lit(False).alias("withheld"))
    return imu, gnss


def synth_pair(spark: SparkSession, sessions: int = 11, rate_hz: int = 10, seconds: int = 30) -> tuple[DataFrame, DataFrame]:
    """Vehicle (V) and phone (S) recordings of the same drives; the phone's clock counts milliseconds."""
    rows = spark.range(sessions * seconds * rate_hz).select((F.col("id") % sessions).alias("session"), F.expr(f"id div {sessions}").alias("seq"))
    t = F.col("seq") / F.lit(float(rate_hz))
    v = rows.select(F.format_string("Syn%02d", "session").alias("session_id"), "seq", t.alias("time_s"), (F.lit(30.0) + F.sin(t / 3) * 10).alias("velocity_kmh"), (F.lit(52.4) + t * 1e-5).alias("lat"), (F.lit(-1.5) + t * 1e-5).alias("lon"), (F.sin(t) * 5).alias("yaw_rate_dps"))
    s = rows.select(F.format_string("Syn%02d", "session").alias("session_id"), "seq", (t * 1000).alias("time_ms"), (F.lit(9.80665 * math.sin(math.radians(2.0)))).alias("gravity_x"), F.lit(0.0).alias("gravity_y"), F.lit(9.80665 * math.cos(math.radians(2.0))).alias("gravity_z"), (F.sin(t) * math.radians(5)).alias("gyro_yaw"))
    return v, s
