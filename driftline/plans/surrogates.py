"""The tables of a folder as the inputs that operators expect, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sig(spark: SparkSession, d: str) -> DataFrame:
    """events as signal samples: session_id, t (seconds), event_id (breaks ties), v, k, event_type."""
    e = table(spark, d, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select("event_id", F.col("user_id").alias("session_id"), t.alias("t"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")


def geo(spark: SparkSession, d: str) -> DataFrame:
    return sig(spark, d).withColumns({"lat": F.lit(52.4) + (F.col("k") % 100) * F.lit(1e-4), "lon": F.lit(-1.5) + (F.col("event_id") % 97) * F.lit(1e-4)})


def clock(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.expr("event_id div 2500").alias("session_id"), F.col("event_id").alias("seq"), ((F.col("event_id") % 1000) * 100).cast("double").alias("raw_ms"))


def pair(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_returnflag").alias("grp"), "l_quantity", (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("yhat"), "l_extendedprice", "l_orderkey")


def road(spark: SparkSession, d: str = "") -> DataFrame:
    """Vertices of a winding road: i, n, e."""
    i = F.col("id")
    return spark.range(200).select(i.alias("i"), (i * 10 + F.sin(i / 7) * 5).alias("n"), (F.cos(i / 11) * 8).alias("e"))


def sess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.format_string("S%06d", "c_custkey").alias("session_id"), F.col("c_mktsegment").alias("driver"), "c_custkey", "c_acctbal")


def route(spark: SparkSession, d: str) -> DataFrame:
    """Drives of 2000 events each, at 10 Hz: sinusoidal speed on a constant turn, sensor noise from the events' values."""
    t, v = F.col("seq") * F.lit(0.1), F.col("v")
    wave, rate = 2 * F.pi() * t / 20, F.radians(F.lit(3.0))
    speed = F.lit(16.7) + 5 * F.sin(wave)
    x = sig(spark, d).select(F.expr("event_id div 2000").alias("route_id"), (F.col("event_id") % 2000).alias("seq"), "v", "k")
    return x.select("route_id", "seq", t.alias("t"), speed.alias("speed"), (rate * t).alias("psi"), (rate + (F.col("k") - 50) * F.lit(1e-5)).alias("gyro_yaw"), (F.lit(5.0) * 2 * F.pi() / 20 * F.cos(wave) + (v - 50) * F.lit(1e-4)).alias("ax"), (speed * rate).alias("ay"))


SQL = {
    "sig": "SELECT event_id, user_id AS session_id, epoch_us(ts) / 1e6 AS t, value AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events",
    "geo": "SELECT *, 52.4 + (k % 100) * 1e-4::DOUBLE AS lat, -1.5 + (event_id % 97) * 1e-4::DOUBLE AS lon FROM sig",
    "clock": "SELECT event_id // 2500 AS session_id, event_id AS seq, CAST((event_id % 1000) * 100 AS DOUBLE) AS raw_ms FROM events",
    "pair": "SELECT l_returnflag AS grp, l_quantity, l_discount * 100 AS y, l_tax * 100 AS yhat, l_extendedprice, l_orderkey FROM lineitem",
    "road": "SELECT i, i * 10 + sin(i / 7.0::DOUBLE) * 5 AS n, cos(i / 11.0::DOUBLE) * 8 AS e FROM (SELECT unnest(generate_series(0, 199)) AS i)",
    "sess": "SELECT 'S' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS session_id, c_mktsegment AS driver, c_custkey, c_acctbal FROM customer",
    "route": """SELECT event_id // 2000 AS route_id, event_id % 2000 AS seq, (event_id % 2000) * 0.1::DOUBLE AS t, 16.7 + 5 * sin(2 * pi() * ((event_id % 2000) * 0.1::DOUBLE) / 20) AS speed, radians(3.0) * ((event_id % 2000) * 0.1::DOUBLE) AS psi,
 radians(3.0) + (k - 50) * 1e-5::DOUBLE AS gyro_yaw, 5 * 2 * pi() / 20 * cos(2 * pi() * ((event_id % 2000) * 0.1::DOUBLE) / 20) + (v - 50) * 1e-4::DOUBLE AS ax, (16.7 + 5 * sin(2 * pi() * ((event_id % 2000) * 0.1::DOUBLE) / 20)) * radians(3.0) AS ay FROM sig""",
    "synth": """SELECT seq, seq * 0.1::DOUBLE AS t, 16.7 + 5 * sin(2 * pi() * (seq * 0.1::DOUBLE) / 20) AS speed, radians(3.0) * (seq * 0.1::DOUBLE) AS psi, radians(3.0) AS gyro_yaw,
 5 * 2 * pi() / 20 * cos(2 * pi() * (seq * 0.1::DOUBLE) / 20) AS ax, (16.7 + 5 * sin(2 * pi() * (seq * 0.1::DOUBLE) / 20)) * radians(3.0) AS ay
 FROM (SELECT unnest(generate_series(0, 1200)) AS seq)""",
}
_NEEDS = {"geo": ["sig"], "route": ["sig"]}


def with_(*names: str) -> str:
    """WITH clause of the named inputs, to which a query adds its own."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
