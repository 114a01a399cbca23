"""Road geometry: segments, polylines, arc length, matching by turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalar import project_clamped
from driftline.operators.ordered import gradient, over, running, unwrap


def segments(vertices: DataFrame, by: list[str], order: str, least: float = 0.1) -> DataFrame:
    """Consecutive vertices of each road (`by` names it) as segments longer than `least`: seg_id, ends, length, heading."""
    if not by:
        raise ValueError("name the columns that tell roads apart: without them all vertices would be one task's")
    w = over(by, order)
    s = vertices.select(*by, F.col(order).alias("seg_id"), F.col("n").alias("p1n"), F.col("e").alias("p1e"), F.lead("n").over(w).alias("p2n"), F.lead("e").over(w).alias("p2e"))
    dn, de = F.col("p2n") - F.col("p1n"), F.col("p2e") - F.col("p1e")
    return s.withColumn("length", F.sqrt(dn * dn + de * de)).withColumn("heading", F.atan2(de, dn)).where(F.col("length") > least)


def explode_geometry(edges: DataFrame, geometry: str, keys: list[str]) -> DataFrame:
    """Edges with an array of points (struct n, e) as vertices with their place."""
    return edges.select(*keys, F.posexplode(geometry).alias("i", "p")).select(*keys, F.col("i").cast("long").alias("i"), "p.n", "p.e")


def join_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (u, v) with the coordinates of their nodes (id, n, e); edges with a missing node go."""
    a = nodes.select(F.col("id").alias("u"), F.col("n").alias("p1n"), F.col("e").alias("p1e"))
    b = nodes.select(F.col("id").alias("v"), F.col("n").alias("p2n"), F.col("e").alias("p2e"))
    return edges.join(a, "u").join(b, "v")


def with_arc_length(segs: DataFrame, by: list[str]) -> DataFrame:
    """Adds s0, the length of the polyline before each segment. A polyline fits a task."""
    return segs.withColumn("s0", F.sum("length").over(running(by, "seg_id")) - F.col("length"))


def interpolate_along(points: DataFrame, polyline: DataFrame, by: list[str], s: str, bucket: float = 25.0) -> DataFrame:
    """Points with an arc length s get n, e and heading on the polyline; s is clamped to its ends."""
    total = polyline.groupBy(*by).agg(F.max(F.col("s0") + F.col("length")).alias("__total"), F.max("s0").alias("__last"))
    p = points.join(total, by).withColumn("__s", F.greatest(F.lit(0.0), F.least(F.col("__total"), F.col(s)))).withColumn("__b", F.floor(F.least("__s", "__last") / bucket))
    q = polyline.withColumn("__b", F.explode(F.sequence(F.floor(F.col("s0") / bucket), F.floor((F.col("s0") + F.col("length")) / bucket)))).withColumn("__end", F.col("s0") + F.col("length"))
    j = p.join(q, [*by, "__b"]).where((F.col("__s") >= F.col("s0")) & ((F.col("__s") < F.col("__end")) | (F.col("s0") == F.col("__last"))))
    a = (F.col("__s") - F.col("s0")) / F.col("length")
    return j.select(*points.columns, (F.col("p1n") + a * (F.col("p2n") - F.col("p1n"))).alias("n"), (F.col("p1e") + a * (F.col("p2e") - F.col("p1e"))).alias("e"), "heading")


def project_to_s(matched: DataFrame) -> DataFrame:
    """Arc length of candidates that radius_join found, on segments with s0 and length."""
    return matched.withColumn("s", F.col("s0") + F.col("frac") * F.col("length"))


def curvature(points: DataFrame, by: list[str], order: str, step: float) -> DataFrame:
    """Unwrapped heading along the road, its turn since the start, and its gradient by arc length."""
    u = unwrap(points, "heading", by, order, "unwrapped")
    w = over(by, order)
    return u.withColumn("turn", F.col("unwrapped") - F.first("unwrapped").over(running(by, order))).withColumn("curvature", gradient(F.col("unwrapped"), w) / step)


def foot(n: str = "n", e: str = "e"):
    return project_clamped(F.col(n), F.col(e), F.col("p1n"), F.col("p1e"), F.col("p2n"), F.col("p2e"))


def match_progress(asks: DataFrame, profile: DataFrame, keys: list[str], s: str = "s_est", turn: str = "turn_seen", window: float = 20.0, bucket: float = 20.0) -> DataFrame:
    """For each ask, the arc length within `window` of the estimate whose turn is nearest to what was seen."""
    a = asks.withColumn("__b", F.explode(F.sequence(F.floor((F.col(s) - window) / bucket), F.floor((F.col(s) + window) / bucket))))
    p = profile.select(F.col("s").alias("__s"), F.col("turn").alias("__turn")).withColumn("__b", F.floor(F.col("__s") / bucket))
    j = a.join(p, "__b").where(F.abs(F.col("__s") - F.col(s)) <= window)
    d = F.round(F.abs(F.col("__turn") - F.col(turn)), 9)
    best = F.min_by(F.struct("__s", d.alias("__d")), F.struct(d, F.col("__s")))
    return j.groupBy(*keys).agg(best.alias("__m")).select(*keys, F.col("__m.__s").alias("s_match"), F.col("__m.__d").alias("turn_diff"))
