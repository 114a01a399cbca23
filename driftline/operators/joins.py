"""Joins by time, interval and place, as compositions of equi-joins, unions and windows.

None of them compares all pairs: as-of and interpolating joins are one sort of the union by session; interval and radius
joins and lag searches go over buckets, so that every row meets only what is near it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scalar import project_clamped


def _tagged(left: DataFrame, right: DataFrame, by: list[str], t: str, cols: list[str], right_first: bool) -> DataFrame:
    """Union of both sides: left rows keep a struct of all their columns, right rows their time and columns."""
    lefts = left.select(*by, F.col(t).alias("__t"), F.lit(1 if right_first else 0).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast("double").alias("__rt"), *(F.lit(None).cast(right.schema[c].dataType).alias(f"__r_{c}") for c in cols))
    rights = right.select(*by, F.col(t).alias("__t"), F.lit(0 if right_first else 1).alias("__side"), F.lit(None).cast(lefts.schema["__left"].dataType).alias("__left"), F.col(t).cast("double").alias("__rt"), *(F.col(c).alias(f"__r_{c}") for c in cols))
    return lefts.unionByName(rights)


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], t: str, cols: list[str], prefix: str = "r_") -> DataFrame:
    """Every left row with the columns of the last right row at or before its time; nulls where there is none."""
    u = _tagged(left, right, by, t, cols, right_first=True)
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__rt").isNotNull(), F.struct("__rt", *(f"__r_{c}" for c in cols))), ignorenulls=True).over(w)
    got = u.withColumn("__m", last).where("__left IS NOT NULL")
    return got.select("__left.*", F.col("__m.__rt").alias(f"{prefix}{t}"), *(F.col(f"__m.__r_{c}").alias(f"{prefix}{c}") for c in cols))


def interpolate(left: DataFrame, right: DataFrame, by: list[str], t: str, cols: list[str], prefix: str = "r_") -> DataFrame:
    """Right's columns at left's times, linear between neighbours and held beyond the ends; nulls without right rows."""
    u = _tagged(left, right, by, t, cols, right_first=True)
    point = F.when(F.col("__rt").isNotNull(), F.struct("__rt", *(f"__r_{c}" for c in cols)))
    w = Window.partitionBy(*by).orderBy("__t", "__side")
    got = u.withColumn("__a", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    got = got.where("__left IS NOT NULL")
    ta, tb = F.col("__a.__rt"), F.col("__b.__rt")
    frac = (F.col("__t") - ta) / F.nullif(tb - ta, F.lit(0.0))

    def at(c: str) -> Column:
        a, b = F.col(f"__a.__r_{c}"), F.col(f"__b.__r_{c}")
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + (b - a) * F.coalesce(frac, F.lit(0.0)))

    return got.select("__left.*", *(at(c).alias(f"{prefix}{c}") for c in cols))


def search_sorted(left: DataFrame, right: DataFrame, by: list[str], t: str, side: str = "left", out: str = "index") -> DataFrame:
    """How many right times lie before each left time (side left), or at or before it (right): the insertion index."""
    right_first = side == "right"
    u = _tagged(left, right, by, t, [], right_first)
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("__n", F.count("__rt").over(w)).where("__left IS NOT NULL").select("__left.*", F.col("__n").alias(out))


def latest_values(df: DataFrame, by: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Each row with the most recent non-null value of each column."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def overlap_grid(a: DataFrame, b: DataFrame, by: list[str], t: str, rate: float) -> DataFrame:
    """Grid points of the time that both sides cover: [max of starts, min of ends); none if they don't overlap."""
    span = lambda df, p: df.groupBy(*by).agg(F.min(t).alias(f"{p}0"), F.max(t).alias(f"{p}1"))
    s = span(a, "a").join(span(b, "b"), by).select(*by, F.greatest("a0", "b0").alias("lo"), F.least("a1", "b1").alias("hi"))
    n = F.ceil((F.col("hi") - F.col("lo")) * rate).cast("long")
    return s.where("hi > lo").select(*by, "lo", F.explode(F.sequence(F.lit(0), n - 1)).alias("tick")).select(*by, F.col("tick").cast("long").alias("tick"), (F.col("lo") + F.col("tick") / rate).alias(t))


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], t: str, start: str, end: str, bucket: float) -> DataFrame:
    """Points with every span [start, end) that holds them: spans go to the buckets they touch, then an equi-join."""
    p = points.withColumn("__b", F.floor(F.col(t) / bucket))
    s = spans.where(F.col(end) > F.col(start)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return p.join(s, [*by, "__b"]).where((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))).drop("__b")


def radius_join(points: DataFrame, segments: DataFrame, radius: float, cell: float = 50.0, n: str = "n", e: str = "e") -> DataFrame:
    """Points with all segments (seg_id, p1n, p1e, p2n, p2e) nearer than `radius`: adds seg_id, frac, fn, fe, dist.

    A segment goes to every grid cell that its bounding box, widened by the radius, covers, so long segments can't be
    missed; a point looks only into its own cell. Both sides are dealt by cell.
    """
    c = lambda x: F.floor(x / cell)
    span = lambda a, b: F.sequence(c(F.least(a, b) - radius), c(F.greatest(a, b) + radius))
    s = segments.select("seg_id", "p1n", "p1e", "p2n", "p2e").withColumn("__cn", F.explode(span(F.col("p1n"), F.col("p2n")))).withColumn("__ce", F.explode(span(F.col("p1e"), F.col("p2e"))))
    p = points.withColumn("__cn", c(F.col(n))).withColumn("__ce", c(F.col(e)))
    t, fn, fe, dist = project_clamped(F.col(n), F.col(e), F.col("p1n"), F.col("p1e"), F.col("p2n"), F.col("p2e"))
    j = p.join(s, ["__cn", "__ce"]).withColumns({"frac": t, "fn": fn, "fe": fe, "dist": dist})
    return j.where(F.col("dist") < radius).drop("__cn", "__ce", "p1n", "p1e", "p2n", "p2e")


def nearest(matched: DataFrame, keys: list[str], dist: str = "dist", tie: str = "seg_id", places: int = 9) -> DataFrame:
    """One row for each key: the nearest candidate, the smallest id among equals."""
    w = Window.partitionBy(*keys).orderBy(F.round(dist, places), tie)
    return matched.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def nearest_beyond(points: DataFrame, segments: DataFrame, radius: float, keys: list[str], n: str = "n", e: str = "e") -> DataFrame:
    """The nearest segment, however far, of points that have none nearer than `radius`: columns as of radius_join.

    First within eight radii, then within a radius beyond any distance; points without finite coordinates have none.
    """
    real = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < 1e9)  # noqa: E731  NaN is above all numbers
    out, left = radius_join(points, segments, radius).where("false"), points.where(real(n) & real(e))
    left = left.join(radius_join(left, segments, radius).select(*keys).distinct(), keys, "left_anti")
    if segments.isEmpty():
        return out
    most = lambda df, *c: df.agg(F.max(F.greatest(*(F.abs(x) for x in c), F.lit(0.0)))).first()[0] or 0.0
    beyond = 3 * (most(left, n, e) + most(segments, "p1n", "p1e", "p2n", "p2e")) + 1  # more than any distance
    for reach in (8 * radius, beyond):
        found = nearest(radius_join(left, segments, reach, cell=max(50.0, reach)), keys)
        out = out.unionByName(found)
        left = left.join(found.select(*keys), keys, "left_anti")
    return out


#: Up to so many lags are summed one by one; beyond it by fast Fourier transforms.
FEW_LAGS = 64


def _lag_sums(x: np.ndarray, y: np.ndarray, max_lag: int) -> np.ndarray:
    """(6, 2 * max_lag + 1): for each lag the pairs, sum x, sum y, sum x^2, sum y^2, sum x * y.

    x and y are (3, ticks) arrays of count, sum and sum of squares of the samples at each tick; y begins max_lag ticks
    before x and ends as many after, so that y's tick of a lag l is x's less l.
    """
    n = x.shape[1]
    pairs = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
    if 2 * max_lag + 1 <= FEW_LAGS:
        return np.array([[x[i] @ y[j, max_lag - lag : max_lag - lag + n] for lag in range(-max_lag, max_lag + 1)] for i, j in pairs])
    size = 1 << (n + 2 * max_lag).bit_length()
    fx, fy = np.conj(np.fft.rfft(x, size)), np.fft.rfft(y, size)
    out = np.stack([np.fft.irfft(fx[i] * fy[j], size)[2 * max_lag :: -1] for i, j in pairs])
    out[0] = np.round(out[0])
    return out


def lag_table(a: DataFrame, b: DataFrame, by: list[str], tick: str, x: str, y: str, max_lag: int, min_overlap: int = 3, zero: bool = False) -> DataFrame:
    """by, lag, r, n: correlation of a's x at tick i with b's y at tick i - lag, for every lag up to `max_lag`.

    Ticks are dealt into blocks at least four times as wide as the lags reach; a row of a goes to its block and a row of b
    to the one or two blocks that can meet it, so no row is copied once for each lag, and a long session is many tasks.
    A block's sums for all lags add up to the session's. Lag 0 is left out unless asked for.
    """
    width = max(4 * max_lag, 1024)
    block = lambda c: F.floor(c / width).cast("long")
    left = a.where(F.col(x).isNotNull()).select(*by, F.col(tick).cast("long").alias("__i"), F.col(x).cast("double").alias("__x")).withColumn("__b", block(F.col("__i")))
    reach = F.array_distinct(F.array(block(F.col("__i") - max_lag), block(F.col("__i") + max_lag)))
    right = b.where(F.col(y).isNotNull()).select(*by, F.col(tick).cast("long").alias("__i"), F.col(y).cast("double").alias("__x")).withColumn("__b", F.explode(reach))
    schema = ", ".join([*(f"`{c}` {a.schema[c].dataType.simpleString()}" for c in by), "lag int, __n double, __sx double, __sy double, __sxx double, __syy double, __sxy double"])

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame(columns=[*by, "lag", "__n", "__sx", "__sy", "__sxx", "__syy", "__sxy"])
        start = int(p["__b"].iloc[0]) * width

        def laid(d: pd.DataFrame, origin: int, n: int) -> np.ndarray:
            at, v = d["__i"].to_numpy() - origin, d["__x"].to_numpy()
            inside = (at >= 0) & (at < n)
            return np.stack([np.bincount(at[inside], weights=w, minlength=n) for w in (np.ones(int(inside.sum())), v[inside], v[inside] ** 2)])

        sums = _lag_sums(laid(p, start, width), laid(q, start - max_lag, width + 2 * max_lag), max_lag)
        out = pd.DataFrame({"lag": np.arange(-max_lag, max_lag + 1, dtype=np.int32), **dict(zip(["__n", "__sx", "__sy", "__sxx", "__syy", "__sxy"], sums, strict=True))})
        for c in reversed(by):
            out.insert(0, c, p[c].iloc[0])
        return out[out["__n"] > 0]

    parts = left.groupBy(*by, "__b").cogroup(right.groupBy(*by, "__b")).applyInPandas(run, schema)
    g = parts.groupBy(*by, "lag").agg(*(F.sum(f"__{c}").alias(f"__{c}") for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    n, sx, sy = F.col("__n"), F.col("__sx"), F.col("__sy")
    spread = (n * F.col("__sxx") - sx * sx) * (n * F.col("__syy") - sy * sy)
    g = g.select(*by, "lag", F.when(spread > 0, (n * F.col("__sxy") - sx * sy) / F.sqrt(spread)).alias("r"), n.cast("long").alias("n"), F.col("__sxy").alias("dot"))
    return g.where((F.col("n") >= min_overlap) & (F.lit(zero) | (F.col("lag") != 0)))


def best_lag(lags: DataFrame, by: list[str], score: Column, places: int = 9) -> DataFrame:
    """The lag of the highest score, the smallest among equals."""
    return lags.groupBy(*by).agg(F.max_by(F.struct("lag", "r", "n"), F.struct(F.round(score, places), -F.col("lag"))).alias("b")).select(*by, "b.*")
