"""Aggregations: all are sums that Spark pre-aggregates before the shuffle, so hot groups cost no more than others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regression_metrics(y: Column, yhat: Column) -> list[Column]:
    """n, rmse, mae, median_ae, p90, p95, max_ae, bias, err_std (population), r2 (null without variance)."""
    e = yhat - y
    a = F.abs(e)
    r2 = F.lit(1.0) - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    return [F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(a).alias("mae"), F.median(a).alias("median_ae"), F.percentile(a, 0.9).alias("p90"), F.percentile(a, 0.95).alias("p95"), F.max(a).alias("max_ae"), F.avg(e).alias("bias"), F.stddev_pop(e).alias("err_std"), r2.alias("r2")]


def buckets(x: Column, edges: list[float]) -> Column:
    """Index of the left-closed bin of x, null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((x >= edges[i]) & (x < edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def channel_stats(long: DataFrame, channel: str, value: str, floor: float = 1e-6) -> DataFrame:
    """mean and population standard deviation (at least `floor`) of each channel."""
    return long.groupBy(channel).agg(F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(floor)).alias("std"))


def affine_fit(y: Column, x: Column, low: float, high: float, recompute: bool = True) -> tuple[Column, Column]:
    """Least-squares slope of y on x within [low, high], and the intercept of the clipped or unclipped slope."""
    slope = F.coalesce(F.regr_slope(y, x), F.lit(1.0))
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), slope))
    return clipped, F.avg(y) - (clipped if recompute else slope) * F.avg(x)


def moments(x: Column, y: Column, z: Column) -> list[Column]:
    """Sums that a fit of z on x and y with an intercept needs; they merge, so partial results may come from anywhere."""
    return [F.count("*").alias("n"), *(F.sum(c).alias(n) for n, c in {"sx": x, "sy": y, "sz": z, "sxx": x * x, "syy": y * y, "sxy": x * y, "sxz": x * z, "syz": y * z}.items())]


def axis_from_moments() -> tuple[Column, Column]:
    """The unit vector (ux, uy) of the least-squares coefficients of z on x and y; null where they are collinear."""
    c = F.col
    cxx, cyy, cxy = c("sxx") - c("sx") * c("sx") / c("n"), c("syy") - c("sy") * c("sy") / c("n"), c("sxy") - c("sx") * c("sy") / c("n")
    cxz, cyz = c("sxz") - c("sx") * c("sz") / c("n"), c("syz") - c("sy") * c("sz") / c("n")
    det = F.nullif(cxx * cyy - cxy * cxy, F.lit(0.0))
    a, b = (cyy * cxz - cxy * cyz) / det, (cxx * cyz - cxy * cxz) / det
    n = F.nullif(F.sqrt(a * a + b * b), F.lit(0.0))
    return a / n, b / n


def principal_axis(x: Column, y: Column) -> Column:
    """Angle of the first principal axis of a 2x2 scatter, in (-pi/2, pi/2]."""
    return F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y)) / 2


def gravity(x: Column, y: Column, z: Column) -> list[Column]:
    """Mean acceleration, its size, and whether it can be gravity."""
    gx, gy, gz = F.avg(x), F.avg(y), F.avg(z)
    g = F.sqrt(gx * gx + gy * gy + gz * gz)
    return [gx.alias("gx"), gy.alias("gy"), gz.alias("gz"), g.alias("g"), (g >= 1.0).alias("usable")]


def heteroscedastic(e: Column, logvar: Column) -> Column:
    """Mean of exp(-logvar) * huber(e) + logvar / 2."""
    huber = F.when(F.abs(e) <= 1.0, 0.5 * e * e).otherwise(F.abs(e) - 0.5)
    return F.avg(F.exp(-logvar) * huber + logvar / 2)


def gaussian_nll(e: Column, logvar: Column) -> Column:
    return F.avg(0.5 * (logvar + e * e * F.exp(-logvar)))


def weighted_huber(e: Column, y: Column, edges: list[float], weights: list[float]) -> Column:
    """Huber loss weighted by the band of y."""
    huber = F.when(F.abs(e) <= 1.0, 0.5 * e * e).otherwise(F.abs(e) - 0.5)
    w = F.lit(weights[-1])
    for i in reversed(range(len(edges))):
        w = F.when(y < edges[i], F.lit(weights[i])).otherwise(w)
    return F.sum(w * huber) / F.sum(w)


def classification(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy, macro recall and macro F1 over the classes of the truth, from confusion counts alone."""
    cells = df.groupBy(F.col(truth).alias("y"), F.col(guess).alias("p")).agg(F.count("*").alias("n"))
    by_truth = cells.groupBy("y").agg(F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("actual"))
    by_guess = cells.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("guessed"))
    c = by_truth.join(by_guess, "y", "left").na.fill(0, ["guessed"])
    return c.agg((F.sum("tp") / F.sum("actual")).alias("accuracy"), F.avg(F.col("tp") / F.col("actual")).alias("macro_recall"), F.avg(2 * F.col("tp") / (F.col("actual") + F.col("guessed"))).alias("macro_f1"))


def drift(err: Column, order: Column, distance: Column) -> list[Column]:
    """End, largest and rms error, distance and drift in percent (null for no distance)."""
    end = F.max_by(err, order)
    return [end.alias("end_error"), F.max(err).alias("max_error"), F.sqrt(F.avg(err * err)).alias("rms_error"), F.sum(distance).alias("distance"), (end / F.nullif(F.sum(distance), F.lit(0.0)) * 100).alias("drift_pct")]


def sanity_flags(imu_n: Column, gnss_n: Column, rate: Column, gap: Column, accel: Column, mag_n: Column, withheld: Column) -> Column:
    """Names of the log-quality rules that a session breaks."""
    rules = {"few_imu": imu_n < 100, "few_gnss": gnss_n < 10, "rate": (rate < 60) | (rate > 250), "gap": gap > 0.2, "no_gravity": accel < 5, "no_mag": mag_n == 0, "no_withheld": withheld == 0}
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
