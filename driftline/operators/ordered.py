"""Operators over ordered samples of a session. All partition by session, so one shuffle serves a chain of them.

`by` names the partition columns and `order` the ordering ones; give a total order, so that ties have one result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftline.functions.scalar import floored_mod

Names = str | list[str]


def _list(x: Names) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def over(by: Names, order: Names) -> WindowSpec:
    return Window.partitionBy(*_list(by)).orderBy(*_list(order))


def running(by: Names, order: Names) -> WindowSpec:
    return over(by, order).rowsBetween(Window.unboundedPreceding, 0)


def diff(x: Column, w: WindowSpec, first: float | None = None) -> Column:
    """x minus the sample before; the first row is null or `first`."""
    d = x - F.lag(x).over(w)
    return d if first is None else F.coalesce(d, F.lit(first))


def gradient(x: Column, w: WindowSpec) -> Column:
    """Central differences inside, one-sided at both ends."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)


def gradient_over(x: Column, t: Column, w: WindowSpec) -> Column:
    """The derivative by a clock with uneven steps; inner points weigh both sides by the other side's step."""
    x0, x1, t0, t1 = F.lag(x).over(w), F.lead(x).over(w), F.lag(t).over(w), F.lead(t).over(w)
    h0, h1 = t - t0, t1 - t
    inner = (h0 * h0 * x1 + (h1 * h1 - h0 * h0) * x - h1 * h1 * x0) / F.nullif(h0 * h1 * (h0 + h1), F.lit(0.0))
    return F.when(x0.isNull(), (x1 - x) / F.nullif(h1, F.lit(0.0))).when(x1.isNull(), (x - x0) / F.nullif(h0, F.lit(0.0))).otherwise(inner)


def unwrap(df: DataFrame, col: str, by: Names, order: Names, out: str = "unwrapped") -> DataFrame:
    """Angles without jumps: the first one plus the running sum of wrapped differences.

    Differences of half a turn are near either end of [-pi, pi), so the modulus rounds as a floor in SQL does.
    """
    w = over(by, order)
    step = F.coalesce(floored_mod(diff(F.col(col), w) + F.lit(math.pi), 2 * math.pi) - F.lit(math.pi), F.lit(0.0))
    return df.withColumn("__step", step).withColumn(out, F.first(col).over(running(by, order)) + F.sum("__step").over(running(by, order))).drop("__step")


def stationary(x: Column, by: Names, order: Names, size: int = 10, limit: float = 0.015) -> tuple[Column, Column]:
    """Centred sample variance over `size` rows (size // 2 before, the rest from the row on) and whether it is low.

    Sessions shorter than the window are never stationary.
    """
    var = F.coalesce(F.var_samp(x).over(over(by, order).rowsBetween(-(size // 2), size - size // 2 - 1)), F.lit(0.0))
    return var, (var < limit) & (F.count(F.lit(1)).over(Window.partitionBy(*_list(by))) >= size)


def var_pop_in_order(x: Column, w: WindowSpec) -> Column:
    """Population variance over a short frame by Welford's updates, rounded as DuckDB's var_pop; null values don't count.

    Spark's own rounds otherwise, which tells where a variance equals a limit.
    """
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(s: Column, v: Column) -> Column:
        n, d = s["n"] + 1, v - s["mean"]
        mean = s["mean"] + d / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (v - mean) * d).alias("m2"))

    return F.aggregate(F.collect_list(x.cast("double")).over(w), zero, add, lambda s: s["m2"] / F.nullif(s["n"], F.lit(0.0)))


def zupt(accel: Column, gyro: Column, by: Names, order: Names, n: int = 20, accel_var: float = 0.02, gyro_var: float = 1e-3, gyro_mean: float = 0.05) -> Column:
    """Zero-velocity flag: low population variances and a low mean turn rate over the last n rows; false until n."""
    w = over(by, order).rowsBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(w) == n
    return full & (var_pop_in_order(accel, w) < accel_var) & (var_pop_in_order(gyro, w) < gyro_var) & (F.abs(F.avg(gyro).over(w)) < gyro_mean)


def trailing_mean(x: Column, by: Names, order: Names, n: int) -> Column:
    return F.avg(x).over(over(by, order).rowsBetween(-(n - 1), 0))


def centred_mean(x: Column, by: Names, order: Names, n: int) -> Column:
    return F.avg(x).over(over(by, order).rowsBetween(-(n // 2), n - n // 2 - 1))


def clock_repair(df: DataFrame, raw: str, by: Names, order: Names, nominal: float = 100.0, reset: float = -50_000.0, gap: float = 5_000.0, out: str = "t") -> DataFrame:
    """A monotone clock from one with resets: a backward step counts as one nominal step, gaps stay.

    Adds kind: first, reset (a step of `reset` or below), back (zero or slightly back), gap (above `gap`) or step.
    """
    w = over(by, order)
    d = diff(F.col(raw), w)
    kind = F.when(d.isNull(), "first").when(d <= reset, "reset").when(d <= 0, "back").when(d > gap, "gap").otherwise("step")
    step = F.when(d.isNull(), F.lit(0.0)).when(d <= 0, F.lit(nominal)).otherwise(d)
    return df.withColumn("kind", kind).withColumn("__step", step).withColumn(out, F.sum("__step").over(running(by, order))).drop("__step")


def clock_offset(df: DataFrame, raw_s: str, by: Names, order: Names, nominal: float = 0.1, out: str = "t") -> DataFrame:
    """The other repair: any backward step moves the clock's origin so that the row follows its predecessor."""
    w = over(by, order)
    d = diff(F.col(raw_s), w)
    step = F.when(d.isNull(), F.col(raw_s)).when(d < 0, F.lit(nominal)).otherwise(d)
    return df.withColumn("__step", step).withColumn(out, F.sum("__step").over(running(by, order))).drop("__step")


def first_of_time(df: DataFrame, t: str, by: Names, tie: Names) -> DataFrame:
    """One row for each time, the first by `tie`."""
    w = over([*_list(by), t], tie)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def changed(df: DataFrame, cols: Names, by: Names, order: Names) -> DataFrame:
    """Rows where any of the columns differs from the row before; the first row stays."""
    w = over(by, order)
    same = F.lit(True)
    for c in _list(cols):
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return df.withColumn("__same", same & (F.row_number().over(w) > 1)).where("NOT __same").drop("__same")


def resample(df: DataFrame, cols: Names, by: Names, t: str, rate: float, origin: Column | None = None) -> DataFrame:
    """Linear interpolation onto a uniform grid: by, tick, t and the columns.

    Times must be distinct within a session. Each sample makes the grid points up to its successor, so the work is one
    sort by session and an explode whose size is the output's.
    """
    by, cols = _list(by), _list(cols)
    w = over(by, t)
    start = origin if origin is not None else F.min(t).over(Window.partitionBy(*by))
    b = df.select(*by, t, *cols, start.alias("__t0"), F.lead(t).over(w).alias("__t1"), *(F.lead(c).over(w).alias(f"__{c}") for c in cols))
    lo, hi = F.ceil((F.col(t) - F.col("__t0")) * rate), F.ceil((F.col("__t1") - F.col("__t0")) * rate) - 1
    last = F.col("__t1").isNull()
    ticks = F.when(last, F.when(F.abs((F.col(t) - F.col("__t0")) * rate - lo) < 1e-9, F.array(lo))).when(hi >= lo, F.sequence(lo, hi))
    g = b.withColumn("tick", F.explode(ticks)).withColumn("__g", F.col("__t0") + F.col("tick") / F.lit(float(rate)))
    a = F.when(last, F.lit(0.0)).otherwise((F.col("__g") - F.col(t)) / (F.col("__t1") - F.col(t)))
    return g.select(*by, F.col("tick").cast("long").alias("tick"), F.col("__g").alias(t), *((F.col(c) + F.coalesce(F.col(f"__{c}") - F.col(c), F.lit(0.0)) * a).alias(c) for c in cols))


def scan(df: DataFrame, by: Names, order: Names, cols: list[str], step: Callable[[], Callable], out: str) -> DataFrame:
    """A kernel over ordered rows, for scans that need the result before: adds the columns of `out` to `cols`.

    Rows come in batches, sorted by session and order, so a task holds one batch however long a session is; many short
    sessions share a batch. step() makes a task's kernel, which keeps its state from batch to batch: it gets a mask of rows
    that begin a session and the columns as arrays, and gives a mask of the rows to keep (None: all) and the new columns.
    Windows are cheaper wherever they can express the scan.
    """
    rows = df.select(*dict.fromkeys([*_list(by), *_list(order), *cols]), (F.row_number().over(over(by, order)) == 1).alias("__first"))
    names = rows.columns[:-1]
    kept = [rows.schema[c] for c in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *([out] if out else [])])
    added = [part.split()[0].strip("`") for part in out.split(",") if part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = step()
        for batch in batches:
            if batch.num_rows:
                values = {c: batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in cols}
                mask, new = kernel(batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool), values)
                same = batch.select(names) if mask is None else batch.select(names).filter(pa.array(mask))
                yield pa.RecordBatch.from_arrays([*same.columns, *(pa.array(x) for x in new)], names=[*names, *added])

    return rows.mapInArrow(run, schema)


def affine_scan(m: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, state: float) -> np.ndarray:
    """States of x -> min(high, max(low, m * x + c)) applied row after row to `state`; m is never negative.

    Such functions are closed under composition, so all prefixes come from log n vector steps.
    """
    m, c, low, high = (np.array(x, dtype=float) for x in (m, c, low, high))
    shift = 1
    while shift < len(m):
        # This row's function after the one `shift` rows before; the first `shift` rows are complete.
        m1, c1, l1, h1, m2, c2, l2, h2 = m[:-shift], c[:-shift], low[:-shift], high[:-shift], m[shift:], c[shift:], low[shift:], high[shift:]
        through = lambda x: np.minimum(h2, np.maximum(l2, np.where(m2 == 0, 0.0, m2 * np.where(m2 == 0, 0.0, x)) + c2))  # noqa: B023, E731
        m, c, low, high = (np.concatenate([old[:shift], new]) for old, new in ((m, m1 * m2), (c, m2 * c1 + c2), (low, through(l1)), (high, through(h1))))
        shift *= 2
    return np.minimum(high, np.maximum(low, m * state + c))


def ema(df: DataFrame, col: str, by: Names, order: Names, alpha: float = 0.05, out: str = "ema") -> DataFrame:
    """Recursive mean: g = alpha * x + (1 - alpha) * g before, starting at the first sample."""

    def step() -> Callable:
        state = 0.0

        def kernel(first: np.ndarray, values: dict) -> tuple:
            nonlocal state
            x, none = values[col].astype(float), np.full(len(first), np.inf)
            got = affine_scan(np.where(first, 0.0, 1 - alpha), np.where(first, x, alpha * x), -none, none, state)
            state = float(got[-1])
            return None, [got]

        return kernel

    return scan(df, by, order, [col], step, f"`{out}` double")


def ewm_last(df: DataFrame, col: str, by: Names, order: Names, span: int = 20, out: str = "ewm") -> DataFrame:
    """The adjusted exponentially weighted mean at each session's last sample, in closed form."""
    w = Window.partitionBy(*_list(by)).orderBy(*(F.col(c).desc() for c in _list(order)))
    weight = F.pow(F.lit(1 - 2 / (span + 1)), F.row_number().over(w) - 1)
    return df.withColumn("__w", weight).groupBy(*_list(by)).agg((F.sum(F.col("__w") * F.col(col)) / F.sum("__w")).alias(out))


def _hops(first: np.ndarray, t: np.ndarray, span: float, start: float | None) -> tuple[np.ndarray, float]:
    """Rows that are the first of a session or at least `span` after the one hopped to before, and the last one's time.

    `start` is the time of the last hop of the session that goes on from the batch before. A step costs a search, so the
    work goes by hops and sessions, not by rows.
    """
    mask = np.zeros(len(t), dtype=bool)
    bounds = [*([] if first[0] else [0]), *np.flatnonzero(first).tolist(), len(t)]
    at = start
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = t[a:b]
        if first[a]:
            mask[a], at, i = True, own[0], 1
        else:
            i = 0
        rising = bool((np.diff(own) >= 0).all())
        while i < len(own):
            late = np.searchsorted(own[i:] - at, span, side="left") if rising else int(np.argmax(own[i:] - at >= span)) if (own[i:] - at >= span).any() else len(own) - i
            i += int(late)
            if i < len(own):
                mask[a + i], at = True, own[i]
                i += 1
    return mask, float(at)


def min_spacing(df: DataFrame, t: str, by: Names, order: Names, spacing: float) -> DataFrame:
    """Rows at least `spacing` after the last row kept; the first row stays. by, order columns and t."""

    def step() -> Callable:
        last = None

        def kernel(first: np.ndarray, values: dict) -> tuple:
            nonlocal last
            mask, last = _hops(first, values[t].astype(float), spacing, last)
            return mask, []

        return kernel

    return scan(df, by, order, [t], step, "")


def block_average(df: DataFrame, col: str, t: str, by: Names, order: Names, span: float = 0.1) -> DataFrame:
    """Means of blocks: one ends at the first sample at least `span` after its start; the next starts at that time.

    Which block a sample is in comes from a scan; means are sums by session and block. A block that doesn't end is left out.
    """
    keys = _list(by)

    def step() -> Callable:
        last, before = None, 0

        def kernel(first: np.ndarray, values: dict) -> tuple:
            nonlocal last, before
            mask, last = _hops(first, values[t].astype(float), span, last)
            ends = mask & ~first
            so_far = np.cumsum(ends)
            began = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
            block = so_far - ends - np.where(began >= 0, so_far[began], -before)
            before = int(block[-1] + ends[-1])
            return None, [block, ends]

        return kernel

    rows = scan(df, by, order, list(dict.fromkeys([t, col])), step, "block long, __ends boolean")
    blocks = rows.groupBy(*keys, "block").agg(F.max(F.when(F.col("__ends"), F.col(t))).alias("t"), F.avg(col).alias("mean"))
    return blocks.where("t IS NOT NULL")


def integrate_reseed(df: DataFrame, t: str, accel: str, speed: str, by: Names, order: Names, low: float = 0.0, high: float = 70.0, leak: float = 0.0, out: str = "speed_est") -> DataFrame:
    """Speed from acceleration, set to the fix where there is one and kept within [low, high]; starts at zero."""

    def step() -> Callable:
        state, last = 0.0, 0.0

        def kernel(first: np.ndarray, values: dict) -> tuple:
            nonlocal state, last
            at = values[t].astype(float)
            dt = np.where(first, 0.0, np.diff(at, prepend=last))
            fix = values[speed].astype(float)
            fixed, keep = ~np.isnan(fix), np.maximum(0.0, 1.0 - leak * dt)
            none = np.full(len(at), np.inf)
            got = affine_scan(np.where(fixed | first, 0.0, keep), np.where(fixed, fix, values[accel].astype(float) * dt * keep), np.where(fixed, -none, low), np.where(fixed, none, high), state)
            state, last = float(got[-1]), float(at[-1])
            return None, [got]

        return kernel

    return scan(df, by, order, list(dict.fromkeys([t, accel, speed])), step, f"`{out}` double").drop(*(c for c in (accel, speed, t) if c not in [*_list(by), *_list(order)]))


def dead_reckoning(df: DataFrame, by: Names, order: Names, t: str = "t", ax: str = "ax", ay: str = "ay", yaw: str = "gyro_yaw", start: tuple[float, float, float, float, float] = (0, 0, 0, 0, 0)) -> DataFrame:
    """Adds psi, vn, ve, pn, pe: heading, velocity and position by three nested running sums.

    Heading adds this row's rate; velocity adds the rotated acceleration; position adds the mean of two velocities.
    """
    w, r = over(by, order), running(by, order)
    n0, e0, vn0, ve0, psi0 = (F.lit(float(x)) for x in start)
    out = df.withColumn("__dt", F.coalesce(diff(F.col(t), w), F.lit(0.0)))
    out = out.withColumn("psi", psi0 + F.sum(F.col(yaw) * F.col("__dt")).over(r))
    c, s = F.cos("psi"), F.sin("psi")
    out = out.withColumn("vn", vn0 + F.sum((F.col(ax) * c - F.col(ay) * s) * F.col("__dt")).over(r)).withColumn("ve", ve0 + F.sum((F.col(ax) * s + F.col(ay) * c) * F.col("__dt")).over(r))
    mid = lambda v: F.coalesce((F.col(v) + F.lag(v).over(w)) / 2, F.lit(0.0)) * F.col("__dt")
    out = out.withColumn("__dn", mid("vn")).withColumn("__de", mid("ve"))
    return out.withColumn("pn", n0 + F.sum("__dn").over(r)).withColumn("pe", e0 + F.sum("__de").over(r)).drop("__dt", "__dn", "__de")


def islands(flag: Column, w: WindowSpec) -> Column:
    """Number of flagged rows so far: a new island starts at each."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
