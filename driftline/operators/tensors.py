"""Windows of samples as training rows. A sample is sent to the windows it belongs to, then windows are grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """i (from 0) and n (rows of the session)."""
    w = Window.partitionBy(*by)
    return df.withColumn("i", F.row_number().over(w.orderBy(*order)).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(w))


def sliding(df: DataFrame, by: list[str], order: list[str], size: int, stride: int, drop_last: bool = False) -> DataFrame:
    """Rows with wid for every window of `size` rows each `stride` rows that lies within the session.

    drop_last leaves out a window that ends exactly with the session.
    """
    x = numbered(df, by, order)
    last = F.floor((F.col("n") - size - (1 if drop_last else 0)) / stride)
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / stride))
    hi = F.least(F.floor(F.col("i") / stride), last)
    return x.where((hi >= lo) & (F.col("n") >= size + (1 if drop_last else 0))).withColumn("wid", F.explode(F.sequence(lo, hi)))


def tensor(windows: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """One row a window: an array of floats for each column, in order."""
    rows = F.sort_array(F.collect_list(F.struct("i", *cols)))
    g = windows.groupBy(*by, "wid").agg(rows.alias("rows"))
    return g.select(*by, "wid", *(F.col(f"rows.{c}").cast("array<float>").alias(c) for c in cols))


def causal(df: DataFrame, by: list[str], order: list[str], size: int, stride: int, target: str) -> DataFrame:
    """Windows [i - size, i) with the target at i, for i = size, size + stride, ...: rows with wid and target_value."""
    x = numbered(df, by, order)
    x = x.withColumn("__targets", F.max("i").over(Window.partitionBy(*by)))
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") + 1 - size) / stride))
    hi = F.least(F.floor(F.col("i") / stride), F.floor((F.col("__targets") - size) / stride))
    rows = x.where((hi >= lo) & (F.col("__targets") >= size)).withColumn("wid", F.explode(F.sequence(lo, hi)))
    y = x.where((F.col("i") >= size) & ((F.col("i") - size) % stride == 0)).select(*by, F.expr(f"(i - {size}) div {stride}").alias("wid"), F.col(target).alias("target_value"))
    return rows.drop("__targets").join(y, [*by, "wid"])


def padded(arr: Column, size: int, edge: bool = False) -> Column:
    """The last `size` values, padded on the left with zeros or the first value."""
    fill = F.coalesce(F.get(arr, F.lit(0)), F.lit(0.0)) if edge else F.lit(0.0)
    own = F.slice(arr, F.greatest(F.lit(1), F.size(arr) - size + 1), F.lit(size))
    return F.concat(F.array_repeat(fill, F.greatest(F.lit(0), F.lit(size) - F.size(arr))), own)


def rotation_augmented(df: DataFrame, key: list[str], x: str, y: str, seed: int = 0, max_deg: float = 30.0) -> DataFrame:
    """Rows and a copy rotated in the plane by an angle that a hash of the key and seed draws; train rows only."""
    u = (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 20)) + 0.5) / F.lit(float(1 << 20))
    a = F.radians((2 * u - 1) * max_deg)
    turned = df.withColumns({x: F.col(x) * F.cos(a) - F.col(y) * F.sin(a), y: F.col(x) * F.sin(a) + F.col(y) * F.cos(a)})
    return df.withColumn("augmented", F.lit(False)).unionByName(turned.withColumn("augmented", F.lit(True)))
