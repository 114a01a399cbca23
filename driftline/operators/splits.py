"""Session splits, gates and leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_split(sessions: DataFrame, id_col: str = "session_id", seed: int = 0, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Adds split: sessions in the order of an MD5 of id and seed, cut at rounded counts.

    Positions come from the sessions table alone (one row a session, not a sample), ranked within 65536 hash prefixes so
    that no single task sorts all of them.
    """
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    x = sessions.withColumn("__h", h).withColumn("__p", F.substring(h, 1, 4))
    sizes = x.groupBy("__p").agg(F.count("*").alias("__c"))  # at most 65536 rows
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).withColumn("__total", F.sum("__c").over(Window.partitionBy(F.lit(0))))
    x = x.join(F.broadcast(sizes.drop("__c")), "__p")
    pos = F.col("__before") + F.row_number().over(Window.partitionBy("__p").orderBy("__h", id_col))
    n_train, n_val = F.round(F.col("__total") * train), F.round(F.col("__total") * val)
    return x.withColumn("split", F.when(pos <= n_train, "train").when(pos <= n_train + n_val, "val").otherwise("test")).drop("__h", "__p", "__before", "__total")


def gate_reason(found: Column, corr: Column, note: Column, least: float = 0.5) -> Column:
    """Why a session is skipped; null if it passes."""
    return F.when(~found, "no_report").when(corr.isNull(), "no_corr").when(corr < least, "low_corr").when(note == "boundary", "boundary")


def excluded(corr: Column, least: float = 0.5) -> Column:
    """The split report's own, laxer rule: it doesn't look at the note."""
    return corr.isNull() | (corr < least)


def leaks(windows: DataFrame, id_col: str = "session_id", split_col: str = "split") -> DataFrame:
    """Sessions that occur in more than one split."""
    return windows.groupBy(id_col).agg(F.countDistinct(split_col).alias("n_splits")).where("n_splits > 1")


def common_pairs(windows: DataFrame, id_col: str = "session_id", split_col: str = "split") -> DataFrame:
    """For each two splits, how many sessions both have."""
    a = windows.select(F.col(split_col).alias("a"), id_col).distinct()
    return a.join(a.withColumnRenamed("a", "b"), id_col).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
