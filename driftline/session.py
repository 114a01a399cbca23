"""Sessions with the settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "driftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster, leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        cores = master[master.find("[") + 1 : -1] if "[" in master else "8"
        cores = str(os.cpu_count()) if cores == "*" else cores
        builder = builder.master(master).config("spark.sql.shuffle.partitions", cores).config("spark.driver.memory", "8g")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
