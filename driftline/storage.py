"""Folders that driver and executors share, and whole-file access to them from tasks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; with a local master and that unset, below a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        app = spark.sparkContext.applicationId
        if app not in _local:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            _local[app] = tempfile.mkdtemp(prefix="driftline-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        where = f"file://{_local[app]}"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def put(folder: str, name: str, data: bytes) -> None:
    """Writes a file of a folder; it appears under its name when complete, so a task that runs again replaces it."""
    parsed = urlparse(folder)
    temp = f".{name}.{uuid.uuid4().hex}"
    if parsed.scheme in ("", "file"):
        os.makedirs(parsed.path, exist_ok=True)
        with open(os.path.join(parsed.path, temp), "wb") as f:
            f.write(data)
        os.replace(os.path.join(parsed.path, temp), os.path.join(parsed.path, name))
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{temp}") as f:
        f.write(data)
    store.move(f"{base}/{temp}", f"{base}/{name}")
