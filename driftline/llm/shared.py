"""Storage and planning helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times this many bytes a row stay within BROADCAST_BYTES.
BROADCAST_BYTES = 32 << 20

_local_dirs: dict[str, str] = {}
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _local_dirs[app] = tempfile.mkdtemp(prefix="driftline-")
        atexit.register(_remove_local, _local_dirs[app])
    return f"file://{_local_dirs[app]}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    passing(spark, path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def passing(spark: SparkSession, path: str) -> None:
    """Notes a folder of the shared store that is to go when the driver ends, or with clear()."""
    if not _tables:
        atexit.register(_remove_tables)
    _tables[path] = spark


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables made so far, for a driver that lives on: results must have been read or written."""
    for path, owner in list(_tables.items()):
        if owner is spark:
            remove(spark, path)


def _remove_tables() -> None:
    """Intermediate tables go when the driver ends; one that is killed leaves them to the folder's owner."""
    for path, spark in list(_tables.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended first
            return


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of the shared store that nothing reads any more."""
    _tables.pop(path, None)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_enough(rows: int, bytes_a_row: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * bytes_a_row <= limit


def maybe_broadcast(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    """A broadcast hint where the counted size allows it; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if small_enough(rows, bytes_a_row) else df


def measured_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the rows of `df`, measured with their strings and arrays, take at most `limit` bytes.

    `df` should be a table in the shared folder or little more, as it is read to be measured.
    """
    bytes_of = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            bytes_of = bytes_of + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif kind == "array":
            bytes_of = bytes_of + F.coalesce(F.octet_length(F.to_json(F.col(f.name))), F.lit(0))
    total = df.agg(F.sum(bytes_of)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


class Store:
    """Whole-file reads and writes below a URI, usable in tasks; a write appears under its name only when complete."""

    def __init__(self, uri: str):
        parsed = urlparse(uri)
        self.local = parsed.path if parsed.scheme in ("", "file") else None
        self.uri = uri
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
        else:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(uri)
            self.fs.create_dir(self.base, recursive=True)

    def writer(self, name: str):
        """An open binary file under a name of this attempt's own, for commit()."""
        temp = f".{name}.{uuid.uuid4().hex}"
        if self.local is not None:
            return temp, open(os.path.join(self.local, temp), "wb")  # noqa: SIM115
        return temp, self.fs.open_output_stream(f"{self.base}/{temp}")

    def commit(self, temp: str, name: str) -> None:
        """Attempts of a task write equal bytes, so whichever comes last may win."""
        if self.local is not None:
            os.replace(os.path.join(self.local, temp), os.path.join(self.local, name))
        else:
            self.fs.move(f"{self.base}/{temp}", f"{self.base}/{name}")

    def open(self, name: str):
        if self.local is not None:
            return open(os.path.join(self.local, name), "rb")  # noqa: SIM115
        return self.fs.open_input_file(f"{self.base}/{name}")

    def read(self, name: str) -> bytes:
        with self.open(name) as f:
            return f.read()

    def put(self, name: str, data: bytes) -> None:
        temp, f = self.writer(name)
        with io.BufferedWriter(f) if isinstance(f, io.RawIOBase) else f:
            f.write(data)
        self.commit(temp, name)
