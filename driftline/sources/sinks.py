"""Writers: event logs, session CSV, tensors, fixtures, regression logs, the session catalogue, a bounded queue."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.ordered import scan
from driftline.storage import put


def merged_lines(imu: DataFrame, gnss: DataFrame, tie: list[str]) -> DataFrame:
    """session_id, t, stream_rank, the tie columns and line of both streams; fixes come after samples of the same time."""
    cols = ["session_id", "t", *tie, "line"]
    return imu.select(*cols, F.lit(0).alias("stream_rank")).unionByName(gnss.select(*cols, F.lit(1).alias("stream_rank")))


def log_lines(rows: DataFrame, kind: str, places: dict[str, int]) -> DataFrame:
    """session_id, t, line: JSON of each row with fixed rounding; null fields are left out."""
    fields = [F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in rows.columns if c != "session_id"]
    return rows.select("session_id", "t", F.to_json(F.struct(F.lit(kind).alias("type"), *fields)).alias("line"))


def write_log(imu: DataFrame, gnss: DataFrame, path: str, device: str = "unknown") -> None:
    """JSONL logs, a folder for each session: header first, then samples and fixes by time."""
    a = log_lines(imu, "imu", {c: 6 for c in imu.columns if c not in ("session_id",)})
    b = log_lines(gnss, "gnss", {"t": 6, "lat": 8, "lon": 8, "speed": 3, "bearing": 2, "accuracy": 2})
    head = imu.select("session_id").distinct().select("session_id", F.lit(float("-inf")).alias("t"), F.to_json(F.struct(F.lit("header").alias("type"), F.lit(1).alias("schema"), F.lit(device).alias("device"))).alias("line"), F.lit(-1).alias("stream_rank"))
    both = head.unionByName(a.withColumn("stream_rank", F.lit(0))).unionByName(b.withColumn("stream_rank", F.lit(1)))
    both.repartition("session_id").sortWithinPartitions("session_id", "t", "stream_rank").select("session_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("session_id").text(path)


def write_session_csv(imu: DataFrame, gnss: DataFrame, path: str) -> None:
    """One CSV folder a session, by time, with a column that tells the streams apart."""
    cols = ["t", "ax", "ay", "az", "gx", "gy", "gz", "lat", "lon", "speed", "bearing", "accuracy", "withheld"]
    pad = lambda df, kind, rank: df.select("session_id", F.lit(kind).alias("stream"), F.lit(rank).alias("stream_rank"), *(F.col(c) if c in df.columns else F.lit(None).cast("boolean" if c == "withheld" else "double").alias(c) for c in cols))
    both = pad(imu, "imu", 0).unionByName(pad(gnss, "gnss", 1), allowMissingColumns=True)
    both.repartition("session_id").sortWithinPartitions("session_id", "t", "stream_rank").drop("stream_rank").write.mode("overwrite").partitionBy("session_id").option("header", True).csv(path)


def write_streams(df: DataFrame, path: str) -> None:
    """Parquet by session and stream, so that readers prune to what they name; one file a folder, however many tasks."""
    df.repartition("session_id", "stream").write.mode("overwrite").partitionBy("session_id", "stream").parquet(path)


def write_tensors(windows: DataFrame, path: str) -> None:
    """Windows with array columns as Parquet by split; refuses windows of different lengths in a column."""
    arrays = [f.name for f in windows.schema.fields if f.dataType.typeName() == "array"]
    spans = windows.agg(*(F.countDistinct(F.size(c)).alias(c) for c in arrays)).first()
    if any(spans[c] > 1 for c in arrays):
        raise ValueError("windows differ in length")
    out = windows.write.mode("overwrite")
    (out.partitionBy("split") if "split" in windows.columns else out).parquet(path)


def write_npy(windows: DataFrame, window: str, label: str, path: str) -> None:
    """windows-<n>.npy and labels-<n>.npy for each partition; a partition whose windows differ in length fails.

    A task writes its own pair, so partitions should be small enough to hold; repartition before as needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            if len(set(sizes.tolist()) | {x.shape[1] for x in xs}) > 1:
                raise ValueError("windows differ in length")
            if len(sizes):
                xs.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1))
                ys.append(batch.column(1).to_numpy(zero_copy_only=False))
        if xs:
            for kind, parts in (("windows", xs), ("labels", ys)):
                out = io.BytesIO()
                np.save(out, np.concatenate(parts), allow_pickle=False)
                put(path, f"{kind}-{TaskContext.get().partitionId():05d}.npy", out.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, xs))])], names=["n"])

    windows.select(F.col(window).cast("array<float>"), F.col(label).cast("double")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_fixture(cycles: DataFrame, by: str, order: str, inputs: list[str], expected: list[str], path: str, tolerances: dict[str, float]) -> None:
    """A JSON document for each route, one a line: tolerances, and its cycles in order with inputs and expected results.

    Another implementation replays the inputs and compares. A route is one drive, so it fits a row.
    """
    cycle = F.struct(F.col(order).alias("i"), F.struct(*inputs).alias("input"), F.struct(*expected).alias("expected"))
    limits = F.struct(*(F.lit(v).alias(k) for k, v in tolerances.items()))
    routes = cycles.groupBy(by).agg(F.sort_array(F.collect_list(cycle)).alias("cycles"))
    doc = F.struct(F.lit(1).alias("schema_version"), F.col(by), limits.alias("tolerances"), F.size("cycles").alias("n_cycles"), "cycles")
    routes.select(F.to_json(doc).alias("value")).write.mode("overwrite").text(path)


def bounded_queue(rows: DataFrame, t: str, by: str, order: list[str], capacity: int, service: float) -> DataFrame:
    """by, order columns and accepted: rows that a writer takes `service` each for, behind a queue of `capacity` rows.

    A row that finds the queue full is dropped; the writer goes on with what it has. What a queue holds follows from
    whether the rows before were taken, so this is a scan.
    """

    def step() -> Callable:
        free = 0.0

        def kernel(first: np.ndarray, values: dict) -> tuple:
            nonlocal free
            out = []
            for begins, at in zip(first.tolist(), values[t].tolist(), strict=True):
                free = at if begins else free
                taken = max(free - at, 0.0) < capacity * service
                out.append(taken)
                free = max(free, at) + service if taken else free
            return None, [np.array(out)]

        return kernel

    return scan(rows, by, order, [t], step, "accepted boolean")


def write_files(rows: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """A file for each row: its name, which may have folders, and its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for where, what in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, _, own = where.rpartition("/")
                put(f"{path}/{folder}" if folder else path, own, (what or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    rows.select(name, text).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_svg(points: DataFrame, by: str, order: str, x: str, y: str, path: str, most: int = 1000) -> None:
    """An SVG file for each series with its points as a polyline, fitted to a square.

    A series with more than `most` points is drawn with as many means of equal runs of points, so a file stays small.
    """
    w = Window.partitionBy(by)
    n = F.count(F.lit(1)).over(w)
    at = F.row_number().over(w.orderBy(order)) - 1
    runs = points.withColumn("__run", F.floor(at * F.least(n, F.lit(most)) / n)).groupBy(by, "__run").agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    span = F.greatest(F.max("x").over(w) - F.min("x").over(w), F.max("y").over(w) - F.min("y").over(w), F.lit(1e-9))
    place = lambda c: F.round((F.col(c) - F.min(c).over(w)) / span * 1000, 1)
    placed = runs.select(by, "__run", F.concat_ws(",", place("x").cast("string"), (1000 - place("y")).cast("string")).alias("p"))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__run", "p"))), lambda r: r["p"]), " ")
    head = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="-10 -10 1020 1020"><polyline fill="none" stroke="black" points="'
    files = placed.groupBy(by).agg(F.concat(F.lit(head), line, F.lit('"/></svg>')).alias("text"))
    write_files(files.select(F.concat(F.col(by).cast("string"), F.lit(".svg")).alias("name"), "text"), path)


def append_regression(result: DataFrame, path: str, commit: str, route: str | None = None) -> None:
    """Appends result rows with a time, commit and route (given, or a column) to a CSV folder; every part has the header."""
    own = F.lit(route) if route is not None else F.col("route")
    rest = [c for c in result.columns if c != "route"]
    result.select(F.current_timestamp().alias("ts"), F.lit(commit).alias("commit"), own.alias("route"), *rest).coalesce(1).write.mode("append").option("header", True).csv(path)


def recover_catalog(raw: DataFrame, meta: DataFrame, now: float | None = None, orphan_s: float = 20.0) -> DataFrame:
    """The catalogue: known sessions, and summaries of raw sessions without metadata that ended orphan_s ago; newest first.

    raw: session_id, t (epoch seconds), speed; meta: session_id, started, ended, distance_m. Without `now` the latest sample
    of any session stands for it.
    """
    orphan = raw.join(meta, "session_id", "left_anti").groupBy("session_id").agg(F.min("t").alias("started"), F.max("t").alias("ended"), F.sum("speed").alias("distance_m"))
    clock = raw.agg(F.max("t")).scalar() if now is None else F.lit(float(now))
    orphan = orphan.where(clock - F.col("ended") > orphan_s)
    return meta.select("session_id", "started", "ended", "distance_m", F.lit(False).alias("recovered")).unionByName(orphan.withColumn("recovered", F.lit(True))).orderBy(F.desc("started"), "session_id")
