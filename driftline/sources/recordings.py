"""Recordings of sessions: CSV with loose headers, JSONL event logs, file discovery, road graphs, model tensors.

Readers resolve names on the driver from a file's header alone; all rows are read and cast by executors.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.scalar import session_of_file

#: Canonical names of the vehicle stream and a pattern for its normalised header (fixed values of the input format).
VEHICLE = {"time_s": r"^time|^t\b", "lat": r"latitude|^lat", "lon": r"longitude|^lon", "velocity_kmh": r"velocity.*km|^speed", "heading_deg": r"^heading", "yaw_rate_dps": r"yaw.?rate", "wheel_speed_fl": r"wheel.*(front.?left|fl)", "wheel_speed_fr": r"wheel.*(front.?right|fr)"}
PHONE = {"time_ms": r"^time", "gps_lat": r"gps.*lat", "gps_lon": r"gps.*lon", "gps_speed_kmh": r"gps.*speed", "accel_x": r"accel.* x|accel_x", "accel_y": r"accel.* y|accel_y", "accel_z": r"accel.* z|accel_z", "gravity_x": r"gravity.* x|gravity_x", "gravity_y": r"gravity.* y|gravity_y", "gravity_z": r"gravity.* z|gravity_z", "gyro_yaw": r"gyro.*(yaw|z)"}


#: The characters of bytes 128 to 159 in ISO-8859-1, and what windows-1252 has there.
_WESTERN = ("".join(map(chr, range(128, 160))), bytes(range(128, 160)).decode("cp1252", "replace"))


def _norm(name: str) -> str:
    return re.sub(r"\s+", " ", name).strip().lower()


def resolve(columns: list[str], wanted: dict[str, str]) -> dict[str, str]:
    """Canonical name -> actual column, the first whose normalised header matches; fails naming all unmatched."""
    out, missing = {}, []
    for canon, pattern in wanted.items():
        hit = next((c for c in columns if re.search(pattern, _norm(c))), None)
        if hit is None:
            missing.append(canon)
        else:
            out[canon] = hit
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(columns)}")
    return out


def read_csv(spark: SparkSession, path: str | list[str], wanted: dict[str, str], encoding: str = "UTF-8", drop_malformed: bool = False, texts: dict[str, str] | None = None) -> DataFrame:
    """CSV with canonical names as doubles (what doesn't parse is null) and the file it came from.

    For files that aren't UTF-8 give `encoding` "windows-1252"; with drop_malformed lines of another length go. Columns of
    `texts` are found like those of `wanted` and stay text. Commas within double quotes are part of a field.
    """
    western = encoding == "windows-1252"  # which Spark reads as ISO-8859-1, but for _WESTERN
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1" if western else encoding).option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).csv(path)
    found, plain = resolve(raw.columns, wanted), resolve(raw.columns, texts or {})
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return raw.select(*(q(actual).try_cast("double").alias(canon) for canon, actual in found.items()), *((F.translate(q(actual), *_WESTERN) if western else q(actual)).alias(canon) for canon, actual in plain.items()), F.col("_metadata.file_name").alias("file_name"))


def split_quoted(line: Column) -> Column:
    """The fields of a line, cut at commas outside of double quotes, without the quotes."""
    return F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda f: F.replace(f, F.lit('"'), F.lit("")))


def read_csv_any(spark: SparkSession, path: str | list[str], wanted: dict[str, str], texts: dict[str, str] | None = None) -> DataFrame:
    """Each file as UTF-8, or as windows-1252 if it holds bytes that aren't UTF-8; one look at all lines tells which do."""
    lines = spark.read.text(path)
    name = lambda f: re.sub("^file:/+", "file:/", unquote(f))
    odd = {name(r[0]) for r in lines.where(~F.is_valid_utf8("value")).select("_metadata.file_path").distinct().collect()}
    if not odd:
        return read_csv(spark, path, wanted, texts=texts)
    plain = [f for f in map(name, lines.inputFiles()) if f not in odd]
    out = read_csv(spark, sorted(odd), wanted, "windows-1252", texts=texts)
    return out.unionByName(read_csv(spark, plain, wanted, texts=texts)) if plain else out


def pair_files(files: DataFrame, col: str) -> DataFrame:
    """Sessions from V-<id>.csv and S-<id>.csv names: session_id (unsync_ before those with V alone), has_v, has_s."""
    name = F.element_at(F.split(F.col(col), "/"), -1)
    sid = files.select(session_of_file(name).alias("sid"), F.upper(F.substring(name, 1, 1)).alias("kind")).where("sid <> ''")
    p = sid.groupBy("sid").agg(F.bool_or(F.col("kind") == "V").alias("has_v"), F.bool_or(F.col("kind") == "S").alias("has_s"))
    return p.select(F.when(F.col("has_v") & ~F.col("has_s"), F.concat(F.lit("unsync_"), "sid")).otherwise(F.col("sid")).alias("session_id"), "has_v", "has_s")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Sessions below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
    return pair_files(files, "path")


LOG = T.StructType([T.StructField("type", T.StringType()), T.StructField("schema", T.IntegerType()), T.StructField("device", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("t", "ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz", "lat", "lon", "speed", "bearing", "accuracy", "pn", "pe")), T.StructField("withheld", T.BooleanType()), T.StructField("_bad", T.StringType())])


def log_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All whole lines of known types of JSONL event logs, with the file's name as session_id."""
    raw = spark.read.schema(LOG).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("session_id", F.col("_metadata.file_name"))
    return raw.where("_bad IS NULL AND type IN ('header', 'imu', 'gnss', 'fused', 'coast')").drop("_bad")


def read_log(spark: SparkSession, path: str | list[str], decimate_s: float | None = None) -> dict[str, DataFrame]:
    """imu, gnss, fused, coast and header rows of JSONL event logs, each with session_id (the file's name) and t from zero.

    Blank, truncated and unknown lines go; a missing `withheld` is false; a missing magnetometer is null, not zero.
    Sessions without any imu row or any gnss row are in `rejected` and nowhere else. With decimate_s, fused and coast rows
    closer than that to the last one kept go.
    """
    rows = log_rows(spark, path)
    s = rows.groupBy("session_id").agg(F.min(F.when(F.col("type") == "imu", F.col("t"))).alias("__t0"), F.count_if(F.col("type") == "imu").alias("n_imu"), F.count_if(F.col("type") == "gnss").alias("n_gnss"))
    good = rows.join(s.where("n_imu > 0 AND n_gnss > 0"), "session_id").withColumn("t", F.col("t") - F.col("__t0"))
    cols = {"imu": ["t", "ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz"], "gnss": ["t", "lat", "lon", "speed", "bearing", "accuracy", "withheld"], "fused": ["t", "pn", "pe"], "coast": ["t", "pn", "pe"], "header": ["schema", "device"]}
    out = {k: good.where(F.col("type") == k).select("session_id", *v) for k, v in cols.items()}
    out["gnss"] = out["gnss"].withColumn("withheld", F.coalesce("withheld", F.lit(False)))
    if decimate_s:
        from driftline.operators.ordered import min_spacing

        for k in ("fused", "coast"):
            out[k] = min_spacing(out[k], "t", "session_id", ["t", "pn", "pe"], decimate_s)
    return out | {"rejected": s.where("n_imu = 0 OR n_gnss = 0").drop("__t0")}


def sniff(spark: SparkSession, path: str) -> str:
    """jsonl if the first character that isn't blank (or a byte-order mark) is a brace, csv otherwise."""
    head = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    return "jsonl" if head and head[0][0].lstrip("﻿ \t").startswith("{") else "csv"


def sniff_all(spark: SparkSession, path: str) -> DataFrame:
    """format of every file below a folder, with its partition columns, by the first line that isn't blank."""
    lines = spark.read.text(path).withColumn("file_name", F.col("_metadata.file_path")).withColumn("at", F.col("_metadata.file_block_start"))
    keys = [c for c in lines.columns if c not in ("value", "at")]
    first = lines.where(F.length(F.trim("value")) > 0).withColumn("row", F.monotonically_increasing_id()).groupBy(*keys).agg(F.min_by("value", F.struct("at", "row")).alias("head"))
    head = F.ltrim(F.col("head"), F.lit("\ufeff \t"))
    return first.select(*keys, F.when(head.startswith("{"), "jsonl").otherwise("csv").alias("format"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """session_id, driver_code, split, synced of a manifest: one JSON object with a map of sessions."""
    kind = "struct<sessions: map<string, struct<driver_code: string, split: string, synced: boolean>>>"
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return j.select(F.explode("m.sessions").alias("session_id", "s")).select("session_id", "s.*")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, lat, lon) and edges (u, v) of a GraphML road graph whose data keys are named by the file.

    The y and x keys are looked up among the file's <key> elements.
    """
    keys = spark.read.format("xml").option("rowTag", "key").load(path).select(F.col("`_id`").alias("id"), F.col("`_attr.name`").alias("name")).where("name IN ('x', 'y')").collect()
    of = {r.name: r.id for r in keys}
    data = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_VALUE", T.StringType())]))
    node = T.StructType([T.StructField("_id", T.StringType()), T.StructField("data", data)])
    edge = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_target", T.StringType()), T.StructField("data", data)])
    value = lambda k: F.get(F.filter("data", lambda x: x["_key"] == of.get(k, k)), F.lit(0))["_VALUE"].try_cast("double")
    nodes = spark.read.format("xml").option("rowTag", "node").schema(node).load(path).select(F.col("_id").alias("id"), value("y").alias("lat"), value("x").alias("lon"))
    edges = spark.read.format("xml").option("rowTag", "edge").schema(edge).load(path).select(F.col("_source").alias("u"), F.col("_target").alias("v"))
    return nodes, edges


def read_overpass(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes (id, lat, lon) and edges (way, highway, u, v) of saved answers of an Overpass server in JSON.

    Fetching is not done here: a job without a network reads what was saved. A way's consecutive nodes are its edges;
    elements that several answers hold count once.
    """
    element = "struct<type: string, id: long, lat: double, lon: double, nodes: array<long>, tags: struct<highway: string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<elements: array<{element}>>")["elements"]).alias("e")).select("e.*")
    nodes = rows.where("type = 'node'").select("id", "lat", "lon").dropDuplicates(["id"])
    ways = rows.where("type = 'way' AND size(nodes) > 1").dropDuplicates(["id"])
    steps = F.expr("transform(sequence(0, size(nodes) - 2), i -> struct(nodes[i] AS u, nodes[i + 1] AS v))")
    return nodes, ways.select(F.col("id").alias("way"), F.col("tags.highway").alias("highway"), F.explode(steps).alias("s")).select("way", "highway", "s.u", "s.v")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """part, i, window (array of float) and label of windows-*.npy and labels-*.npy in a folder, which must pair up.

    A window of more dimensions is laid out flat, row by row. Fails where one of a pair is missing or their lengths differ.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select(F.regexp_extract(name, r"^(windows|labels)-", 1).alias("kind"), F.regexp_extract(name, r"-(.*)\.npy$", 1).alias("part"), "content")
    side = lambda kind: files.where(F.col("kind") == kind).select("part", F.col("content").alias(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, windows, labels in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if windows is None or labels is None:
                    raise ValueError(f"{'labels' if labels is None else 'windows'}-{part}.npy is missing")
                x, y = (np.load(io.BytesIO(b), allow_pickle=False) for b in (windows, labels))
                if len(x) != len(y):
                    raise ValueError(f"windows and labels of {part} differ in length: {len(x)} and {len(y)}")
                x = np.ascontiguousarray(x, dtype=np.float32).reshape(len(x), -1)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(x), type=pa.string()), pa.array(np.arange(len(x))), pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), pa.array(y.astype(float).reshape(len(y), -1)[:, 0] if len(y) else np.zeros(0))], names=["part", "i", "window", "label"])

    return side("windows").join(side("labels"), "part", "full").select("part", "windows", "labels").mapInArrow(run, "part string, i long, window array<float>, label double")


def session_frame(v: DataFrame, by: str = "session_id") -> DataFrame:
    """The 10 Hz frame of a vehicle recording: time from zero, dt (median where unknown), speed in m/s, yaw rate in rad/s."""
    w = Window.partitionBy(by)
    o = w.orderBy("time_s")
    x = v.withColumn("time", F.col("time_s") - F.min("time_s").over(w)).withColumn("__d", F.col("time_s") - F.lag("time_s").over(o))
    dt: Column = F.coalesce("__d", F.median("__d").over(w))
    return x.select(by, "time", dt.alias("dt"), (F.col("velocity_kmh") / 3.6).alias("true_speed"), "lat", "lon", F.radians("yaw_rate_dps").alias("v_yaw_rate"))
