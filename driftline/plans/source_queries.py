"""Queries over readers, writers and synthetic inputs, and batch forms of the live path's rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import scalar as S
from driftline.operators import joins as J
from driftline.plans.ordered_queries import TRACK_SQL, R, W, _P, tracks
from driftline.plans.registry import query
from driftline.plans.surrogates import road, sig, table, with_
from driftline.sources import recordings, sinks
from driftline.sources.synthetic import synth_pair, synth_phone, synth_route
from driftline.storage import scratch

r6 = S.r6
SIG = with_("sig")


@query("src_synth_route", with_("synth") + " SELECT seq, round(t, 6) + 0.0 AS t, round(speed, 6) + 0.0 AS speed, round(psi, 6) + 0.0 AS psi, round(ax, 6) + 0.0 AS ax, round(ay, 6) + 0.0 AS ay FROM synth")
def src_synth_route(spark, d):
    return synth_route(spark, "varying_speed").select("seq", *(r6(F.col(c)).alias(c) for c in ("t", "speed", "psi", "ax", "ay")))


@query("src_synth_phone", "WITH g AS (SELECT unnest(generate_series(0, 179)) AS i) SELECT i::DOUBLE AS t, round(52.4 + i * 1e-5, 6) + 0.0 AS lat, round(12.0 * least(greatest((i - 8.0) / 10, 0.0), 1.0) * (CASE WHEN i >= 95 AND i < 115 THEN 0 ELSE 1 END), 6)::DOUBLE + 0.0 AS speed FROM g")
def src_synth_phone(spark, d):
    _, gnss = synth_phone(spark)
    return gnss.select("t", r6(F.col("lat")).alias("lat"), r6(F.col("speed")).alias("speed"))


@query("src_synth_pair", "WITH g AS (SELECT unnest(generate_series(0, 3299)) AS id), r AS (SELECT id % 11 AS s, id // 11 AS seq FROM g) SELECT printf('Syn%02d', s) AS session_id, seq, seq / 10.0::DOUBLE AS time_s, round(30.0 + sin(seq / 10.0::DOUBLE / 3) * 10, 6) + 0.0 AS velocity_kmh FROM r")
def src_synth_pair(spark, d):
    v, _ = synth_pair(spark)
    return v.select("session_id", "seq", "time_s", r6(F.col("velocity_kmh")).alias("velocity_kmh"))


@query("src_parquet", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def src_parquet(spark, d):
    return table(spark, d, "events").where("event_type IN ('view', 'click')").groupBy("event_type").agg(F.count("*").alias("n"))


# --- files: written below the scratch folder, then read back by the reader ---

_CSV = {k: recordings.VEHICLE[k] for k in ("time_s", "velocity_kmh", "yaw_rate_dps")}


@query("src_csv_schema_match", "SELECT p_partkey::DOUBLE AS time_s, p_size::DOUBLE AS velocity_kmh, TRY_CAST(p_name AS DOUBLE) AS yaw_rate_dps FROM part")
def src_csv_schema_match(spark, d):
    """Loose headers to canonical columns; what isn't a number is null."""
    path = scratch(spark, "csv")
    table(spark, d, "part").select(F.col("p_partkey").alias("Time   (s)"), F.col("p_size").alias("Velocity (km/h)"), F.col("p_name").alias("  Yaw Rate")).write.option("header", True).csv(path)
    return recordings.read_csv(spark, path, _CSV).drop("file_name")


@query("src_csv_encoding_fallback", "SELECT c_custkey::DOUBLE AS time_s, c_name || ' Müller, é' AS note FROM customer")
def src_csv_encoding_fallback(spark, d):
    """Files of both encodings in one folder, each read by its own."""
    path = scratch(spark, "csv")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("time"), F.concat("c_name", F.lit(" Müller, é")).alias("Note"))
    for name, encoding, part in (("old", "ISO-8859-1", "time % 2 = 0"), ("new", "UTF-8", "time % 2 = 1")):
        rows.where(part).write.option("header", True).option("encoding", encoding).csv(f"{path}/{name}")
    found = recordings.read_csv_any(spark, [f"{path}/old", f"{path}/new"], {"time_s": "^time"}, {"note": "^note"})
    return found.select("time_s", "note")


@query("src_csv_quoted_split", "SELECT p_partkey, 3 AS n, p_name || ', ' || p_type AS name FROM part")
def src_csv_quoted_split(spark, d):
    """Lines cut at the commas outside of double quotes."""
    path = scratch(spark, "lines")
    name = F.concat(F.lit('"'), "p_name", F.lit(", "), "p_type", F.lit('"'))
    table(spark, d, "part").select(F.concat_ws(",", F.col("p_partkey").cast("string"), name, F.col("p_size").cast("string")).alias("value")).write.text(path)
    f = recordings.split_quoted(F.col("value"))
    return spark.read.text(path).select(F.get(f, F.lit(0)).cast("long").alias("p_partkey"), F.size(f).alias("n"), F.get(f, F.lit(1)).alias("name"))


@query("src_format_sniff", "SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'jsonl' ELSE 'csv' END AS format FROM nation")
def src_format_sniff(spark, d):
    """The format of a recording of each nation by its first character."""
    path = scratch(spark, "sniff")
    n = table(spark, d, "nation")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("\ufeff  "), F.to_json(F.struct("n_name")))).otherwise(F.concat(F.lit("time,name\n1,"), "n_name"))
    n.select("n_name", line.alias("value")).repartition("n_name").write.partitionBy("n_name").text(path)
    return recordings.sniff_all(spark, path).select("n_name", "format")


@query("src_graphml", with_("road") + " SELECT 'n' || i AS id, round(n, 6) + 0.0 AS lat, round(e, 6) + 0.0 AS lon, CASE WHEN i < 199 THEN 'n' || (i + 1) END AS next FROM road")
def src_graphml(spark, d):
    """A road graph written as GraphML, with keys that only the file names, and its nodes with their edges."""
    path = scratch(spark, "graphml")
    node = F.format_string('<node id="n%d"><data key="d4">%.9f</data><data key="d5">%.9f</data></node>', "i", "n", "e")
    edge = F.when(F.col("i") < 199, F.format_string('<edge source="n%d" target="n%d"><data key="d9">x</data></edge>', F.col("i"), F.col("i") + 1)).otherwise("")
    head = F.lit('<graphml><key id="d4" for="node" attr.name="y"/><key id="d5" for="node" attr.name="x"/><graph>')
    lines = road(spark, d).groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.concat(node, edge).alias("x")))), lambda r: r["x"]), "").alias("x"))
    lines.select(F.concat(head, "x", F.lit("</graph></graphml>")).alias("value")).write.text(path)
    nodes, edges = recordings.read_graphml(spark, path)
    return nodes.join(edges, nodes.id == edges.u, "left").select("id", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), F.col("v").alias("next"))


@query("src_npy_tensor", "SELECT vec_id, len(embedding) AS n, round(list_sum([x::DOUBLE for x in embedding]), 4) + 0.0 AS total FROM embeddings")
def src_npy_tensor(spark, d):
    """Windows and labels as pairs of .npy files, read back with their lengths checked."""
    path = scratch(spark, "npy")
    sinks.write_npy(table(spark, d, "embeddings"), "embedding", "vec_id", path)
    x = recordings.read_npy(spark, path)
    return x.select(F.col("label").cast("long").alias("vec_id"), F.size("window").alias("n"), r6(F.aggregate("window", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"))


@query("src_discover_sessions", "WITH f AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 'S-' ELSE 'V-' END || 'x' || (n_nationkey // 2) || '.csv' AS f FROM nation), p AS (SELECT regexp_extract(f, '(?i)^[VS]-(.+)\\.csv$', 1) AS sid, bool_or(f LIKE 'V-%') AS v, bool_or(f LIKE 'S-%') AS s FROM f GROUP BY 1) SELECT CASE WHEN v AND NOT s THEN 'unsync_' || sid ELSE sid END AS session_id, v AS has_v, s AS has_s FROM p")
def src_discover_sessions(spark, d):
    """Sessions from the files below a folder, one folder and file for each nation."""
    path = scratch(spark, "found")
    key = F.col("n_nationkey")
    name = F.concat(F.when(key % 3 == 1, "S-").otherwise("V-"), F.lit("x"), F.expr("n_nationkey div 2").cast("string"), F.lit(".csv"))
    sinks.write_files(table(spark, d, "nation").select(F.concat(F.lit("d"), F.expr("n_nationkey % 3").cast("string"), F.lit("/"), name).alias("name"), F.lit("time\n1\n").alias("text")), path)
    return recordings.discover(spark, path)


def _lines(spark, d):
    kind = F.when(F.col("k") % 10 == 0, "gnss").otherwise("imu")
    rows = sig(spark, d).select("session_id", "t", "event_id", kind.alias("kind"), F.col("v").alias("speed"), F.when(F.col("k") % 2 == 0, F.col("k").cast("double")).alias("mx"))
    return rows


@query("snk_jsonl_log", SIG + " SELECT event_id, '{\"type\":\"imu\",\"event_id\":' || event_id || ',\"v\":' || CAST(v AS VARCHAR) || CASE WHEN k % 2 = 0 THEN ',\"mx\":' || k ELSE '' END || '}' AS line FROM sig")
def snk_jsonl_log(spark, d):
    """One JSON line a sample, as the file has it; an absent value is left out, not written as zero."""
    rows = sig(spark, d).select("session_id", "t", "event_id", "v", F.when(F.col("k") % 2 == 0, F.col("k")).alias("mx"))
    path = scratch(spark, "log")
    sinks.log_lines(rows.withColumn("t", F.lit(None).cast("double")), "imu", {"v": 2}).select(F.col("line").alias("value")).write.text(path)
    return spark.read.text(path).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.col("value").alias("line"))


@query("src_jsonl_session", SIG + " SELECT CASE WHEN k % 10 = 0 THEN 'gnss' ELSE 'imu' END AS type, count(*) AS n, round(sum(v), 4) + 0.0 AS total, count(*) FILTER (k % 2 = 0) AS with_mag FROM sig WHERE event_id % 17 <> 0 GROUP BY 1")
def src_jsonl_session(spark, d):
    """Lines of a log file back to typed rows; truncated lines are dropped by the reader."""
    line = F.to_json(F.struct(F.col("kind").alias("type"), "speed", "mx"))
    path = scratch(spark, "log")
    _lines(spark, d).select(F.when(F.col("event_id") % 17 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return recordings.log_rows(spark, path).groupBy("type").agg(F.count("*").alias("n"), r6(F.sum("speed"), 4).alias("total"), F.count("mx").alias("with_mag"))


@query("src_jsonl_fast_keyscan", SIG + " SELECT event_id, k::DOUBLE AS k FROM sig WHERE k >= 50")
def src_jsonl_fast_keyscan(spark, d):
    return table(spark, d, "events").select("event_id", S.json_number(F.col("props"), "k").alias("k")).where("k >= 50")


@query("src_json_manifest", "SELECT 'S' || c_custkey AS session_id, c_mktsegment AS driver_code, CASE WHEN c_custkey % 3 = 0 THEN 'val' ELSE 'train' END AS split, c_acctbal > 0 AS synced FROM customer")
def src_json_manifest(spark, d):
    """Manifests, one JSON object with a map of sessions for each nation, as session rows."""
    path = scratch(spark, "manifest")
    c = table(spark, d, "customer")
    entry = F.struct(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("key"), F.struct(F.col("c_mktsegment").alias("driver_code"), F.when(F.col("c_custkey") % 3 == 0, "val").otherwise("train").alias("split"), (F.col("c_acctbal") > 0).alias("synced")).alias("value"))
    maps = c.groupBy("c_nationkey").agg(F.to_json(F.struct(F.lit(0).alias("seed"), F.map_from_entries(F.collect_list(entry)).alias("sessions"))).alias("text"))
    sinks.write_files(maps.select(F.format_string("m%03d.json", F.col("c_nationkey")).alias("name"), "text"), path)
    return recordings.read_manifest(spark, path).select("session_id", "driver_code", "split", "synced")


@query("snk_parquet", SIG + " SELECT CASE WHEN k % 10 = 0 THEN 'gnss' ELSE 'imu' END AS stream, count(*) AS n, round(sum(v), 4) + 0.0 AS total FROM sig WHERE event_id // 2000 = 0 GROUP BY 1")
def snk_parquet(spark, d):
    """Streams of drives as Parquet by session; a reader of one session opens its folders alone."""
    path = scratch(spark, "streams")
    drive = F.expr("event_id div 2000").alias("session_id")
    sinks.write_streams(_lines(spark, d).select(drive, F.col("kind").alias("stream"), "t", "speed"), path)
    return spark.read.parquet(path).where("session_id = 0").groupBy("stream").agg(F.count("*").alias("n"), r6(F.sum("speed"), 4).alias("total"))


@query("snk_csv", SIG + " SELECT session_id, count(*) AS n, count(*) FILTER (k % 10 = 0) AS fixes, round(sum(v), 3) + 0.0 AS total FROM (SELECT event_id // 2000 AS session_id, k, v FROM sig) GROUP BY 1")
def snk_csv(spark, d):
    """Session CSV of both streams of each drive, read back."""
    path = scratch(spark, "csv")
    x = _lines(spark, d).withColumn("session_id", F.expr("event_id div 2000"))
    sinks.write_session_csv(x.where("kind = 'imu'").select("session_id", "t", F.col("speed").alias("ax")), x.where("kind = 'gnss'").select("session_id", "t", "speed"), path)
    back = spark.read.option("header", True).csv(path)
    value = F.coalesce(F.col("ax").cast("double"), F.col("speed").cast("double"))
    return back.groupBy(F.col("session_id").cast("long").alias("session_id")).agg(F.count("*").alias("n"), F.count_if(F.col("stream") == "gnss").alias("fixes"), r6(F.sum(value), 3).alias("total"))


@query("snk_json", "SELECT n_regionkey AS region, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def snk_json(spark, d):
    """Report documents as JSON lines, read back."""
    path = scratch(spark, "report")
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))
    n.write.json(path)
    return spark.read.schema(n.schema).json(path)


@query("snk_regression_log", "SELECT 'abc' AS \"commit\", r_name AS route, r_regionkey * 1.5::DOUBLE AS drift_pct FROM region")
def snk_regression_log(spark, d):
    """Result rows appended to a log with time, commit and route, one append a region."""
    path = scratch(spark, "regression")
    rows = table(spark, d, "region").select("r_name", (F.col("r_regionkey") * F.lit(1.5)).alias("drift_pct"))
    sinks.append_regression(rows.select("drift_pct", F.col("r_name").alias("route")), path, "abc")
    back = spark.read.option("header", True).csv(path).where("ts IS NOT NULL")
    return back.select("commit", "route", F.col("drift_pct").cast("double").alias("drift_pct"))


@query("snk_npy", "SELECT count(*) AS n, CAST(sum(len(embedding)) AS BIGINT) AS total FROM embeddings")
def snk_npy(spark, d):
    path = scratch(spark, "npy")
    sinks.write_npy(table(spark, d, "embeddings"), "embedding", "vec_id", path)
    return recordings.read_npy(spark, path).agg(F.count("*").alias("n"), F.sum(F.size("window")).alias("total"))


@query("src_osm_saved", with_("road") + " SELECT 7 + i // 50 AS way, 'primary' AS highway, i AS u, i + 1 AS v, round(n, 6) + 0.0 AS lat FROM road WHERE i % 50 < 49 AND i < 199")
def src_osm_saved(spark, d):
    """Edges of saved answers of a map server, one file for each way of 50 nodes, with where they begin."""
    path = scratch(spark, "osm")
    r = road(spark, d).withColumn("way", F.expr("7 + i div 50"))
    node = F.struct(F.lit("node").alias("type"), F.col("i").alias("id"), F.col("n").alias("lat"), F.col("e").alias("lon"))
    way = F.struct(F.lit("way").alias("type"), F.col("way").alias("id"), F.array_sort(F.collect_list("i")).alias("nodes"), F.struct(F.lit("primary").alias("highway")).alias("tags"))
    each = r.groupBy("way").agg(F.collect_list(F.to_json(node)).alias("nodes"), F.to_json(way).alias("line"))
    text = F.concat(F.lit('{"elements": ['), F.array_join("nodes", ","), F.lit(","), "line", F.lit("]}"))
    sinks.write_files(each.select(F.concat(F.col("way").cast("string"), F.lit(".json")).alias("name"), text.alias("text")), path)
    nodes, edges = recordings.read_overpass(spark, path)
    return edges.join(nodes, edges.u == nodes.id).select("way", "highway", "u", "v", r6(F.col("lat")).alias("lat"))


@query("snk_plot", TRACK_SQL + " SELECT route_id, least(count(*), 1000) AS n, true AS whole FROM tr GROUP BY 1")
def snk_plot(spark, d):
    """A picture of each drive's track, and how many points its line has."""
    path = scratch(spark, "plots")
    sinks.write_svg(tracks(spark, d), "route_id", "seq", "te", "tn", path)
    svg = spark.read.text(path, wholetext=True).withColumn("name", F.col("_metadata.file_name"))
    points = F.split(F.regexp_extract("value", 'points="([^"]*)"', 1), " ")
    return svg.select(F.substring_index("name", ".", 1).cast("long").alias("route_id"), F.size(points).cast("long").alias("n"), F.col("value").endswith("</svg>").alias("whole"))


@query("snk_bounded_queue", SIG.replace("WITH", "WITH RECURSIVE", 1) + f", o AS (SELECT *, row_number() OVER ({_P}) AS i FROM sig), q AS (SELECT session_id, i, t + 100000 AS free, true AS ok FROM o WHERE i = 1 UNION ALL SELECT o.session_id, o.i, CASE WHEN greatest(q.free - o.t, 0) < 200000 THEN greatest(q.free, o.t) + 100000 ELSE q.free END, greatest(q.free - o.t, 0) < 200000 FROM q JOIN o ON o.session_id = q.session_id AND o.i = q.i + 1) SELECT session_id, count(*) FILTER (ok) AS written, count(*) FILTER (NOT ok) AS dropped FROM q GROUP BY 1")
def snk_bounded_queue(spark, d):
    """What a slow writer behind a queue of two keeps and drops."""
    q = sinks.bounded_queue(sig(spark, d), "t", "session_id", ["t", "event_id"], 2, 100_000.0)
    return q.groupBy("session_id").agg(F.count_if("accepted").alias("written"), F.count_if(~F.col("accepted")).alias("dropped"))


@query("snk_fixture", TRACK_SQL + " SELECT route_id, seq, round(pn, 3) + 0.0 AS pn, round(pe, 3) + 0.0 AS pe FROM tr")
def snk_fixture(spark, d):
    """A fixture of dead reckoning for other implementations: written, and its expected positions read back."""
    path = scratch(spark, "fixture")
    rows = tracks(spark, d)
    sinks.write_fixture(rows, "route_id", "seq", ["t", "ax", "ay", "gyro_yaw"], ["pn", "pe"], path, {"position_m": 0.5})
    kind = f"route_id {rows.schema['route_id'].dataType.simpleString()}, cycles array<struct<i: long, expected: struct<pn: double, pe: double>>>"
    c = spark.read.schema(kind).json(path).select("route_id", F.explode("cycles").alias("c"))
    return c.select("route_id", F.col("c.i").alias("seq"), r6(F.col("c.expected.pn"), 3).alias("pn"), r6(F.col("c.expected.pe"), 3).alias("pe"))


@query("snk_catalog_recover", SIG + ", m AS (SELECT session_id, min(t) AS a, max(t) AS b, sum(v) AS v FROM sig GROUP BY 1), mx AS (SELECT max(b) AS now FROM m) SELECT session_id, round(a, 6) + 0.0 AS started, round(v, 4) + 0.0 AS distance_m, session_id % 2 = 1 AS recovered FROM m, mx WHERE session_id % 2 = 0 OR now - b > 20")
def snk_catalog_recover(spark, d):
    raw = sig(spark, d).select("session_id", "t", F.col("v").alias("speed"))
    meta = raw.where("session_id % 2 = 0").groupBy("session_id").agg(F.min("t").alias("started"), F.max("t").alias("ended"), F.sum("speed").alias("distance_m"))
    c = sinks.recover_catalog(raw, meta)
    return c.select("session_id", r6(F.col("started")).alias("started"), r6(F.col("distance_m"), 4).alias("distance_m"), "recovered")


@query("dt_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def dt_iso(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("dt_now_utc", "SELECT r_name, 20 AS n, true AS recent FROM region")
def dt_now_utc(spark, d):
    """The time of the query in UTC as ISO text: its length, and whether it is of now."""
    now = S.now_utc()
    recent = F.abs(F.unix_timestamp(F.to_timestamp(now)) - F.unix_timestamp(F.current_timestamp())) < 5
    return table(spark, d, "region").select("r_name", F.length(now).alias("n"), recent.alias("recent"))


@query("stm_two_rate_merge", SIG + f", g AS (SELECT session_id, t, v FROM sig WHERE k % 3 <> 0), i AS (SELECT session_id, event_id, t, lag(t) OVER ({_P}) AS pt FROM sig WHERE k % 3 = 0), j AS (SELECT i.*, g.t AS gt, g.v AS fix FROM i ASOF LEFT JOIN g ON i.session_id = g.session_id AND i.t >= g.t) SELECT event_id, CASE WHEN gt > pt OR pt IS NULL THEN fix END AS fix FROM j")
def stm_two_rate_merge(spark, d):
    """The last fix since the sample before goes with a sample; a fix is taken once."""
    s = sig(spark, d)
    imu = s.where("k % 3 = 0").withColumn("pt", F.lag("t").over(W()))
    j = J.asof_backward(imu, s.where("k % 3 <> 0"), ["session_id"], "t", ["v"])
    return j.select("event_id", F.when((F.col("r_t") > F.col("pt")) | F.col("pt").isNull(), F.col("r_v")).alias("fix"))


@query("stm_periodic_recompute", SIG + f", o AS (SELECT session_id, row_number() OVER ({_P}) AS i, avg(v) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS m FROM sig) SELECT session_id, i, round(m + 1e-9, 6) + 0.0 AS m FROM o WHERE i % 10 = 0")
def stm_periodic_recompute(spark, d):
    o = sig(spark, d).select("session_id", F.row_number().over(W()).cast("long").alias("i"), F.avg("v").over(R()).alias("m"))
    return o.where("i % 10 = 0").select("session_id", "i", r6(F.col("m") + 1e-9).alias("m"))


@query("stm_latched_failure", SIG + f" SELECT event_id, max(CASE WHEN v > 200 THEN 1 ELSE 0 END) OVER ({_P} ROWS UNBOUNDED PRECEDING) = 1 AS failed FROM sig")
def stm_latched_failure(spark, d):
    return sig(spark, d).select("event_id", (F.max(F.when(F.col("v") > 200, 1).otherwise(0)).over(R()) == 1).alias("failed"))


@query("est_channel_dispatch", SIG + " SELECT event_id, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 4.876 WHEN 2 THEN v / 10 ELSE greatest(0.0, least(40.0, 1.12 * v / 10)) END::DOUBLE AS speed FROM sig")
def est_channel_dispatch(spark, d):
    """No channel, a constant, integrated physics or a model, by configuration; null means that the update is left out."""
    m, v = F.col("k") % 4, F.col("v") / 10
    return sig(spark, d).select("event_id", F.when(m == 1, F.lit(4.876)).when(m == 2, v).when(m == 3, S.clip(F.lit(1.12) * F.col("v") / 10, 0, 40)).alias("speed"))
