"""Queries whose operators are sequential kernels: where SQL can't express them, tests check them against invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import scalar as S
from driftline.operators import estimators as E
from driftline.operators import joins as J
from driftline.operators import ordered as O
from driftline.operators import tensors as T
from driftline.plans.ordered_queries import TRACK_SQL, tracks
from driftline.plans.registry import query
from driftline.plans.relational_queries import _NEAR, _points, _polyline
from driftline.plans.surrogates import sess, sig, table, with_
from driftline.storage import scratch


def fusion_input(spark, d, speed: bool = True):
    """The drives with fixes every second outside [40, 100) and a speed channel every row."""
    t = tracks(spark, d)
    fix = (F.col("seq") % 10 == 0) & ~((F.col("t") >= 40) & (F.col("t") < 100))
    return t.select("route_id", "seq", "t", "gyro_yaw", F.when(fix, F.col("tn")).alias("gnss_n"), F.when(fix, F.col("te")).alias("gnss_e"), F.when(fix, F.col("speed") * F.cos("true_psi")).alias("gnss_vn"), F.when(fix, F.col("speed") * F.sin("true_psi")).alias("gnss_ve"), F.when(fix, F.col("true_psi")).alias("course"), (F.col("speed") if speed else F.lit(None).cast("double")).alias("speed_a"), F.lit(16.7).alias("v0"), F.lit(0.0).alias("psi0"), "tn", "te")


@query("est_ukf_batch")
def est_ukf_batch(spark, d):
    return E.fuse(fusion_input(spark, d).drop("tn", "te"), "route_id")


@query("est_pipeline_batch")
def est_pipeline_batch(spark, d):
    """Raw dead reckoning, fused track and truth side by side."""
    fused = est_ukf_batch(spark, d).select("route_id", "seq", F.col("pn").alias("fused_n"), F.col("pe").alias("fused_e"))
    return tracks(spark, d).select("route_id", "seq", "t", "pn", "pe", "tn", "te").join(fused, ["route_id", "seq"])


@query("est_coast_baseline")
def est_coast_baseline(spark, d):
    """The filter without any speed evidence during the outage."""
    return E.fuse(fusion_input(spark, d, speed=False).drop("tn", "te"), "route_id")


@query("est_corridor_kf")
def est_corridor_kf(spark, d):
    w = O.over("session_id", ["t", "event_id"])
    s = sig(spark, d).select("session_id", F.row_number().over(w).cast("long").alias("seq"), F.lit(0.1).alias("dt"), F.when(F.col("k") % 3 != 0, F.col("v") / 10).alias("speed"), F.when(F.col("k") % 20 == 0, F.row_number().over(w) * 0.5).alias("anchor_s"), (F.col("k") / F.lit(100.0)).alias("confidence"))
    return E.corridor(s, "session_id")


@query("geo_viterbi")
def geo_viterbi(spark, d):
    """Every point; one without a segment within 25 m has its nearest as only candidate."""
    pts = _points(spark, d).select((F.expr("event_id div 2000")).alias("drive"), (F.col("event_id") % 2000).alias("seq"), "n", (F.col("e") / 4).alias("e"))
    mid = _polyline(spark, d).select("seg_id", ((F.col("p1n") + F.col("p2n")) / 2).alias("mid_n"), ((F.col("p1e") + F.col("p2e")) / 2).alias("mid_e"))
    near = J.radius_join(pts, _polyline(spark, d), 25.0)
    m = near.unionByName(J.nearest_beyond(pts, _polyline(spark, d), 25.0, ["drive", "seq"])).join(mid, "seg_id")
    return E.map_match(m.select("drive", "seq", "n", "e", "seg_id", "dist", "mid_n", "mid_e"), "drive")


_SCORE = _NEAR.replace("WITH", "WITH RECURSIVE", 1) + """, ps AS (SELECT event_id, event_id // 500 AS drive, event_id % 500 AS seq, e / 50 AS psi FROM pt),
hd AS (SELECT ps.drive, ps.seq, ds.seg_id, ds.dist, atan2(ds.p2e - ds.p1e, ds.p2n - ds.p1n) - ps.psi + pi() AS d FROM ps JOIN ds USING (event_id) WHERE dist < 30),
cd AS (SELECT drive, seq, seg_id, dist + 20 * least(abs(d - 2 * pi() * floor(d / (2 * pi())) - pi()), abs(d + pi() - 2 * pi() * floor((d + pi()) / (2 * pi())) - pi())) AS score FROM hd),
pv AS (SELECT drive, seq + 1 AS seq, seg_id AS prev FROM cd UNION ALL SELECT drive, seq, -1 FROM ps),
sc AS (SELECT c.drive, c.seq, prev, c.seg_id, c.score + CASE WHEN prev < 0 OR abs(c.seg_id - prev) <= 1 THEN 0 ELSE 10 END AS score FROM cd c JOIN pv ON c.drive = pv.drive AND c.seq = pv.seq),
tb AS MATERIALIZED (SELECT drive, seq, prev, min_by(seg_id, (round(score, 9), seg_id)) AS seg_id, min_by(score, (round(score, 9), seg_id)) AS score FROM sc GROUP BY ALL),
rc AS (SELECT p.event_id, p.drive, p.seq, coalesce(t.seg_id, -1) AS seg, t.score, false AS continuous FROM ps p LEFT JOIN tb t ON t.drive = p.drive AND t.seq = p.seq AND t.prev = -1 WHERE p.seq = 0
 UNION ALL SELECT p.event_id, p.drive, p.seq, coalesce(t.seg_id, -1), t.score, t.seg_id IS NOT NULL AND rc.seg >= 0 AND abs(t.seg_id - rc.seg) <= 1
 FROM rc JOIN ps p ON p.drive = rc.drive AND p.seq = rc.seq + 1 LEFT JOIN tb t ON t.drive = p.drive AND t.seq = p.seq AND t.prev = rc.seg)
SELECT event_id, nullif(seg, -1) AS seg_id, round(score, 6) + 0.0 AS score, continuous FROM rc"""


@query("geo_score_match", _SCORE)
def geo_score_match(spark, d):
    """Distance, heading either way and continuity with the match before, step after step; no match resets continuity."""
    p = _points(spark, d).select("event_id", F.expr("event_id div 500").alias("drive"), (F.col("event_id") % 500).alias("seq"), "n", "e", (F.col("e") / 50).alias("psi"))
    h = _polyline(spark, d).select("seg_id", "heading")
    near = J.radius_join(p, _polyline(spark, d), 30.0).join(h, "seg_id")
    turn = F.least(F.abs(S.wrap_pi(F.col("heading") - F.col("psi"))), F.abs(S.wrap_pi(F.col("heading") + F.pi() - F.col("psi"))))
    c = p.select("event_id", "drive", "seq").join(near.select("event_id", "seg_id", F.col("seg_id").alias("u"), (F.col("seg_id") + 1).alias("v"), (F.col("dist") + 20 * turn).alias("score")), "event_id", "left")
    m = E.score_match(c.drop("event_id"), "drive")
    return m.select((F.col("drive") * 500 + F.col("seq")).alias("event_id"), "seg_id", S.r6(F.col("score")).alias("score"), "continuous")


@query("geo_polyline_chain")
def geo_polyline_chain(spark, d):
    return E.chain(_polyline(spark, d).select("road", "seg_id", "p1n", "p1e", "p2n", "p2e"), "road")


@query("win_spectral_regime")
def win_spectral_regime(spark, d):
    """Spectra of the samples of each speed regime, for drives of 2000 samples."""
    drives = sig(spark, d).select(F.expr("event_id div 2000").alias("drive"), "event_id", "v", (F.col("k") / F.lit(4.0)).alias("speed"))
    return E.welch_by_regime(drives, "drive", "event_id", "v", "speed")


@query("win_spectral_welch")
def win_spectral_welch(spark, d):
    return E.welch(sig(spark, d), "session_id", "t", "v", 10.0)


@query("udtf_schedule")
def udtf_schedule(spark, d):
    return E.schedule(sess(spark, d).select("session_id", (F.lit(300.0) + F.col("c_custkey") % 600).alias("duration_s")), "session_id", "duration_s")


@query("rnd_rotation_aug")
def rnd_rotation_aug(spark, d):
    return T.rotation_augmented(sig(spark, d).select("event_id", F.col("v").alias("x"), F.col("k").cast("double").alias("y")), ["event_id"], "x", "y")


@query("ml_window_inference", "SELECT vec_id, round(list_sum([embedding[i]::DOUBLE * (-1 + (i - 1) * 2 / 63.0::DOUBLE) for i in generate_series(1, 64)]), 4) + 0.0 AS prediction FROM embeddings")
def ml_window_inference(spark, d):
    import numpy as np

    x = E.infer(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", weights=np.linspace(-1, 1, 64))
    return x.select("vec_id", S.r6(F.col("prediction"), 4).alias("prediction"))


@query("ml_onnx_network", "SELECT vec_id, round(0.25 + list_sum([(h - 4) / 4.0::DOUBLE * greatest(0.0, 0.1 * h + list_sum([embedding[i]::DOUBLE * sin(i * (h + 1.0)) for i in generate_series(1, 64)])) for h in generate_series(0, 7)]), 2) + 0.0 AS prediction FROM embeddings")
def ml_onnx_network(spark, d):
    """A network with a hidden layer, as the bytes of an ONNX file, over windows."""
    import numpy as np

    from driftline.operators.onnx_bytes import dense_network

    i, h = np.arange(1, 65)[:, None], np.arange(8)
    model = dense_network([(np.sin(i * (h + 1.0)), 0.1 * h), (((h - 4) / 4)[:, None], np.array([0.25]))])
    x = E.infer(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", model)
    return x.select("vec_id", S.r6(F.col("prediction"), 2).alias("prediction"))


@query("ml_export_quant")
def ml_export_quant(spark, d):
    """The network of ml_onnx_network as the smaller file that its exporter chose, over the same windows."""
    import numpy as np

    from driftline.operators.onnx_bytes import export

    i, h = np.arange(1, 65)[:, None], np.arange(8)
    layers = [(np.sin(i * (h + 1.0)), 0.1 * h), (((h - 4) / 4)[:, None], np.array([0.25]))]
    kind, model = export(layers, np.random.default_rng(0).normal(size=(256, 64)) / 8)
    x = E.infer(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", model)
    return x.select("vec_id", F.lit(kind).alias("weights"), S.r6(F.col("prediction"), 4).alias("prediction"))


@query("ml_delta_accumulate", with_("sig") + " SELECT event_id, greatest(0.0, round(sum((v - 50) / 100) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 6)) + 0.0 AS speed FROM sig")
def ml_delta_accumulate(spark, d):
    """Running sum of predicted speed changes, at least zero."""
    s = sig(spark, d).withColumn("dv", (F.col("v") - 50) / 100)
    return s.select("event_id", F.greatest(F.lit(0.0), S.r6(F.sum("dv").over(O.running("session_id", ["t", "event_id"])))).alias("speed"))


def stream_rows(spark, d):
    """Samples at 10 Hz and fixes at 1 Hz of the drives, as rows of the live path."""
    t = tracks(spark, d)
    imu = t.select(F.col("route_id").cast("string").alias("session_id"), F.lit("imu").alias("kind"), "t", F.col("gyro_yaw").alias("gyro"), (F.col("t") < 2).alias("quiet"), F.lit(None).cast("double").alias("gnss_n"), F.lit(None).cast("double").alias("gnss_e"), F.lit(None).cast("double").alias("speed"), F.lit(None).cast("double").alias("course"))
    fix = t.where("seq % 10 = 0 AND (t < 40 OR t >= 100)").select(F.col("route_id").cast("string").alias("session_id"), F.lit("gnss").alias("kind"), "t", F.lit(None).cast("double").alias("gyro"), F.lit(False).alias("quiet"), F.col("tn").alias("gnss_n"), F.col("te").alias("gnss_e"), "speed", F.col("true_psi").alias("course"))
    return imu.unionByName(fix)


def _arriving(spark, rows, name: str):
    """Rows as a stream: files of a folder, in the order in which they are written."""
    path = scratch(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("stm_fused_stream")
def stm_fused_stream(spark, d):
    from driftline.streaming.fusion import fuse_batch

    return fuse_batch(stream_rows(spark, d))


@query("stm_live_path")
def stm_live_path(spark, d):
    """The live path as a streaming query with state: the rows of stm_fused_stream."""
    from driftline.streaming.fusion import fuse_stream, run_available

    return run_available(fuse_stream(_arriving(spark, stream_rows(spark, d), "live")), scratch(spark, "fused"))


_LATE = "WITH e AS (SELECT user_id, event_type, ts, max(ts) OVER () - INTERVAL 10 MINUTE AS mark FROM events)"


@query("stm_stream_rate", _LATE + ", w AS (SELECT event_type, date_trunc('second', ts) AS s, mark, count(*) AS n FROM e GROUP BY ALL) SELECT event_type, CAST(epoch(s) AS BIGINT) AS start, n FROM w WHERE s + INTERVAL 1 SECOND <= mark")
def stm_stream_rate(spark, d):
    """Events a second through a watermark: seconds that it has passed are final and come out once."""
    from driftline.streaming.fusion import rate_counter, run_available

    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = run_available(rate_counter(_arriving(spark, e, "events"), "ts", "event_type"), scratch(spark, "rate"))
    return out.select("event_type", F.unix_seconds("start").alias("start"), "n")


@query("stm_stream_session", _LATE + ", g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS began, count(*) AS n FROM s GROUP BY user_id, sid, mark HAVING max(ts) + INTERVAL 12 HOUR <= mark")
def stm_stream_session(spark, d):
    """Session windows that the watermark has closed."""
    from driftline.streaming.fusion import run_available, sessions

    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = run_available(sessions(_arriving(spark, e, "events"), "ts", "user_id"), scratch(spark, "sessions"))
    return out.select("user_id", F.unix_micros("start").alias("began"), "n")


@query("src_online_imu", with_("route") + " SELECT route_id, count(*) AS n, round(sum(gyro_yaw), 6) + 0.0 AS turn FROM route GROUP BY 1")
def src_online_imu(spark, d):
    """Inertial samples as they arrive."""
    from driftline.streaming.fusion import run_available

    got = run_available(_arriving(spark, stream_rows(spark, d), "online").where("kind = 'imu'"), scratch(spark, "imu"))
    return got.groupBy(F.col("session_id").cast("long").alias("route_id")).agg(F.count("*").alias("n"), S.r6(F.sum("gyro")).alias("turn"))


@query("src_online_gnss", TRACK_SQL + " SELECT route_id, count(*) AS n, round(sum(tn), 2) + 0.0 AS north FROM tr WHERE seq % 10 = 0 AND (t < 40 OR t >= 100) GROUP BY 1")
def src_online_gnss(spark, d):
    """Fixes as they arrive."""
    from driftline.streaming.fusion import run_available

    got = run_available(_arriving(spark, stream_rows(spark, d), "online").where("kind = 'gnss'"), scratch(spark, "gnss"))
    return got.groupBy(F.col("session_id").cast("long").alias("route_id")).agg(F.count("*").alias("n"), S.r6(F.sum("gnss_n"), 2).alias("north"))
