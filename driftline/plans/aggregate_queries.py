"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import scalar as S
from driftline.operators import aggregates as A
from driftline.operators import ordered as O
from driftline.plans.ordered_queries import TRACK_SQL, W, _P, tracks
from driftline.plans.registry import query
from driftline.plans.surrogates import clock, geo, pair, sig, table, with_

r6 = S.r6
SIG, GEO, PAIR, CLOCK = (with_(x) for x in ("sig", "geo", "pair", "clock"))


def _rounded(df, keys, places=4):
    return df.select(*keys, *(r6(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys))


_M = "count(*) AS n, round(sqrt(avg((yhat - y) * (yhat - y))), 4) + 0.0 AS rmse, round(avg(abs(yhat - y)), 4) + 0.0 AS mae, round(median(abs(yhat - y)), 4) + 0.0 AS median_ae, round(quantile_cont(abs(yhat - y), 0.9), 4) + 0.0 AS p90, round(quantile_cont(abs(yhat - y), 0.95), 4) + 0.0 AS p95, round(max(abs(yhat - y)), 4) + 0.0 AS max_ae, round(avg(yhat - y), 4) + 0.0 AS bias, round(stddev_pop(yhat - y), 4) + 0.0 AS err_std, round(1 - sum((yhat - y) * (yhat - y)) / nullif(var_pop(y) * count(y), 0), 4) + 0.0 AS r2"


def _metrics():
    return A.regression_metrics(F.col("y"), F.col("yhat"))


@query("agg_regression_metrics", PAIR + f" SELECT {_M} FROM pair")
def agg_regression_metrics(spark, d):
    return _rounded(pair(spark, d).agg(*_metrics()), [])


@query("agg_by_session", PAIR + f" SELECT grp, {_M} FROM pair GROUP BY grp")
def agg_by_session(spark, d):
    return _rounded(pair(spark, d).groupBy("grp").agg(*_metrics()), ["grp"])


@query("agg_by_speed_range", PAIR + f" SELECT CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 15 THEN 1 WHEN l_quantity < 30 THEN 2 ELSE 3 END AS band, {_M} FROM pair GROUP BY 1")
def agg_by_speed_range(spark, d):
    b = A.buckets(F.col("l_quantity"), [0, 5, 15, 30, 999])
    return _rounded(pair(spark, d).groupBy(b.alias("band")).agg(*_metrics()), ["band"])


@query("agg_binned_stats", PAIR + " SELECT CASE WHEN y < 1 THEN 0 WHEN y < 2 THEN 1 WHEN y < 3 THEN 2 WHEN y < 4 THEN 3 WHEN y < 5 THEN 4 WHEN y < 10 THEN 5 WHEN y < 20 THEN 6 ELSE 7 END AS bin, count(*) AS n, round(avg(yhat), 4) + 0.0 AS mean, round(stddev_samp(yhat), 4) + 0.0 AS std FROM (SELECT round(y, 6) AS y, yhat FROM pair) GROUP BY 1")
def agg_binned_stats(spark, d):
    b = A.buckets(F.round("y", 6), [0, 1, 2, 3, 4, 5, 10, 20, 100])
    return pair(spark, d).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("yhat"), 4).alias("mean"), r6(F.stddev_samp("yhat"), 4).alias("std"))


@query("agg_conditional_pct", SIG + " SELECT event_type, round(avg(CASE WHEN v > 50 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) + 0.0 AS pct, count(*) FILTER (v > 50) AS n FROM sig WHERE k < 50 GROUP BY event_type")
def agg_conditional_pct(spark, d):
    return sig(spark, d).where("k < 50").groupBy("event_type").agg(r6(F.avg(F.when(F.col("v") > 50, 1.0).otherwise(0.0)) * 100).alias("pct"), F.count_if(F.col("v") > 50).alias("n"))


@query("agg_sensor_agreement", PAIR + " SELECT CASE WHEN l_quantity < 15 THEN 'low' WHEN l_quantity < 35 THEN 'mid' ELSE 'high' END AS regime, count(*) AS n, round(avg(abs(y - yhat)), 4) + 0.0 AS mae_obd, round(avg(abs(y - l_quantity / 10)), 4) + 0.0 AS mae_wheel FROM pair GROUP BY 1")
def agg_sensor_agreement(spark, d):
    q = F.col("l_quantity")
    g = pair(spark, d).groupBy(F.when(q < 15, "low").when(q < 35, "mid").otherwise("high").alias("regime"))
    return g.agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("yhat"))), 4).alias("mae_obd"), r6(F.avg(F.abs(F.col("y") - q / 10)), 4).alias("mae_wheel"))


@query("agg_sampling_stats", CLOCK + ", x AS (SELECT *, raw_ms - lag(raw_ms) OVER (PARTITION BY session_id ORDER BY seq) AS dd FROM clock) SELECT session_id, round(median(1000 / dd), 6) + 0.0 AS median_hz, round(avg(1000 / dd), 6) + 0.0 AS mean_hz, round(stddev_pop(dd), 6) + 0.0 AS dt_std, count(*) FILTER (dd > 200) AS gaps, count(*) AS n FROM x WHERE dd > 0 GROUP BY session_id")
def agg_sampling_stats(spark, d):
    c = clock(spark, d).withColumn("dd", O.diff(F.col("raw_ms"), O.over("session_id", "seq"))).where("dd > 0")
    hz = F.lit(1000.0) / F.col("dd")
    return c.groupBy("session_id").agg(r6(F.median(hz)).alias("median_hz"), r6(F.avg(hz)).alias("mean_hz"), r6(F.stddev_pop("dd")).alias("dt_std"), F.count_if(F.col("dd") > 200).alias("gaps"), F.count("*").alias("n"))


@query("agg_path_length", GEO + f", p AS (SELECT session_id, radians(lat - 52.4) * 6371000.0 AS n, radians(lon + 1.5) * 6371000.0 * cos(radians(52.4)) AS e, t, event_id FROM geo), s AS (SELECT session_id, n - lag(n) OVER ({_P}) AS dn, e - lag(e) OVER ({_P}) AS de FROM p) SELECT session_id, round(sum(sqrt(dn * dn + de * de)), 3) + 0.0 AS len FROM s GROUP BY session_id")
def agg_path_length(spark, d):
    n, e = S.north_east(F.col("lat"), F.col("lon"), 52.4, -1.5)
    p = geo(spark, d).withColumns({"n": n, "e": e})
    step = F.hypot(O.diff(F.col("n"), W()), O.diff(F.col("e"), W()))
    return p.withColumn("st", step).groupBy("session_id").agg(r6(F.sum("st"), 3).alias("len"))


@query("agg_speed_distance", SIG + f", x AS (SELECT *, lag(v) OVER ({_P}) AS pv, lag(t) OVER ({_P}) AS pt FROM sig) SELECT session_id, round(sum((v + pv) / 2 * (t - pt)), 2) + 0.0 AS trapezoid, round(sum(v * (t - pt)), 2) + 0.0 AS rectangle FROM x GROUP BY session_id")
def agg_speed_distance(spark, d):
    dt = O.diff(F.col("t"), W())
    x = sig(spark, d).withColumns({"tr": (F.col("v") + F.lag("v").over(W())) / 2 * dt, "re": F.col("v") * dt})
    return x.groupBy("session_id").agg(r6(F.sum("tr"), 2).alias("trapezoid"), r6(F.sum("re"), 2).alias("rectangle"))


_ERR = ", er AS (SELECT *, sqrt((pn - tn) * (pn - tn) + (pe - te) * (pe - te)) AS err, sqrt(tdn * tdn + tde * tde) AS ds FROM tr)"


def _errors(spark, d):
    w = O.over("route_id", "seq")
    return tracks(spark, d).withColumn("err", F.hypot(F.col("pn") - F.col("tn"), F.col("pe") - F.col("te"))).withColumn("ds", F.coalesce(F.hypot(O.diff(F.col("tn"), w), O.diff(F.col("te"), w)), F.lit(0.0)))


@query("agg_drift", TRACK_SQL + _ERR + " SELECT route_id, round(max_by(err, seq), 3) + 0.0 AS end_error, round(max(err), 3) + 0.0 AS max_error, round(sqrt(avg(err * err)), 3) + 0.0 AS rms_error, round(sum(ds), 3) + 0.0 AS distance, round(max_by(err, seq) / nullif(sum(ds), 0) * 100, 3) + 0.0 AS drift_pct FROM er WHERE t >= 40 AND t < 100 GROUP BY route_id")
def agg_drift(spark, d):
    """Drift of dead reckoning over the blackout [40, 100) of each drive."""
    e = _errors(spark, d).where("t >= 40 AND t < 100")
    return _rounded(e.groupBy("route_id").agg(*A.drift(F.col("err"), F.col("seq"), F.col("ds"))), ["route_id"], 3)


@query("agg_trajectory_rmse", TRACK_SQL + " SELECT route_id, round(sqrt(avg((pn - tn) * (pn - tn) + (pe - te) * (pe - te))), 3) + 0.0 AS rmse, round(sqrt(avg(power((pn - tn) * cos(psi) + (pe - te) * sin(psi), 2))), 3) + 0.0 AS along, round(sqrt(avg(power(-(pn - tn) * sin(psi) + (pe - te) * cos(psi), 2))), 3) + 0.0 AS cross_track FROM tr GROUP BY route_id")
def agg_trajectory_rmse(spark, d):
    dn, de, psi = F.col("pn") - F.col("tn"), F.col("pe") - F.col("te"), F.col("true_psi")
    rms = lambda x: r6(F.sqrt(F.avg(x * x)), 3)
    return tracks(spark, d).groupBy("route_id").agg(r6(F.sqrt(F.avg(dn * dn + de * de)), 3).alias("rmse"), rms(dn * F.cos(psi) + de * F.sin(psi)).alias("along"), rms(-dn * F.sin(psi) + de * F.cos(psi)).alias("cross_track"))


_SC = TRACK_SQL + _ERR + ", wn AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS wid), sc AS (SELECT route_id, wid, max_by(err, seq) - min_by(err, seq) AS end_error, sum(ds) AS distance, avg(abs(sqrt(vn * vn + ve * ve) - speed)) AS speed_mae, avg(sqrt(vn * vn + ve * ve) - speed) AS speed_bias FROM er JOIN wn ON t >= wid * 10 AND t < wid * 10 + 30 GROUP BY route_id, wid)"


def _scores(spark, d):
    e = _errors(spark, d).where("t < 120").withColumn("wid", F.explode(F.expr("sequence(greatest(0, cast(floor((t - 30) / 10) as int) + 1), least(9, cast(floor(t / 10) as int)))")))
    e = e.where("t >= wid * 10 AND t < wid * 10 + 30")
    v = F.hypot("vn", "ve")
    return e.groupBy("route_id", "wid").agg((F.max_by("err", "seq") - F.min_by("err", "seq")).alias("end_error"), F.sum("ds").alias("distance"), F.avg(F.abs(v - F.col("speed"))).alias("speed_mae"), F.avg(v - F.col("speed")).alias("speed_bias"))


@query("agg_scorecard", _SC + " SELECT route_id, wid, round(end_error, 3) + 0.0 AS end_error, round(distance, 3) + 0.0 AS distance, round(end_error / distance * 100, 3) + 0.0 AS drift_pct, round(speed_mae, 3) + 0.0 AS speed_mae, round(speed_bias, 3) + 0.0 AS speed_bias FROM sc")
def agg_scorecard(spark, d):
    """Drift, distance and speed errors for overlapping blackout windows: samples go to the windows they lie in."""
    s = _scores(spark, d).withColumn("drift_pct", F.col("end_error") / F.col("distance") * 100)
    return _rounded(s, ["route_id", "wid"], 3)


@query("agg_multiwindow_summary", _SC + ", dp AS (SELECT route_id, end_error / distance * 100 AS p FROM sc) SELECT route_id, count(*) AS n, round(avg(p), 3) + 0.0 AS mean, round(median(p), 3) + 0.0 AS median, round(min(p), 3) + 0.0 AS least, round(max(p), 3) + 0.0 AS most, round(avg(CASE WHEN p < 5 THEN 100.0::DOUBLE ELSE 0 END), 3) + 0.0 AS under5 FROM dp GROUP BY route_id")
def agg_multiwindow_summary(spark, d):
    p = F.col("end_error") / F.col("distance") * 100
    s = _scores(spark, d).withColumn("p", p)
    return s.groupBy("route_id").agg(F.count("*").alias("n"), r6(F.avg("p"), 3).alias("mean"), r6(F.median("p"), 3).alias("median"), r6(F.min("p"), 3).alias("least"), r6(F.max("p"), 3).alias("most"), r6(F.avg(F.when(F.col("p") < 5, 100.0).otherwise(0.0)), 3).alias("under5"))


@query("agg_channel_norm", "WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS ch FROM embeddings WHERE vec_id % 10 < 7) SELECT ch::BIGINT AS ch, round(avg(x), 6) + 0.0 AS mean, round(greatest(stddev_pop(x), 1e-6), 6) + 0.0 AS std FROM c GROUP BY ch")
def agg_channel_norm(spark, d):
    """Statistics of each channel over the training split alone."""
    c = table(spark, d, "embeddings").where("vec_id % 10 < 7").select(F.posexplode("embedding").alias("ch", "x")).select(F.col("ch").cast("long").alias("ch"), F.col("x").cast("double"))
    return _rounded(A.channel_stats(c, "ch", "x"), ["ch"], 6)


@query("agg_corr", PAIR + " SELECT grp, round(corr(y, l_quantity), 6) + 0.0 AS r, round(corr(l_extendedprice, l_quantity), 6) + 0.0 AS r2 FROM pair GROUP BY grp")
def agg_corr(spark, d):
    return pair(spark, d).groupBy("grp").agg(r6(F.corr("y", "l_quantity")).alias("r"), r6(F.corr("l_extendedprice", "l_quantity")).alias("r2"))


@query("agg_linreg_1d", PAIR + " SELECT grp, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) + 0.0 AS intercept, round(covar_samp(l_extendedprice, l_quantity) / var_pop(l_quantity), 4) + 0.0 AS mixed FROM pair GROUP BY grp")
def agg_linreg_1d(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return pair(spark, d).groupBy("grp").agg(r6(F.regr_slope(y, x), 4).alias("slope"), r6(F.regr_intercept(y, x), 3).alias("intercept"), r6(F.covar_samp(y, x) / F.var_pop(x), 4).alias("mixed"))


@query("agg_affine_calib", PAIR + ", f AS (SELECT grp, greatest(0.5, least(2.0, regr_slope(l_extendedprice / 1000, l_quantity))) AS a, regr_slope(l_extendedprice / 1000, l_quantity) AS raw, avg(l_extendedprice / 1000) AS my, avg(l_quantity) AS mx FROM pair GROUP BY grp) SELECT grp, round(a, 4) + 0.0 AS a, round(my - a * mx, 4) + 0.0 AS b, round(my - raw * mx, 4) + 0.0 AS b_raw FROM f")
def agg_affine_calib(spark, d):
    y, x = F.col("l_extendedprice") / 1000, F.col("l_quantity")
    a, b = A.affine_fit(y, x, 0.5, 2.0)
    _, raw = A.affine_fit(y, x, 0.5, 2.0, recompute=False)
    return pair(spark, d).groupBy("grp").agg(r6(a, 4).alias("a"), r6(b, 4).alias("b"), r6(raw, 4).alias("b_raw"))


@query("agg_joint_axis_fit", PAIR + ", c AS (SELECT grp, var_pop(y) AS cxx, var_pop(yhat) AS cyy, covar_pop(y, yhat) AS cxy, covar_pop(y, l_quantity + y) AS cxz, covar_pop(yhat, l_quantity + y) AS cyz FROM pair GROUP BY grp), ab AS (SELECT grp, (cyy * cxz - cxy * cyz) / (cxx * cyy - cxy * cxy) AS a, (cxx * cyz - cxy * cxz) / (cxx * cyy - cxy * cxy) AS b FROM c) SELECT grp, round(a / sqrt(a * a + b * b), 5) + 0.0 AS ux, round(b / sqrt(a * a + b * b), 5) + 0.0 AS uy FROM ab")
def agg_joint_axis_fit(spark, d):
    m = pair(spark, d).groupBy("grp").agg(*A.moments(F.col("y"), F.col("yhat"), F.col("l_quantity") + F.col("y")))
    ux, uy = A.axis_from_moments()
    return m.select("grp", r6(ux, 5).alias("ux"), r6(uy, 5).alias("uy"))


@query("agg_pca2", PAIR + " SELECT grp, round(atan2(2 * covar_pop(y, l_quantity), var_pop(y) - var_pop(l_quantity)) / 2, 5) + 0.0 AS angle FROM pair GROUP BY grp")
def agg_pca2(spark, d):
    return pair(spark, d).groupBy("grp").agg(r6(A.principal_axis(F.col("y"), F.col("l_quantity")), 5).alias("angle"))


@query("agg_gravity", SIG + " SELECT session_id, round(avg(v / 100), 6) + 0.0 AS gx, round(avg(k / 100.0), 6) + 0.0 AS gy, round(avg(9.0::DOUBLE), 6) + 0.0 AS gz, round(sqrt(power(avg(v / 100), 2) + power(avg(k / 100.0), 2) + 81), 6) + 0.0 AS g, true AS usable FROM sig GROUP BY session_id")
def agg_gravity(spark, d):
    g = sig(spark, d).groupBy("session_id").agg(*A.gravity(F.col("v") / 100, F.col("k") / F.lit(100.0), F.lit(9.0)))
    return _rounded(g, ["session_id"], 6)


@query("agg_window_end_value", SIG + " SELECT session_id, CAST(floor(t / 86400) AS BIGINT) AS wid, max_by(v, (t, event_id)) AS last FROM sig GROUP BY ALL")
def agg_window_end_value(spark, d):
    return sig(spark, d).groupBy("session_id", F.floor(F.col("t") / 86400).alias("wid")).agg(F.max_by("v", F.struct("t", "event_id")).alias("last"))


@query("agg_domain_shift", SIG + " SELECT event_type, round(avg(v), 5) + 0.0 AS mean_v, max(v) AS max_v, round(stddev_samp(v), 5) + 0.0 AS std_v, round(avg(k), 5) + 0.0 AS mean_k FROM sig GROUP BY event_type")
def agg_domain_shift(spark, d):
    return sig(spark, d).groupBy("event_type").agg(r6(F.avg("v"), 5).alias("mean_v"), F.max("v").alias("max_v"), r6(F.stddev_samp("v"), 5).alias("std_v"), r6(F.avg("k"), 5).alias("mean_k"))


@query("agg_heteroscedastic_loss", PAIR + ", x AS (SELECT grp, y, yhat - y AS e, l_quantity / 50 - 0.5 AS lv FROM pair), h AS (SELECT *, CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END AS hb, CASE WHEN y < 2 THEN 2.0 WHEN y < 6 THEN 1.0 ELSE 0.5 END::DOUBLE AS w FROM (SELECT * REPLACE (round(y, 6) AS y, round(e, 6) AS e) FROM x)) SELECT grp, round(avg(exp(-lv) * hb + lv / 2), 5) + 0.0 AS het, round(avg(0.5 * (lv + e * e * exp(-lv))), 5) + 0.0 AS nll, round(sum(w * hb) / sum(w), 5) + 0.0 AS huber FROM h GROUP BY grp")
def agg_heteroscedastic_loss(spark, d):
    x = pair(spark, d).select("grp", F.round("y", 6).alias("y"), F.round(F.col("yhat") - F.col("y"), 6).alias("e"), (F.col("l_quantity") / 50 - 0.5).alias("lv"))
    e, lv = F.col("e"), F.col("lv")
    return x.groupBy("grp").agg(r6(A.heteroscedastic(e, lv), 5).alias("het"), r6(A.gaussian_nll(e, lv), 5).alias("nll"), r6(A.weighted_huber(e, F.col("y"), [2, 6], [2.0, 1.0, 0.5]), 5).alias("huber"))


@query("agg_cls_metrics", "WITH c AS (SELECT quality AS y, toxic AS p FROM labels), k AS (SELECT y, count(*) FILTER (y = p) AS tp, count(*) AS a, (SELECT count(*) FROM c c2 WHERE c2.p = c.y) AS g FROM c GROUP BY y) SELECT round(sum(tp) / sum(a), 6) + 0.0 AS accuracy, round(avg(tp / a), 6) + 0.0 AS macro_recall, round(avg(2 * tp / (a + g)), 6) + 0.0 AS macro_f1 FROM k")
def agg_cls_metrics(spark, d):
    return _rounded(A.classification(table(spark, d, "labels"), "quality", "toxic"), [], 6)


@query("agg_physics_rmse", TRACK_SQL + ", b AS (SELECT route_id, seq, sqrt(vn * vn + ve * ve) - speed AS e FROM tr WHERE t >= 40 AND t < 100) SELECT route_id, round(sqrt(avg(e * e)), 4) + 0.0 AS rmse, round(avg(e), 4) + 0.0 AS bias, round(max(abs(e)), 4) + 0.0 AS most, round(max_by(e, seq), 4) + 0.0 AS at_end FROM b GROUP BY route_id")
def agg_physics_rmse(spark, d):
    b = tracks(spark, d).where("t >= 40 AND t < 100").withColumn("e", F.hypot("vn", "ve") - F.col("speed"))
    return b.groupBy("route_id").agg(r6(F.sqrt(F.avg(F.col("e") * F.col("e"))), 4).alias("rmse"), r6(F.avg("e"), 4).alias("bias"), r6(F.max(F.abs("e")), 4).alias("most"), r6(F.max_by("e", "seq"), 4).alias("at_end"))


@query("agg_highway_hist", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def agg_highway_hist(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type")


@query("agg_collect_ids", "SELECT c_mktsegment AS split, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), ',' ORDER BY CAST(c_nationkey AS VARCHAR)) AS ids FROM customer GROUP BY 1")
def agg_collect_ids(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("split")).agg(F.array_join(F.array_sort(F.collect_set(F.col("c_nationkey").cast("string"))), ",").alias("ids"))


@query("agg_latency", "WITH l AS (SELECT l_extendedprice / 1000 AS ms FROM lineitem) SELECT round(avg(ms), 4) + 0.0 AS mean, round(quantile_cont(ms, 0.95), 4) + 0.0 AS p95 FROM l")
def agg_latency(spark, d):
    ms = F.col("l_extendedprice") / 1000
    return table(spark, d, "lineitem").agg(r6(F.avg(ms), 4).alias("mean"), r6(F.percentile(ms, 0.95), 4).alias("p95"))


@query("flt_sanity_rules", SIG + f", x AS (SELECT *, t - lag(t) OVER ({_P}) AS dt FROM sig), a AS (SELECT session_id, count(*) AS n, count(*) FILTER (k % 10 = 0) AS g, count(*) / (max(t) - min(t)) * 1e5 AS rate, max(dt) / 1e6 AS gap, median(v / 10) AS acc, count(*) FILTER (k % 7 = 0) AS mag, count(*) FILTER (k = 3) AS wh FROM x GROUP BY session_id) SELECT session_id, concat_ws(',', CASE WHEN n < 100 THEN 'few_imu' END, CASE WHEN g < 10 THEN 'few_gnss' END, CASE WHEN rate < 60 OR rate > 250 THEN 'rate' END, CASE WHEN gap > 0.2 THEN 'gap' END, CASE WHEN acc < 5 THEN 'no_gravity' END, CASE WHEN mag = 0 THEN 'no_mag' END, CASE WHEN wh = 0 THEN 'no_withheld' END) AS flags FROM a")
def flt_sanity_rules(spark, d):
    x = sig(spark, d).withColumn("dt", O.diff(F.col("t"), W()))
    a = x.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("k") % 10 == 0).alias("g"), (F.count("*") / (F.max("t") - F.min("t")) * 1e5).alias("rate"), (F.max("dt") / 1e6).alias("gap"), F.median(F.col("v") / 10).alias("acc"), F.count_if(F.col("k") % 7 == 0).alias("mag"), F.count_if(F.col("k") == 3).alias("wh"))
    flags = A.sanity_flags(*(F.col(c) for c in ("n", "g", "rate", "gap", "acc", "mag", "wh")))
    return a.select("session_id", F.array_join(flags, ",").alias("flags"))


@query("est_live_drift", TRACK_SQL + _ERR + ", b AS (SELECT route_id, seq, err, sum(ds) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS travelled FROM er WHERE t >= 40 AND t < 100) SELECT route_id, seq, CASE WHEN travelled >= 15 THEN round(err / travelled * 100, 3) + 0.0 END AS drift_pct FROM b")
def est_live_drift(spark, d):
    b = _errors(spark, d).where("t >= 40 AND t < 100").withColumn("travelled", F.sum("ds").over(O.running("route_id", "seq")))
    return b.select("route_id", "seq", F.when(F.col("travelled") >= 15, r6(F.col("err") / F.col("travelled") * 100, 3)).alias("drift_pct"))


@query("est_blackout_toggle", TRACK_SQL + " SELECT route_id, seq, CASE WHEN t >= 40 AND t < 100 THEN NULL ELSE round(tn, 3) + 0.0 END AS gnss_n, round(tn, 3) + 0.0 AS truth_n FROM tr")
def est_blackout_toggle(spark, d):
    n = r6(F.col("tn"), 3)
    return tracks(spark, d).select("route_id", "seq", F.when((F.col("t") >= 40) & (F.col("t") < 100), F.lit(None)).otherwise(n).alias("gnss_n"), n.alias("truth_n"))


@query("est_gnss_ramp", with_("route") + " SELECT route_id, seq, round(CASE WHEN t < 100 THEN 1.0 WHEN (t - 100) / 2.5 >= 1 THEN 1.0 ELSE 50 + (1 - 50) * ((t - 100) / 2.5) END::DOUBLE, 6) + 0.0 AS mult FROM route")
def est_gnss_ramp(spark, d):
    from driftline.plans.surrogates import route

    since = F.when(F.col("t") >= 100, F.col("t") - 100)
    return route(spark, d).select("route_id", "seq", r6(S.reacquire_multiplier(since)).alias("mult"))


@query("stm_tumbling_rate", "SELECT user_id AS session_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL")
def stm_tumbling_rate(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.col("user_id").alias("session_id"), F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("session_id", F.unix_seconds("w.start").alias("hour"), "n")


@query("stm_sliding", "WITH e AS (SELECT event_type, epoch_us(ts) / 1e6 AS t, value FROM events), w AS (SELECT event_type, value, (floor(t / 1800) - unnest([0, 1])) * 1800 AS s FROM e) SELECT event_type, CAST(s AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS v FROM w GROUP BY ALL")
def stm_sliding(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"), r6(F.sum("value"), 4).alias("v")).select("event_type", F.unix_seconds("w.start").alias("start"), "n", "v")


@query("stm_session", SIG + f", g AS (SELECT *, CASE WHEN lag(t) OVER ({_P}) IS NULL OR t - lag(t) OVER ({_P}) >= 43200 THEN 1 ELSE 0 END AS fresh FROM sig), s AS (SELECT *, sum(fresh) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT session_id, round(min(t), 6) + 0.0 AS began, count(*) AS n FROM s GROUP BY session_id, sid")
def stm_session(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.col("user_id").alias("session_id"), F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n")).select("session_id", r6(F.unix_micros("w.start") / F.lit(1e6)).alias("began"), "n")


@query("stm_interval_close", SIG + f", g AS (SELECT *, count(*) FILTER (k % 10 = 0) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS iv FROM sig) SELECT session_id, iv, count(*) AS n, round(sum(v), 4) + 0.0 AS sv, round(sum(v * v), 6) + 0.0 AS svv FROM g WHERE iv > 0 GROUP BY session_id, iv HAVING max(t) - min(t) <= 300000")
def stm_interval_close(spark, d):
    """Moments of each fix interval; intervals that last too long are discarded."""
    g = sig(spark, d).withColumn("iv", O.islands(F.col("k") % 10 == 0, W())).where("iv > 0")
    a = g.groupBy("session_id", "iv").agg(F.count("*").alias("n"), r6(F.sum("v"), 4).alias("sv"), r6(F.sum(F.col("v") * F.col("v"))).alias("svv"), (F.max("t") - F.min("t")).alias("span"))
    return a.where("span <= 300000").drop("span")


@query("stm_dt_guard", SIG + f", x AS (SELECT *, t - lag(t) OVER ({_P}) AS dt FROM sig) SELECT event_id, least(dt, 50000) AS dt FROM x WHERE dt > 0")
def stm_dt_guard(spark, d):
    x = sig(spark, d).withColumn("dt", O.diff(F.col("t"), W())).where("dt > 0")
    return x.select("event_id", F.least("dt", F.lit(50000.0)).alias("dt"))


@query("stm_freeze_on_event", SIG + f", x AS (SELECT *, row_number() OVER ({_P}) AS i, min(CASE WHEN k % 20 = 0 THEN t END) OVER (PARTITION BY session_id) AS at FROM sig), c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, event_id DESC) AS back FROM x WHERE t < at) SELECT session_id, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(regr_slope(v, k), 5) + 0.0 END AS slope FROM c WHERE back <= 30 GROUP BY session_id".replace(" AS at ", " AS at_ ").replace("t < at)", "t < at_)"))
def stm_freeze_on_event(spark, d):
    """A calibration over the last samples before an event, frozen there; none with too few samples."""
    at = F.min(F.when(F.col("k") % 20 == 0, F.col("t"))).over(Window.partitionBy("session_id"))
    c = sig(spark, d).withColumn("at", at).where("t < at").withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("t"), F.desc("event_id"))))
    a = c.where("back <= 30").groupBy("session_id").agg(F.count("*").alias("n"), F.regr_slope("v", "k").alias("slope"))
    return a.select("session_id", "n", F.when(F.col("n") >= 5, r6(F.col("slope"), 5)).alias("slope"))
