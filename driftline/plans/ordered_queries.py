"""Queries over ordered scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import scalar as S
from driftline.operators import ordered as O
from driftline.plans.projections import _wrap_sql
from driftline.plans.registry import query
from driftline.plans.surrogates import clock, geo, route, sig, with_

r6 = S.r6
SIG, GEO, CLOCK, ROUTE = (with_(x) for x in ("sig", "geo", "clock", "route"))
BY, ORD = "session_id", ["t", "event_id"]
def W():
    return O.over(BY, ORD)

def R():
    return O.running(BY, ORD)

_P = "PARTITION BY session_id ORDER BY t, event_id"


@query("win_diff", SIG + f" SELECT event_id, round(v - lag(v) OVER ({_P}), 6) + 0.0 AS d, round(coalesce(v - lag(v) OVER ({_P}), 0), 6) + 0.0 AS d0 FROM sig")
def win_diff(spark, d):
    return sig(spark, d).select("event_id", r6(O.diff(F.col("v"), W())).alias("d"), r6(O.diff(F.col("v"), W(), 0.0)).alias("d0"))


@query("win_delta_label", SIG + f" SELECT event_id, round(coalesce(v / 10 - lag(v / 10) OVER ({_P}), 0), 6) + 0.0 AS d FROM sig")
def win_delta_label(spark, d):
    return sig(spark, d).select("event_id", r6(O.diff(F.col("v") / 10, W(), 0.0)).alias("d"))


@query("win_central_gradient", SIG + f", g AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b, lag(t) OVER w AS ta, lead(t) OVER w AS tb FROM sig WINDOW w AS ({_P})) SELECT event_id, round(CASE WHEN a IS NULL THEN b - v WHEN b IS NULL THEN v - a ELSE (b - a) / 2 END, 6) + 0.0 AS g, round(CASE WHEN a IS NULL THEN (b - v) / nullif(tb - t, 0) WHEN b IS NULL THEN (v - a) / nullif(t - ta, 0) ELSE ((t - ta) * (t - ta) * b + ((tb - t) * (tb - t) - (t - ta) * (t - ta)) * v - (tb - t) * (tb - t) * a) / nullif((t - ta) * (tb - t) * (t - ta + tb - t), 0) END * 100, 4) + 0.0 AS gt FROM g")
def win_central_gradient(spark, d):
    return sig(spark, d).select("event_id", r6(O.gradient(F.col("v"), W())).alias("g"), r6(O.gradient_over(F.col("v"), F.col("t"), W()) * 100, 4).alias("gt"))


@query("win_cumsum", SIG + f" SELECT event_id, round(sum(v) OVER ({_P} ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS s FROM sig")
def win_cumsum(spark, d):
    return sig(spark, d).select("event_id", r6(F.sum("v").over(R()), 4).alias("s"))


@query("win_cummax", SIG + f" SELECT event_id, max(v) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS m FROM sig")
def win_cummax(spark, d):
    return sig(spark, d).select("event_id", F.max("v").over(R()).alias("m"))


@query("win_ffill", SIG + f" SELECT event_id, last_value(CASE WHEN k % 3 = 0 THEN v END IGNORE NULLS) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS f FROM sig")
def win_ffill(spark, d):
    x = F.when(F.col("k") % 3 == 0, F.col("v"))
    return sig(spark, d).select("event_id", F.last(x, ignorenulls=True).over(R()).alias("f"))


@query("win_unwrap", SIG + f", a AS (SELECT *, radians(v * 2 - 360 * floor(v * 2 / 360) - 180) AS ang FROM sig), s AS (SELECT *, coalesce({_wrap_sql(f'ang - lag(ang) OVER ({_P})')}, 0) AS st FROM a) SELECT event_id, round(first_value(ang) OVER ({_P}) + sum(st) OVER ({_P} ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS u FROM s")
def win_unwrap(spark, d):
    s = sig(spark, d).withColumn("ang", F.radians(S.floored_mod(F.col("v") * 2, 360) - 180))
    return O.unwrap(s, "ang", BY, ORD, "u").select("event_id", r6(F.col("u"), 4).alias("u"))


@query("win_dedupe_consecutive", SIG + f", c AS (SELECT *, k % 5 AS g, lag(k % 5) OVER ({_P}) AS b, row_number() OVER ({_P}) AS rn FROM sig) SELECT event_id, CAST(g AS BIGINT) AS g FROM c WHERE rn = 1 OR g IS DISTINCT FROM b")
def win_dedupe_consecutive(spark, d):
    s = sig(spark, d).withColumn("g", (F.col("k") % 5).cast("long"))
    return O.changed(s, "g", BY, ORD).select("event_id", "g")


@query("win_sort_dedupe_time", SIG + ", s AS (SELECT *, floor(t / 3600) AS h FROM sig) SELECT session_id, CAST(h AS BIGINT) AS h, min_by(event_id, (t, event_id)) AS event_id FROM s GROUP BY session_id, h")
def win_sort_dedupe_time(spark, d):
    s = sig(spark, d).withColumn("h", F.floor(F.col("t") / 3600))
    return O.first_of_time(s, "h", BY, ORD).select("session_id", "h", "event_id")


@query("win_rolling_var_center", SIG + f", r AS (SELECT event_id, coalesce(var_samp(v / 1000) OVER ({_P} ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 0) AS var, count(*) OVER (PARTITION BY session_id) AS n FROM sig) SELECT event_id, round(var, 6) + 0.0 AS var, var < 0.015 AND n >= 10 AS still FROM r")
def win_rolling_var_center(spark, d):
    var, still = O.stationary(F.col("v") / 1000, BY, ORD)
    return sig(spark, d).select("event_id", r6(var).alias("var"), still.alias("still"))


@query("win_zupt_trailing", SIG + f" SELECT event_id, count(*) OVER w = 8 AND var_pop(v / 1000) OVER w < 0.02 AND var_pop(k / 1000.0) OVER w < 0.001 AND abs(avg(k / 1000.0) OVER w) < 0.05 AS still FROM sig WINDOW w AS ({_P} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def win_zupt_trailing(spark, d):
    return sig(spark, d).select("event_id", O.zupt(F.col("v") / 1000, F.col("k") / F.lit(1000.0), BY, ORD, n=8).alias("still"))


@query("win_rolling_mean", SIG + f" SELECT event_id, round(avg(v) OVER ({_P} ROWS 49 PRECEDING), 8) + 0.0 AS t50, round(avg(v) OVER ({_P} ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) + 0.0 AS c10 FROM sig")
def win_rolling_mean(spark, d):
    return sig(spark, d).select("event_id", r6(O.trailing_mean(F.col("v"), BY, ORD, 50), 8).alias("t50"), r6(O.centred_mean(F.col("v"), BY, ORD, 10)).alias("c10"))


@query("win_ewm_adjusted", SIG + ", w AS (SELECT session_id, v, power(1 - 2.0::DOUBLE / 21, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, event_id DESC) - 1) AS w FROM sig) SELECT session_id, round(sum(w * v) / sum(w), 6) + 0.0 AS ewm FROM w GROUP BY session_id")
def win_ewm_adjusted(spark, d):
    return O.ewm_last(sig(spark, d), "v", BY, ORD).select("session_id", r6(F.col("ewm")).alias("ewm"))


_REC = SIG + f", o AS (SELECT *, row_number() OVER ({_P}) AS i FROM sig)"


@query("win_ema_recursive", _REC.replace("WITH", "WITH RECURSIVE", 1) + ", e AS (SELECT session_id, i, event_id, v AS g FROM o WHERE i = 1 UNION ALL SELECT o.session_id, o.i, o.event_id, 0.05::DOUBLE * o.v + 0.95::DOUBLE * e.g FROM e JOIN o ON o.session_id = e.session_id AND o.i = e.i + 1) SELECT event_id, round(g + 1e-9, 6) + 0.0 AS g FROM e")
def win_ema_recursive(spark, d):
    return O.ema(sig(spark, d), "v", BY, ORD, 0.05).select("event_id", r6(F.col("ema") + 1e-9).alias("g"))


@query("win_min_spacing", _REC.replace("WITH", "WITH RECURSIVE", 1) + ", e AS (SELECT session_id, i, event_id, t AS kept, true AS keep FROM o WHERE i = 1 UNION ALL SELECT o.session_id, o.i, o.event_id, CASE WHEN o.t - e.kept >= 100000 THEN o.t ELSE e.kept END, o.t - e.kept >= 100000 FROM e JOIN o ON o.session_id = e.session_id AND o.i = e.i + 1) SELECT event_id FROM e WHERE keep")
def win_min_spacing(spark, d):
    return O.min_spacing(sig(spark, d), "t", BY, ORD, 100_000.0).select("event_id")


@query("win_block_average", _REC.replace("WITH", "WITH RECURSIVE", 1) + ", e AS (SELECT session_id, i, t, t AS t0, v AS s, 1 AS n, false AS done, NULL::DOUBLE AS mean FROM o WHERE i = 1 UNION ALL SELECT o.session_id, o.i, o.t, CASE WHEN o.t - e.t0 >= 200000 THEN o.t ELSE e.t0 END, CASE WHEN o.t - e.t0 >= 200000 THEN 0 ELSE e.s + o.v END, CASE WHEN o.t - e.t0 >= 200000 THEN 0 ELSE e.n + 1 END, o.t - e.t0 >= 200000, CASE WHEN o.t - e.t0 >= 200000 THEN (e.s + o.v) / (e.n + 1) END FROM e JOIN o ON o.session_id = e.session_id AND o.i = e.i + 1) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY i) - 1 AS block, round(mean, 6) + 0.0 AS mean FROM e WHERE done")
def win_block_average(spark, d):
    return O.block_average(sig(spark, d), "v", "t", BY, ORD, 200_000.0).select("session_id", "block", r6(F.col("mean")).alias("mean"))


@query("win_integrate_reseed", _REC.replace("WITH", "WITH RECURSIVE", 1) + ", e AS (SELECT session_id, i, event_id, t, CASE WHEN k % 10 = 0 THEN v / 10 ELSE 0.0 END::DOUBLE AS s FROM o WHERE i = 1 UNION ALL SELECT o.session_id, o.i, o.event_id, o.t, CASE WHEN o.k % 10 = 0 THEN o.v / 10 ELSE greatest(0.0, least(70.0, e.s + (o.v - 50) / 1e5::DOUBLE * (o.t - e.t))) END FROM e JOIN o ON o.session_id = e.session_id AND o.i = e.i + 1) SELECT event_id, round(s, 5) + 0.0 AS s FROM e")
def win_integrate_reseed(spark, d):
    s = sig(spark, d).withColumns({"a": (F.col("v") - 50) / F.lit(1e5), "fix": F.when(F.col("k") % 10 == 0, F.col("v") / 10)})
    return O.integrate_reseed(s, "t", "a", "fix", BY, ORD).select("event_id", r6(F.col("speed_est"), 5).alias("s"))


@query("win_clock_repair", CLOCK + ", x AS (SELECT *, raw_ms - lag(raw_ms) OVER (PARTITION BY session_id ORDER BY seq) AS dd FROM clock) SELECT session_id, seq, sum(CASE WHEN dd IS NULL THEN 0 WHEN dd <= 0 THEN 100 ELSE dd END::DOUBLE) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS t, CASE WHEN dd IS NULL THEN 'first' WHEN dd <= -50000 THEN 'reset' WHEN dd <= 0 THEN 'back' WHEN dd > 5000 THEN 'gap' ELSE 'step' END AS kind FROM x")
def win_clock_repair(spark, d):
    return O.clock_repair(clock(spark, d), "raw_ms", "session_id", "seq").select("session_id", "seq", "t", "kind")


@query("win_clock_repair_kt", CLOCK + ", x AS (SELECT *, raw_ms / 1000 AS s, raw_ms / 1000 - lag(raw_ms / 1000) OVER (PARTITION BY session_id ORDER BY seq) AS dd FROM clock) SELECT session_id, seq, round(sum(CASE WHEN dd IS NULL THEN s WHEN dd < 0 THEN 0.1 ELSE dd END::DOUBLE) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS t FROM x")
def win_clock_repair_kt(spark, d):
    c = clock(spark, d).withColumn("s", S.ms_to_s(F.col("raw_ms")))
    return O.clock_offset(c, "s", "session_id", "seq").select("session_id", "seq", r6(F.col("t")).alias("t"))


@query("prj_rebase_time", SIG + " SELECT event_id, round(t - min(t) OVER (PARTITION BY session_id), 6) + 0.0 AS t FROM sig")
def prj_rebase_time(spark, d):
    return sig(spark, d).select("event_id", r6(F.col("t") - F.first("t").over(R())).alias("t"))


@query("flt_positive_dt", CLOCK + ", x AS (SELECT *, raw_ms - lag(raw_ms) OVER (PARTITION BY session_id ORDER BY seq) AS dd FROM clock) SELECT session_id, seq, dd AS dt FROM x WHERE dd > 0")
def flt_positive_dt(spark, d):
    c = clock(spark, d).withColumn("dt", O.diff(F.col("raw_ms"), O.over("session_id", "seq")))
    return c.where("dt > 0").select("session_id", "seq", "dt")


@query("win_gnss_velocity_dir", GEO + f", g AS (SELECT *, lat - lag(lat) OVER w AS dn, lon - lag(lon) OVER w AS de, row_number() OVER w AS rn FROM geo WINDOW w AS ({_P})), u AS (SELECT *, CASE WHEN sqrt(dn * dn + de * de) > 1e-5 THEN dn / sqrt(dn * dn + de * de) END AS un FROM g), f AS (SELECT *, last_value(un IGNORE NULLS) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS fn FROM u), z AS (SELECT *, CASE WHEN rn = 1 THEN lead(fn) OVER ({_P}) ELSE fn END AS dir FROM f) SELECT event_id, round(coalesce(dir, 0) * v, 5) + 0.0 AS vn FROM z")
def win_gnss_velocity_dir(spark, d):
    dn, de = O.diff(F.col("lat"), W()), O.diff(F.col("lon"), W())
    g = geo(spark, d).withColumn("n", F.sqrt(dn * dn + de * de)).withColumn("un", F.when(F.col("n") > 1e-5, dn / F.col("n")))
    g = g.withColumn("fn", F.last("un", ignorenulls=True).over(R())).withColumn("rn", F.row_number().over(W()))
    g = g.withColumn("dir", F.when(F.col("rn") == 1, F.lead("fn").over(W())).otherwise(F.col("fn")))
    return g.select("event_id", r6(F.coalesce("dir", F.lit(0.0)) * F.col("v"), 5).alias("vn"))


@query("win_pre_event_stat", SIG + f", e AS (SELECT session_id, max(t) AS te FROM sig WHERE k % 20 = 0 GROUP BY session_id), p AS (SELECT s.*, row_number() OVER (PARTITION BY s.session_id ORDER BY s.t DESC, s.event_id DESC) AS rn FROM sig s JOIN e USING (session_id) WHERE s.t < e.te) SELECT session_id, count(*) AS n, round(avg(v), 6) + 0.0 AS bias FROM p WHERE rn <= 10 GROUP BY session_id")
def win_pre_event_stat(spark, d):
    s = sig(spark, d).withColumn("te", F.max(F.when(F.col("k") % 20 == 0, F.col("t"))).over(Window.partitionBy("session_id")))
    p = s.where("t < te").withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("t"), F.desc("event_id"))))
    return p.where("rn <= 10").groupBy("session_id").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("bias"))


@query("win_apex_exit", SIG + f", c AS (SELECT session_id, event_id, row_number() OVER ({_P}) AS i, sum(v - 100) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS cum FROM sig) SELECT session_id, min_by(i, (round(cum, 4), i)) AS apex, round(min(cum), 4) + 0.0 AS low FROM c GROUP BY session_id")
def win_apex_exit(spark, d):
    c = sig(spark, d).select("session_id", F.row_number().over(W()).cast("long").alias("i"), F.sum(F.col("v") - 100).over(R()).alias("cum"))
    return c.groupBy("session_id").agg(F.min_by("i", F.struct(F.round("cum", 4), "i")).alias("apex"), r6(F.min("cum"), 4).alias("low"))


_DR = """, d AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY route_id ORDER BY seq), 0) AS dt FROM route), h AS (SELECT *, sum(gyro_yaw * dt) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS hd FROM d),
v AS (SELECT *, 16.7 + sum((ax * cos(hd) - ay * sin(hd)) * dt) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS vn, sum((ax * sin(hd) + ay * cos(hd)) * dt) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ve FROM h),
p AS (SELECT *, coalesce((vn + lag(vn) OVER (PARTITION BY route_id ORDER BY seq)) / 2, 0) * dt AS dn, coalesce((ve + lag(ve) OVER (PARTITION BY route_id ORDER BY seq)) / 2, 0) * dt AS de,
 coalesce((speed * cos(psi) + lag(speed * cos(psi)) OVER (PARTITION BY route_id ORDER BY seq)) / 2, 0) * dt AS tdn, coalesce((speed * sin(psi) + lag(speed * sin(psi)) OVER (PARTITION BY route_id ORDER BY seq)) / 2, 0) * dt AS tde FROM v),
tr AS (SELECT *, sum(dn) OVER w AS pn, sum(de) OVER w AS pe, sum(tdn) OVER w AS tn, sum(tde) OVER w AS te FROM p WINDOW w AS (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
TRACK_SQL = ROUTE + _DR


def tracks(spark, d):
    """Route with dead-reckoned (pn, pe) and true (tn, te) positions; truth integrates true speed and heading."""
    r = O.dead_reckoning(route(spark, d).withColumnRenamed("psi", "true_psi"), "route_id", "seq", start=(0, 0, 16.7, 0, 0))
    w, run = O.over("route_id", "seq"), O.running("route_id", "seq")
    dt = F.coalesce(O.diff(F.col("t"), w), F.lit(0.0))
    for name, f in (("tn", F.cos), ("te", F.sin)):
        v = F.col("speed") * f("true_psi")
        r = r.withColumn(name + "_step", F.coalesce((v + F.lag(v).over(w)) / 2, F.lit(0.0)) * dt).withColumn(name, F.sum(name + "_step").over(run)).drop(name + "_step")
    return r


@query("win_euler_dr", TRACK_SQL + " SELECT route_id, seq, round(pn, 4) + 0.0 AS pn, round(pe, 4) + 0.0 AS pe, round(vn, 5) + 0.0 AS vn, round(ve, 5) + 0.0 AS ve FROM tr")
def win_euler_dr(spark, d):
    return tracks(spark, d).select("route_id", "seq", r6(F.col("pn"), 4).alias("pn"), r6(F.col("pe"), 4).alias("pe"), r6(F.col("vn"), 5).alias("vn"), r6(F.col("ve"), 5).alias("ve"))


_ISL = SIG + f", f AS (SELECT *, CASE WHEN k % 10 = 0 THEN v END AS fix, coalesce(t - lag(t) OVER ({_P}), 0) / 1e5::DOUBLE AS dt FROM sig), g AS (SELECT *, count(fix) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS isl FROM f), s AS (SELECT *, coalesce(max(fix) OVER (PARTITION BY session_id, isl), 0) AS base, sum(CASE WHEN fix IS NULL THEN (v - 40) * dt ELSE 0 END) OVER (PARTITION BY session_id, isl ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS mv FROM g)"


def _islands(spark, d):
    s = sig(spark, d).withColumns({"fix": F.when(F.col("k") % 10 == 0, F.col("v")), "dt": F.coalesce(O.diff(F.col("t"), W()), F.lit(0.0)) / F.lit(1e5)})
    s = s.withColumn("isl", O.islands(F.col("fix").isNotNull(), W()))
    inner = O.running(["session_id", "isl"], ORD)
    return s.withColumn("base", F.coalesce(F.first("fix").over(inner), F.lit(0.0))).withColumn("mv", F.sum(F.when(F.col("fix").isNull(), (F.col("v") - 40) * F.col("dt")).otherwise(F.lit(0.0))).over(inner))


@query("win_speed_integration", _ISL + " SELECT event_id, round(base + mv, 5) + 0.0 AS s FROM s")
def win_speed_integration(spark, d):
    """Distance from speed that snaps to an anchor wherever there is one: a running sum in the anchor's island."""
    return _islands(spark, d).select("event_id", r6(F.col("base") + F.col("mv"), 5).alias("s"))


@query("est_const_velocity", _ISL + " SELECT session_id, count(DISTINCT isl) AS outages, round(max(base + mv), 5) + 0.0 AS top FROM s GROUP BY session_id")
def est_const_velocity(spark, d):
    """The plainest fusion: snap to a fix, move by the available speed between fixes."""
    return _islands(spark, d).groupBy("session_id").agg(F.countDistinct("isl").alias("outages"), r6(F.max(F.col("base") + F.col("mv")), 5).alias("top"))


_INS = SIG + f", f AS (SELECT *, v % 7 < 5 AS out, coalesce(t - lag(t) OVER ({_P}), 0) / 1e5::DOUBLE AS dt FROM sig), g AS (SELECT *, sum(CASE WHEN out THEN 0 ELSE 1 END) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS og FROM f), h AS (SELECT *, sum(CASE WHEN out THEN radians(k) * dt ELSE 0 END) OVER (PARTITION BY session_id, og ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS hd FROM g), n AS (SELECT *, sum(CASE WHEN out THEN v * cos(hd) * dt ELSE 0 END) OVER (PARTITION BY session_id, og ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS dn FROM h)"


@query("win_ins_dead_reckon", _INS + " SELECT event_id, round(hd, 6) + 0.0 AS hd, round(dn, 5) + 0.0 AS dn FROM n WHERE out")
def win_ins_dead_reckon(spark, d):
    """Heading and northing since the last fix: running sums that start anew at each outage."""
    s = sig(spark, d).withColumns({"out": F.expr("v % 7 < 5"), "dt": F.coalesce(O.diff(F.col("t"), W()), F.lit(0.0)) / F.lit(1e5)})
    s = s.withColumn("og", O.islands(~F.col("out"), W()))
    inner = O.running(["session_id", "og"], ORD)
    s = s.withColumn("hd", F.sum(F.when(F.col("out"), F.radians(F.col("k").cast("double")) * F.col("dt")).otherwise(F.lit(0.0))).over(inner))
    s = s.withColumn("dn", F.sum(F.when(F.col("out"), F.col("v") * F.cos("hd") * F.col("dt")).otherwise(F.lit(0.0))).over(inner))
    return s.where("out").select("event_id", r6(F.col("hd")).alias("hd"), r6(F.col("dn"), 5).alias("dn"))


@query("flt_leveling_quiet", SIG + f", g AS (SELECT *, sum(CASE WHEN v > 100 THEN 1 ELSE 0 END) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS grp FROM sig) SELECT session_id, grp::BIGINT AS grp, count(*) AS n, round(max(t) - min(t), 4) + 0.0 AS span FROM g GROUP BY session_id, grp HAVING count(*) >= 3")
def flt_leveling_quiet(spark, d):
    """Quiet stretches: a noisy sample starts a new one."""
    g = sig(spark, d).withColumn("grp", O.islands(F.col("v") > 100, W()))
    return g.groupBy("session_id", "grp").agg(F.count("*").alias("n"), r6(F.max("t") - F.min("t"), 4).alias("span")).where("n >= 3")


@query("win_phase_machine", SIG + ", b AS (SELECT session_id, min(t) FILTER (v < 50) AS lv, min(t) FILTER (k % 10 = 0) AS fx FROM sig GROUP BY session_id) SELECT event_id, CASE WHEN lv IS NULL OR t < lv THEN 'LEVELING' WHEN fx IS NULL OR t < greatest(lv, fx) THEN 'WAITING_FOR_GNSS' ELSE 'RUNNING' END AS phase FROM sig JOIN b USING (session_id)")
def win_phase_machine(spark, d):
    s = sig(spark, d)
    w = Window.partitionBy("session_id")
    lv, fx = F.min(F.when(F.col("v") < 50, F.col("t"))).over(w), F.min(F.when(F.col("k") % 10 == 0, F.col("t"))).over(w)
    phase = F.when(lv.isNull() | (F.col("t") < lv), "LEVELING").when(fx.isNull() | (F.col("t") < F.greatest(lv, fx)), "WAITING_FOR_GNSS").otherwise("RUNNING")
    return s.select("event_id", phase.alias("phase"))


@query("win_resample_linear", SIG + f", s AS (SELECT session_id, t, event_id, v, min(t) OVER (PARTITION BY session_id) AS t0, lead(t) OVER ({_P}) AS t1, lead(v) OVER ({_P}) AS v1 FROM sig), g AS (SELECT *, unnest(CASE WHEN t1 IS NULL THEN CASE WHEN abs((t - t0) * 0.0005::DOUBLE - ceil((t - t0) * 0.0005::DOUBLE)) < 1e-9 THEN [CAST(ceil((t - t0) * 0.0005::DOUBLE) AS BIGINT)] ELSE [] END ELSE generate_series(CAST(ceil((t - t0) * 0.0005::DOUBLE) AS BIGINT), CAST(ceil((t1 - t0) * 0.0005::DOUBLE) AS BIGINT) - 1) END) AS tick FROM s) SELECT session_id, tick, round(v + coalesce(v1 - v, 0) * coalesce((t0 + tick / 0.0005::DOUBLE - t) / (t1 - t), 0), 4) + 0.0 AS v FROM g")
def win_resample_linear(spark, d):
    return O.resample(sig(spark, d), "v", "session_id", "t", 0.0005).select("session_id", "tick", r6(F.col("v"), 4).alias("v"))


@query("win_pre_segment_ids", GEO + f", m AS (SELECT *, lag(lat) OVER ({_P}) AS la, lag(lon) OVER ({_P}) AS lo FROM geo), s AS (SELECT *, coalesce(2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * power(sin(radians(lon - lo) / 2), 2)))), 0) AS st FROM m) SELECT event_id, CAST(floor(sum(st) OVER ({_P} ROWS UNBOUNDED PRECEDING) / 75) AS BIGINT) AS seg FROM s")
def win_pre_segment_ids(spark, d):
    step = F.coalesce(S.haversine(F.lag("lat").over(W()), F.lag("lon").over(W()), F.col("lat"), F.col("lon")), F.lit(0.0))
    return geo(spark, d).withColumn("st", step).select("event_id", F.floor(F.sum("st").over(R()) / 75).alias("seg"))
