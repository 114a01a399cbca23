"""Queries over joins, windows of samples, splits, sets and road geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import scalar as S
from driftline.operators import joins as J
from driftline.operators import ordered as O
from driftline.operators import roads as RD
from driftline.operators import splits as SP
from driftline.operators import tensors as T
from driftline.plans.ordered_queries import _P
from driftline.plans.projections import _wrap_sql
from driftline.plans.registry import query
from driftline.plans.surrogates import geo, road, sess, sig, table, with_

r6 = S.r6
SIG, SESS, ROAD, GEO = (with_(x) for x in ("sig", "sess", "road", "geo"))
BY, ORD = ["session_id"], ["t", "event_id"]
# Two streams of a session: purchases are sparse, views dense.
_AB = SIG + ", a AS (SELECT * FROM sig WHERE k % 3 = 0), b AS (SELECT * FROM sig WHERE k % 3 <> 0)"


def _a(spark, d):
    return sig(spark, d).where("k % 3 = 0")


def _b(spark, d):
    return sig(spark, d).where("k % 3 <> 0")


@query("join_asof_backward", _AB + " SELECT a.event_id, b.v AS bv FROM a ASOF LEFT JOIN b ON a.session_id = b.session_id AND a.t >= b.t")
def join_asof_backward(spark, d):
    return J.asof_backward(_a(spark, d), _b(spark, d), BY, "t", ["v"]).select("event_id", F.col("r_v").alias("bv"))


@query("join_interp", _AB + ", l AS (SELECT a.session_id, a.event_id, a.t, b.t AS t0, b.v AS v0 FROM a ASOF LEFT JOIN b ON a.session_id = b.session_id AND a.t >= b.t), u AS (SELECT l.*, b.t AS t1, b.v AS v1 FROM l ASOF LEFT JOIN b ON l.session_id = b.session_id AND l.t <= b.t) SELECT event_id, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * coalesce((t - t0) / nullif(t1 - t0, 0), 0) END + 1e-9, 6) + 0.0 AS bv FROM u")
def join_interp(spark, d):
    return J.interpolate(_a(spark, d), _b(spark, d), BY, "t", ["v"]).select("event_id", r6(F.col("r_v") + 1e-9).alias("bv"))


@query("join_searchsorted", _AB + " SELECT a.event_id, (SELECT count(*) FROM b WHERE b.session_id = a.session_id AND b.t < a.t) AS l FROM a")
def join_searchsorted(spark, d):
    return J.search_sorted(_a(spark, d), _b(spark, d), BY, "t", "left", "l").select("event_id", "l")


@query("join_latest_value", SIG + f" SELECT event_id, last_value(CASE WHEN k % 2 = 0 THEN v END IGNORE NULLS) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS gyro, last_value(CASE WHEN k % 5 = 0 THEN v END IGNORE NULLS) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS mag FROM sig")
def join_latest_value(spark, d):
    s = sig(spark, d).withColumns({"gyro": F.when(F.col("k") % 2 == 0, F.col("v")), "mag": F.when(F.col("k") % 5 == 0, F.col("v"))})
    return J.latest_values(s, BY, ORD, ["gyro", "mag"]).select("event_id", "gyro", "mag")


@query("join_overlap_grid", _AB + ", s AS (SELECT session_id, greatest(a0, b0) AS lo, least(a1, b1) AS hi FROM (SELECT session_id, min(t) AS a0, max(t) AS a1 FROM a GROUP BY 1) JOIN (SELECT session_id, min(t) AS b0, max(t) AS b1 FROM b GROUP BY 1) USING (session_id)), n AS (SELECT *, CAST(ceil((hi - lo) * 0.0001::DOUBLE) AS BIGINT) AS n FROM s WHERE hi > lo) SELECT session_id, unnest(generate_series(0, n - 1)) AS tick FROM n")
def join_overlap_grid(spark, d):
    return J.overlap_grid(_a(spark, d), _b(spark, d), BY, "t", 0.0001).select("session_id", "tick")


@query("join_equi_time", SIG + ", h AS (SELECT session_id, CAST(floor(t / 86400) AS BIGINT) AS tick, event_type, avg(v) AS v FROM sig GROUP BY ALL) SELECT a.session_id, a.tick, round(a.v - b.v, 6) + 0.0 AS d FROM h a JOIN h b ON a.session_id = b.session_id AND a.tick = b.tick WHERE a.event_type = 'view' AND b.event_type = 'click'")
def join_equi_time(spark, d):
    h = sig(spark, d).where("event_type IN ('view', 'click')").groupBy("session_id", F.floor(F.col("t") / 86400).alias("tick"), "event_type").agg(F.avg("v").alias("v"))
    a, b = (h.where(F.col("event_type") == x).select("session_id", "tick", F.col("v").alias(x)) for x in ("view", "click"))
    return a.join(b, ["session_id", "tick"]).select("session_id", "tick", r6(F.col("view") - F.col("click")).alias("d"))


_WIN = ", w AS (SELECT session_id, t AS s, t + 100000 AS e, event_id AS wid FROM sig WHERE k % 10 = 0)"


def _spans(spark, d):
    return sig(spark, d).where("k % 10 = 0").select("session_id", F.col("t").alias("s"), (F.col("t") + 100_000).alias("e"), F.col("event_id").alias("wid"))


@query("join_interval_blackout", SIG + _WIN + " SELECT sig.event_id, w.wid FROM sig JOIN w ON sig.session_id = w.session_id AND sig.t >= w.s AND sig.t < w.e")
def join_interval_blackout(spark, d):
    return J.interval_join(sig(spark, d), _spans(spark, d), BY, "t", "s", "e", 100_000.0).select("event_id", "wid")


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_semi(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_anti(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


_SPLIT = SESS + ", h AS (SELECT *, row_number() OVER (ORDER BY md5(session_id || ':0'), session_id) AS pos, count(*) OVER () AS n FROM sess), sp AS (SELECT *, CASE WHEN pos <= round(n * 0.7) THEN 'train' WHEN pos <= round(n * 0.7) + round(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM h)"
_LEAK = _SPLIT + ", wn AS (SELECT session_id, split FROM sp UNION ALL SELECT session_id, 'val' FROM sess WHERE c_custkey % 50 = 0)"


def _split(spark, d):
    return SP.hash_split(sess(spark, d))


def _leaky(spark, d):
    return _split(spark, d).select("session_id", "split").unionByName(sess(spark, d).where("c_custkey % 50 = 0").select("session_id", F.lit("val").alias("split")))


@query("rnd_shuffle_split", _SPLIT + " SELECT session_id, split FROM sp")
def rnd_shuffle_split(spark, d):
    return _split(spark, d).select("session_id", "split")


@query("agg_split_counts", _SPLIT + " SELECT split, driver, count(*) AS n FROM sp GROUP BY ALL")
def agg_split_counts(spark, d):
    return _split(spark, d).groupBy("split", "driver").agg(F.count("*").alias("n"))


@query("agg_leakage", _LEAK + " SELECT session_id, count(DISTINCT split) AS n_splits FROM wn GROUP BY 1 HAVING count(DISTINCT split) > 1")
def agg_leakage(spark, d):
    return SP.leaks(_leaky(spark, d))


@query("join_cross_pairs", _LEAK + ", u AS (SELECT DISTINCT session_id, split FROM wn) SELECT x.split AS a, y.split AS b, count(*) AS n FROM u x JOIN u y ON x.session_id = y.session_id AND x.split < y.split GROUP BY ALL")
def join_cross_pairs(spark, d):
    return SP.common_pairs(_leaky(spark, d))


_REP = SESS + ", rep AS (SELECT 'S' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS session_id, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal / 10000 END AS corr, CASE WHEN c_custkey % 13 = 0 THEN 'boundary' END AS note FROM customer WHERE c_custkey % 17 <> 0)"


def _report(spark, d):
    return sess(spark, d).where("c_custkey % 17 <> 0").select("session_id", F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal") / 10000).alias("corr"), F.when(F.col("c_custkey") % 13 == 0, "boundary").alias("note"), F.lit(True).alias("there"))


@query("flt_quality_gate", _REP + " SELECT s.session_id, CASE WHEN r.session_id IS NULL THEN 'no_report' WHEN corr IS NULL THEN 'no_corr' WHEN corr < 0.5 THEN 'low_corr' WHEN note = 'boundary' THEN 'boundary' END AS reason FROM sess s LEFT JOIN rep r USING (session_id)")
def flt_quality_gate(spark, d):
    j = sess(spark, d).join(_report(spark, d), "session_id", "left")
    return j.select("session_id", SP.gate_reason(F.coalesce("there", F.lit(False)), F.col("corr"), F.col("note")).alias("reason"))


@query("flt_split_exclusion", _REP + " SELECT session_id FROM rep WHERE corr IS NULL OR corr < 0.5")
def flt_split_exclusion(spark, d):
    return _report(spark, d).where(SP.excluded(F.col("corr"))).select("session_id")


@query("join_lookup_stats", SIG + ", st AS (SELECT event_type, avg(v) AS m FROM sig WHERE event_type <> 'view' GROUP BY 1) SELECT event_id, round(v - coalesce(m, 0), 6) + 0.0 AS c FROM sig LEFT JOIN st USING (event_type)")
def join_lookup_stats(spark, d):
    s = sig(spark, d)
    st = s.where("event_type <> 'view'").groupBy("event_type").agg(F.avg("v").alias("m"))
    return s.join(st, "event_type", "left").select("event_id", r6(F.col("v") - F.coalesce("m", F.lit(0.0))).alias("c"))


# --- lag search ---

_HR = SIG + ", a AS (SELECT 0 AS session_id, CAST(floor(t / 3600) AS BIGINT) AS i, avg(v) AS v FROM sig WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT 0 AS session_id, CAST(floor(t / 3600) AS BIGINT) AS i, avg(v) AS w FROM sig WHERE event_type = 'click' GROUP BY ALL), lg AS (SELECT g AS lag FROM (SELECT unnest(generate_series(-12, 12)) AS g) WHERE g <> 0), tb AS (SELECT lag, round(corr(a.v, b.w), 6) + 0.0 AS r, count(*) AS n, sum(a.v * b.w) AS dot FROM lg JOIN a ON true JOIN b ON a.i = b.i + lg.lag GROUP BY lag HAVING count(*) >= 3)"


def _hourly(spark, d, kind, name):
    s = sig(spark, d).where(F.col("event_type") == kind)
    return s.groupBy(F.lit(0).alias("session_id"), F.floor(F.col("t") / 3600).alias("i")).agg(F.avg("v").alias(name))


def _lags(spark, d):
    return J.lag_table(_hourly(spark, d, "view", "v"), _hourly(spark, d, "click", "w"), BY, "i", "v", "w", 12)


@query("join_lag_selfjoin", _HR + " SELECT lag, r, n FROM tb")
def join_lag_selfjoin(spark, d):
    return _lags(spark, d).select(F.col("lag").cast("long").alias("lag"), r6(F.col("r")).alias("r"), "n")


@query("win_lag_search", _HR + " SELECT max_by(lag, (r, -lag)) AS lag, max(r) AS r, CASE WHEN abs(max_by(lag, (r, -lag))) = 12 THEN 'boundary' END AS note FROM tb")
def win_lag_search(spark, d):
    b = J.best_lag(_lags(spark, d), BY, F.col("r"), 6)
    return b.select(F.col("lag").cast("long").alias("lag"), r6(F.col("r")).alias("r"), F.when(F.abs("lag") == 12, "boundary").alias("note"))


@query("win_lag_search_abs", _HR + " SELECT max_by(lag, (abs(r), -lag)) AS lag, round(max(abs(r)) / avg(abs(r)), 3) + 0.0 AS confidence FROM tb")
def win_lag_search_abs(spark, d):
    t = _lags(spark, d).withColumn("r", r6(F.col("r")))
    return t.groupBy("session_id").agg(F.max_by("lag", F.struct(F.abs("r"), -F.col("lag"))).cast("long").alias("lag"), r6(F.max(F.abs("r")) / F.avg(F.abs("r")), 3).alias("confidence")).drop("session_id")


@query("win_xcorr_full", _HR + ", z AS (SELECT lag, round(dot / n, 4) AS s FROM tb) SELECT max_by(lag, (s, -lag)) AS lag, round(max(s), 3) + 0.0 AS s FROM z")
def win_xcorr_full(spark, d):
    z = _lags(spark, d).select("lag", F.round(F.col("dot") / F.col("n"), 4).alias("s"))
    return z.agg(F.max_by("lag", F.struct("s", -F.col("lag"))).cast("long").alias("lag"), r6(F.max("s"), 3).alias("s"))


# --- windows of samples ---

_N = SIG + f", o AS (SELECT *, row_number() OVER ({_P}) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM sig), w8 AS (SELECT session_id, n, unnest(generate_series(0, CAST(floor((n - 8) / 4) AS BIGINT))) AS wid FROM (SELECT DISTINCT session_id, n FROM o WHERE n >= 8)), m AS (SELECT w8.session_id, w8.wid, o.i, o.v, o.n FROM w8 JOIN o ON o.session_id = w8.session_id AND o.i >= w8.wid * 4 AND o.i < w8.wid * 4 + 8)"


def _windows(spark, d, drop_last=False):
    return T.sliding(sig(spark, d).select("session_id", "t", "event_id", "v", "k"), BY, ORD, 8, 4, drop_last)


_SHAPE = "count(*) AS len, round(sum(v), 4) + 0.0 AS total, max_by(v, i) AS last"


def _shape(w):
    return w.groupBy("session_id", "wid").agg(F.count("*").alias("len"), r6(F.sum("v"), 4).alias("total"), F.max_by("v", "i").alias("last"))


@query("win_sliding_tensor", _N + f" SELECT session_id, wid, {_SHAPE} FROM m GROUP BY ALL")
def win_sliding_tensor(spark, d):
    x = T.tensor(_windows(spark, d), BY, ["v"])
    total = F.aggregate(F.transform("v", lambda a: F.round(a.cast("double"), 2)), F.lit(0.0), lambda a, b: a + b)
    return x.select("session_id", "wid", F.size("v").cast("long").alias("len"), r6(total, 4).alias("total"), F.round(F.element_at("v", -1).cast("double"), 2).alias("last"))


@query("win_sliding_exclusive", _N + f" SELECT session_id, wid, {_SHAPE} FROM m WHERE wid * 4 + 8 < n GROUP BY ALL")
def win_sliding_exclusive(spark, d):
    return _shape(_windows(spark, d, drop_last=True))


@query("flt_window_mean_speed", _N + " SELECT session_id, wid, round(avg(v), 6) + 0.0 AS mean FROM m GROUP BY ALL HAVING avg(v) >= 60")
def flt_window_mean_speed(spark, d):
    return _windows(spark, d).groupBy("session_id", "wid").agg(F.avg("v").alias("m")).where("m >= 60").select("session_id", "wid", r6(F.col("m")).alias("mean"))


@query("win_causal_tensor", _N + " SELECT y.session_id, (y.i - 8) // 5 AS wid, count(*) AS len, round(sum(x.v), 4) + 0.0 AS total, y.k::BIGINT AS target FROM o y JOIN o x ON x.session_id = y.session_id AND x.i >= y.i - 8 AND x.i < y.i WHERE y.i >= 8 AND (y.i - 8) % 5 = 0 GROUP BY y.session_id, y.i, y.k")
def win_causal_tensor(spark, d):
    c = T.causal(sig(spark, d).select("session_id", "t", "event_id", "v", "k"), BY, ORD, 8, 5, "k")
    return c.groupBy("session_id", "wid").agg(F.count("*").alias("len"), r6(F.sum("v"), 4).alias("total"), F.max("target_value").cast("long").alias("target"))


@query("win_padded_tensor", SIG + ", a AS (SELECT session_id, list(v ORDER BY t, event_id) FILTER (k < 8) AS l FROM sig GROUP BY 1), b AS (SELECT session_id, coalesce(l, []) AS l FROM a) SELECT session_id, round(list_sum(list_concat([0.0::DOUBLE], l[greatest(1, len(l) - 7):])), 4) + 0.0 AS zero_sum, greatest(8, 8)::BIGINT AS size, round(coalesce(list_sum(l[greatest(1, len(l) - 7):]), 0) + greatest(0, 8 - len(l)) * coalesce(l[1], 0), 4) + 0.0 AS edge_sum FROM b")
def win_padded_tensor(spark, d):
    s = sig(spark, d).groupBy("session_id").agg(F.sort_array(F.collect_list(F.when(F.col("k") < 8, F.struct("t", "event_id", "v")))).alias("l")).withColumn("l", F.transform("l", lambda x: x["v"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    zero, edge = T.padded(F.col("l"), 8), T.padded(F.col("l"), 8, edge=True)
    return s.select("session_id", r6(total(zero), 4).alias("zero_sum"), F.size(zero).cast("long").alias("size"), r6(total(edge), 4).alias("edge_sum"))


# --- sets and sorting ---


@query("set_union_all", "SELECT s_nationkey AS k, 'IMU' AS track FROM supplier UNION ALL SELECT c_nationkey, 'GNSS' FROM customer")
def set_union_all(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("IMU").alias("track")).unionByName(table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("GNSS").alias("track")))


@query("set_intersect", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def set_intersect(spark, d):
    return table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal > 9000").select("c_nationkey"))


@query("set_difference", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).join(table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k", "left_anti")


@query("set_distinct", "SELECT DISTINCT user_id AS session_id FROM events")
def set_distinct(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("session_id")).distinct()


@query("srt_stable_time", SIG + ", u AS (SELECT session_id, floor(t / 86400) AS day, CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS rank, event_id FROM sig) SELECT event_id, row_number() OVER (PARTITION BY session_id ORDER BY day, rank, event_id) AS pos FROM u")
def srt_stable_time(spark, d):
    u = sig(spark, d).select("session_id", "event_id", F.floor(F.col("t") / 86400).alias("day"), F.when(F.col("k") % 10 == 0, 1).otherwise(0).alias("rank"))
    return u.select("event_id", F.row_number().over(O.over("session_id", ["day", "rank", "event_id"])).cast("long").alias("pos")).orderBy("pos", "event_id")


@query("srt_desc_recent", SIG + " SELECT session_id, round(max(t), 4) + 0.0 AS last FROM sig GROUP BY 1")
def srt_desc_recent(spark, d):
    return sig(spark, d).groupBy("session_id").agg(r6(F.max("t"), 4).alias("last")).orderBy(F.desc("last"))


@query("lim_first_n", SESS + " SELECT session_id FROM sess ORDER BY session_id LIMIT 15")
def lim_first_n(spark, d):
    return sess(spark, d).select("session_id").orderBy("session_id").limit(15)


@query("top1_argmin", SIG + " SELECT session_id, min_by(event_id, (v, event_id)) AS best FROM sig GROUP BY 1")
def top1_argmin(spark, d):
    return sig(spark, d).groupBy("session_id").agg(F.min_by("event_id", F.struct("v", "event_id")).alias("best"))


@query("arr_ops", "SELECT vec_id, round(list_min(embedding)::DOUBLE, 6) + 0.0 AS least, list_position(embedding, list_max(embedding)) - 1 AS argmax, len(list_filter(embedding, lambda x: x > 0)) AS pos, round(list_sum(list_transform(embedding[1:8], lambda x: greatest(-0.1, least(0.1, x::DOUBLE)))), 5) + 0.0 AS clipped, round((embedding[64] - embedding[1])::DOUBLE, 5) + 0.0 AS span FROM embeddings")
def arr_ops(spark, d):
    e = F.col("embedding")
    clipped = F.aggregate(F.transform(F.slice(e, 1, 8), lambda x: S.clip(x.cast("double"), -0.1, 0.1)), F.lit(0.0), lambda a, b: a + b)
    return table(spark, d, "embeddings").select("vec_id", r6(F.array_min(e).cast("double")).alias("least"), (F.array_position(e, F.array_max(e)) - 1).alias("argmax"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("pos"), r6(clipped, 5).alias("clipped"), r6((F.element_at(e, -1) - F.element_at(e, 1)).cast("double"), 5).alias("span"))


# --- roads ---

_SEG = ROAD + ", sg AS (SELECT i AS seg_id, n AS p1n, e AS p1e, lead(n) OVER (ORDER BY i) AS p2n, lead(e) OVER (ORDER BY i) AS p2e FROM road), seg AS (SELECT *, sqrt((p2n - p1n) * (p2n - p1n) + (p2e - p1e) * (p2e - p1e)) AS length, atan2(p2e - p1e, p2n - p1n) AS heading FROM sg WHERE p2n IS NOT NULL), pl AS (SELECT *, sum(length) OVER (ORDER BY seg_id ROWS UNBOUNDED PRECEDING) - length AS s0 FROM seg WHERE length > 0.1)"
_PTS = _SEG + ", " + GEO[5:] + ", pt AS (SELECT event_id, (event_id % 2000) * 1.0::DOUBLE AS n, (k - 50) / 2.0::DOUBLE AS e FROM geo)"
_PROJ = "greatest(0.0, least(1.0, ((pt.n - p1n) * (p2n - p1n) + (pt.e - p1e) * (p2e - p1e)) / (length * length)))"
_NEAR = _PTS + f", pj AS (SELECT event_id, seg_id, s0, length, {_PROJ} AS f, pt.n, pt.e, p1n, p1e, p2n, p2e FROM pt JOIN pl ON p1n <= pt.n + 80 AND p2n >= pt.n - 80), ds AS (SELECT *, sqrt(power(n - p1n - f * (p2n - p1n), 2) + power(e - p1e - f * (p2e - p1e), 2)) AS dist FROM pj)"


def _polyline(spark, d):
    v = road(spark, d).withColumn("road", F.lit(0))
    return RD.with_arc_length(RD.segments(v, ["road"], "i"), ["road"])


def _points(spark, d):
    return geo(spark, d).select("event_id", (F.col("event_id") % 2000).cast("double").alias("n"), ((F.col("k") - 50) / F.lit(2.0)).alias("e"))


def _matched(spark, d, radius=30.0):
    return J.radius_join(_points(spark, d), _polyline(spark, d), radius)


@query("geo_segment_explode", _SEG + " SELECT seg_id, round(length, 5) + 0.0 AS length, round(heading, 6) + 0.0 AS heading FROM pl")
def geo_segment_explode(spark, d):
    shape = road(spark, d).withColumn("g", F.lit(0)).groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "n", "e"))), lambda p: F.struct(p["n"].alias("n"), p["e"].alias("e"))).alias("shape"))
    v = RD.explode_geometry(shape, "shape", ["g"])
    return RD.segments(v, ["g"], "i").select("seg_id", r6(F.col("length"), 5).alias("length"), r6(F.col("heading")).alias("heading"))


@query("geo_polyline_edges", _SEG + " SELECT seg_id, round(s0, 4) + 0.0 AS s0 FROM pl")
def geo_polyline_edges(spark, d):
    return _polyline(spark, d).select("seg_id", r6(F.col("s0"), 4).alias("s0"))


@query("geo_project_clamped", _PTS + f" SELECT event_id, round({_PROJ}, 6) + 0.0 AS f FROM pt JOIN pl ON pl.seg_id = event_id % 199")
def geo_project_clamped(spark, d):
    p = _points(spark, d).withColumn("seg_id", F.col("event_id") % 199)
    return p.join(_polyline(spark, d), "seg_id").select("event_id", r6(RD.foot()[0]).alias("f"))


@query("join_spatial_radius", _NEAR + " SELECT event_id, seg_id, round(dist, 4) + 0.0 AS dist FROM ds WHERE dist < 30")
def join_spatial_radius(spark, d):
    return _matched(spark, d).select("event_id", "seg_id", r6(F.col("dist"), 4).alias("dist"))


@query("join_grid_index", _NEAR + " SELECT event_id, count(*) AS n FROM ds WHERE dist < 30 GROUP BY 1")
def join_grid_index(spark, d):
    return J.radius_join(_points(spark, d), _polyline(spark, d), 30.0, cell=100.0).groupBy("event_id").agg(F.count("*").alias("n"))


@query("join_nearest", _NEAR + " SELECT event_id, min_by(seg_id, (round(dist, 9), seg_id)) AS seg_id, round(min(dist), 4) + 0.0 AS dist FROM ds WHERE dist < 30 GROUP BY 1")
def join_nearest(spark, d):
    return J.nearest(_matched(spark, d), ["event_id"]).select("event_id", "seg_id", r6(F.col("dist"), 4).alias("dist"))


@query("geo_project_to_s", _NEAR + ", b AS (SELECT event_id, min_by((s0, f, length), (round(dist, 9), seg_id)) AS x FROM ds WHERE dist < 30 GROUP BY 1) SELECT event_id, round(x[1] + x[2] * x[3], 4) + 0.0 AS s FROM b".replace("(s0, f, length)", "[s0, f, length]"))
def geo_project_to_s(spark, d):
    m = J.nearest(_matched(spark, d), ["event_id"]).join(_polyline(spark, d).select("seg_id", "s0", "length"), "seg_id")
    return RD.project_to_s(m).select("event_id", r6(F.col("s"), 4).alias("s"))


_ASK = ", ask AS (SELECT unnest(generate_series(0, 400)) AS id)"


@query("geo_interp_along", _SEG + _ASK + ", tot AS (SELECT max(s0 + length) AS total, max(s0) AS ls FROM pl), q AS (SELECT id, greatest(0.0, least(total, id * 6.0::DOUBLE - 50)) AS s, ls FROM ask, tot) SELECT id, round(p1n + (s - s0) / length * (p2n - p1n), 4) + 0.0 AS n, round(p1e + (s - s0) / length * (p2e - p1e), 4) + 0.0 AS e, round(heading, 6) + 0.0 AS heading FROM q JOIN pl ON s >= s0 AND (s < s0 + length OR s0 = ls)")
def geo_interp_along(spark, d):
    asks = spark.range(401).select("id", F.lit(0).alias("road"), (F.col("id") * 6.0 - 50).alias("s_ask"))
    x = RD.interpolate_along(asks, _polyline(spark, d), ["road"], "s_ask")
    return x.select("id", r6(F.col("n"), 4).alias("n"), r6(F.col("e"), 4).alias("e"), r6(F.col("heading")).alias("heading"))


_CURV = _SEG + f", g AS (SELECT unnest(generate_series(0, CAST(floor((SELECT max(s0 + length) FROM pl)) AS BIGINT))) AS s), hp AS (SELECT s, heading FROM g JOIN pl ON s >= s0 AND s < s0 + length), st AS (SELECT *, coalesce({_wrap_sql('heading - lag(heading) OVER (ORDER BY s)')}, 0) AS d FROM hp), uw AS (SELECT s, first_value(heading) OVER (ORDER BY s) + sum(d) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS u, sum(d) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS turn FROM st), cv AS (SELECT *, CASE WHEN lag(u) OVER (ORDER BY s) IS NULL THEN lead(u) OVER (ORDER BY s) - u WHEN lead(u) OVER (ORDER BY s) IS NULL THEN u - lag(u) OVER (ORDER BY s) ELSE (lead(u) OVER (ORDER BY s) - lag(u) OVER (ORDER BY s)) / 2 END AS c FROM uw)"


def _profile(spark, d):
    p = _polyline(spark, d)
    grid = p.groupBy("road").agg(F.max(F.col("s0") + F.col("length")).alias("total")).select("road", F.explode(F.sequence(F.lit(0), F.floor("total"))).alias("s"))
    along = RD.interpolate_along(grid.withColumn("s", F.col("s").cast("double")), p, ["road"], "s")
    return RD.curvature(along, ["road"], "s", 1.0)


@query("geo_curvature_profile", _CURV + " SELECT s, round(u, 5) + 0.0 AS u, round(c, 5) + 0.0 AS c FROM cv")
def geo_curvature_profile(spark, d):
    return _profile(spark, d).select(F.col("s").cast("long").alias("s"), r6(F.col("unwrapped"), 5).alias("u"), r6(F.col("curvature"), 5).alias("c"))


@query("win_progress_match", _CURV + ", a AS (SELECT unnest(generate_series(1, 90)) AS id), j AS (SELECT id, uw.s, round(abs(turn - (0.3 * sin(id / 5.0::DOUBLE))), 9) AS dd FROM a JOIN uw ON abs(uw.s - id * 20.0) <= 20) SELECT id, CAST(min_by(s, (dd, s)) AS BIGINT) AS s, round(exp(-0.5 * power(min(dd) / 0.15, 2)), 5) + 0.0 AS conf FROM j GROUP BY id")
def win_progress_match(spark, d):
    asks = spark.range(1, 91).select("id", (F.col("id") * 20.0).alias("s_est"), (F.lit(0.3) * F.sin(F.col("id") / 5)).alias("turn_seen"))
    m = RD.match_progress(asks, _profile(spark, d), ["id"])
    return m.select("id", F.col("s_match").cast("long").alias("s"), r6(S.match_confidence(F.col("turn_diff")), 5).alias("conf"))


@query("win_rank_candidates", _NEAR + ", sc AS (SELECT event_id, seg_id, round(dist + 20 * least(abs(atan2(p2e - p1e, p2n - p1n)), pi() - abs(atan2(p2e - p1e, p2n - p1n))), 6) AS score FROM ds WHERE dist < 30) SELECT event_id, min_by(seg_id, (score, seg_id)) AS seg_id, min(score) + 0.0 AS score FROM sc GROUP BY 1")
def win_rank_candidates(spark, d):
    """Distance and heading (either way) scored together for a course due North."""
    h = F.abs("heading")
    m = _matched(spark, d).join(_polyline(spark, d).select("seg_id", "heading"), "seg_id").withColumn("score", r6(F.col("dist") + 20 * F.least(h, F.pi() - h)))
    return J.nearest(m, ["event_id"], "score").select("event_id", "seg_id", "score")


@query("join_node_coords", _SEG + ", ed AS (SELECT seg_id AS u, seg_id + 1 AS v FROM pl UNION ALL SELECT 5, 999) SELECT u, v, round(a.n, 5) + 0.0 AS p1n, round(b.e, 5) + 0.0 AS p2e FROM ed JOIN road a ON a.i = u JOIN road b ON b.i = v")
def join_node_coords(spark, d):
    nodes = road(spark, d).withColumnRenamed("i", "id")
    edges = _polyline(spark, d).select(F.col("seg_id").alias("u"), (F.col("seg_id") + 1).alias("v")).unionByName(spark.range(1).select(F.lit(5).cast("long").alias("u"), F.lit(999).cast("long").alias("v")))
    return RD.join_nodes(edges, nodes).select("u", "v", r6(F.col("p1n"), 5).alias("p1n"), r6(F.col("p2e"), 5).alias("p2e"))


@query("geo_corridor_select_scored", _NEAR + ", sc AS (SELECT event_id, seg_id, round(-power(dist / 10, 2) - power(abs(atan2(p2e - p1e, p2n - p1n)) / 0.5, 2), 6) AS score FROM ds WHERE dist < 30) SELECT event_id, max_by(seg_id, (score, -seg_id)) AS seg_id FROM sc GROUP BY 1")
def geo_corridor_select(spark, d):
    m = _matched(spark, d).join(_polyline(spark, d).select("seg_id", "heading"), "seg_id")
    m = m.withColumn("score", r6(-F.pow(F.col("dist") / 10, F.lit(2.0)) - F.pow(F.abs("heading") / 0.5, F.lit(2.0))))
    return m.groupBy("event_id").agg(F.max_by("seg_id", F.struct("score", -F.col("seg_id"))).alias("seg_id"))


@query("snk_session_csv", SIG + ", u AS (SELECT session_id, t, event_id, CASE WHEN k % 10 = 0 THEN 'gnss' ELSE 'imu' END AS kind, v FROM sig) SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY t, CASE kind WHEN 'imu' THEN 0 ELSE 1 END, event_id) AS place, kind || ':' || printf('%.2f', v) AS line FROM u")
def snk_session_csv(spark, d):
    """The merged lines of a session's streams with their places in the file; no session is put into one value."""
    from driftline.sources.sinks import merged_lines

    s = sig(spark, d)
    imu, gnss = s.where("k % 10 <> 0"), s.where("k % 10 = 0")
    text = F.format_string("%.2f", "v")
    m = merged_lines(imu.select("session_id", "t", "event_id", F.concat(F.lit("imu:"), text).alias("line")), gnss.select("session_id", "t", "event_id", F.concat(F.lit("gnss:"), text).alias("line")), ["event_id"])
    return m.select("session_id", "event_id", F.row_number().over(O.over("session_id", ["t", "stream_rank", "event_id"])).cast("long").alias("place"), "line")
