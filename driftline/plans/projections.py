"""Queries over scalar expressions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import scalar as S
from driftline.plans.registry import query
from driftline.plans.surrogates import geo, pair, route, sig, table, with_

r6 = S.r6
SIG, GEO, PAIR, ROUTE = (with_(x) for x in ("sig", "geo", "pair", "route"))


def _wrap_sql(x: str) -> str:
    return f"((({x}) + pi()) - 2 * pi() * floor((({x}) + pi()) / (2 * pi())) - pi())"


@query("prj_units", SIG + " SELECT event_id, round(v / 3.6, 6) + 0.0 AS ms, round(v / 1000.0, 6) + 0.0 AS sec, round(degrees(v / 100), 6) + 0.0 AS deg, round(v * 9.80665, 8) + 0.0 AS acc FROM sig")
def prj_units(spark, d):
    v = F.col("v")
    return sig(spark, d).select("event_id", r6(S.kmh_to_ms(v)).alias("ms"), r6(S.ms_to_s(v)).alias("sec"), r6(F.degrees(v / 100)).alias("deg"), r6(S.g_to_ms2(v), 8).alias("acc"))


@query("prj_wrap_deg", SIG + " SELECT event_id, round((v * 7 + 180) - 360 * floor((v * 7 + 180) / 360) - 180, 6) + 0.0 AS w FROM sig")
def prj_wrap_deg(spark, d):
    return sig(spark, d).select("event_id", r6(S.wrap_deg(F.col("v") * 7)).alias("w"))


@query("prj_wrap_pi", SIG + f" SELECT event_id, round({_wrap_sql('v')}, 6) + 0.0 AS w FROM sig")
def prj_wrap_pi(spark, d):
    return sig(spark, d).select("event_id", r6(S.wrap_pi(F.col("v"))).alias("w"))


@query("prj_angle_diff", SIG + f" SELECT event_id, round(abs({_wrap_sql('v - k')}), 6) + 0.0 AS w FROM sig")
def prj_angle_diff(spark, d):
    return sig(spark, d).select("event_id", r6(S.angle_diff(F.col("v"), F.col("k").cast("double"))).alias("w"))


@query("prj_bearing_psi", SIG + f", p AS (SELECT event_id, {_wrap_sql('radians(v)')} AS psi FROM sig) SELECT event_id, round(psi, 6) + 0.0 AS psi, round(degrees(psi) - 360 * floor(degrees(psi) / 360), 6) + 0.0 AS bearing FROM p")
def prj_bearing_psi(spark, d):
    p = sig(spark, d).select("event_id", S.bearing_to_heading(F.col("v")).alias("psi"))
    return p.select("event_id", r6(F.col("psi")).alias("psi"), r6(S.heading_to_bearing(F.col("psi"))).alias("bearing"))


@query("prj_norm3", SIG + " SELECT event_id, round(sqrt(v * v + k * k + 9.0), 6) + 0.0 AS m FROM sig")
def prj_norm3(spark, d):
    return sig(spark, d).select("event_id", r6(S.norm3(F.col("v"), F.col("k").cast("double"), F.lit(3.0))).alias("m"))


@query("prj_clip", SIG + " SELECT event_id, greatest(10.0, least(40.0, v)) AS c, greatest(0.0, v - 50) AS nonneg FROM sig")
def prj_clip(spark, d):
    return sig(spark, d).select("event_id", S.clip(F.col("v"), 10, 40).alias("c"), F.greatest(F.lit(0.0), F.col("v") - 50).alias("nonneg"))


@query("prj_sincos_label", SIG + " SELECT event_id, round(sin(v), 6) + 0.0 AS s, round(cos(v), 6) + 0.0 AS c, round(atan2(sin(v), cos(v)), 6) + 0.0 AS back FROM sig")
def prj_sincos_label(spark, d):
    s, c = F.sin("v"), F.cos("v")
    return sig(spark, d).select("event_id", r6(s).alias("s"), r6(c).alias("c"), r6(F.atan2(s, c)).alias("back"))


@query("prj_pitch_roll", SIG + " SELECT event_id, round(asin(greatest(-1.0, least(1.0, -(v / 100) / greatest(sqrt(v * v / 1e4 + k * k / 1e4 + 81.0), 1e-8)))), 6) + 0.0 AS pitch, round(asin(greatest(-1.0, least(1.0, (k / 100.0) / greatest(sqrt(v * v / 1e4 + k * k / 1e4 + 81.0), 1e-8)))), 6) + 0.0 AS roll FROM sig")
def prj_pitch_roll(spark, d):
    p, r = S.pitch_roll(F.col("v") / 100, F.col("k") / F.lit(100.0), F.lit(9.0))
    return sig(spark, d).select("event_id", r6(p).alias("pitch"), r6(r).alias("roll"))


@query("prj_affine_calib", PAIR + " SELECT grp, count(*) AS n, round(sum(greatest(0.0, least(40.0, 1.1 * yhat + 0.5))), 4) + 0.0 AS s FROM pair GROUP BY grp")
def prj_affine_calib(spark, d):
    return pair(spark, d).groupBy("grp").agg(F.count("*").alias("n"), r6(F.sum(S.affine_clipped(F.col("yhat"), 1.1, 0.5)), 4).alias("s"))


@query("prj_softplus_gain", SIG + " SELECT event_id, round(ln(1 + exp(1.12 * v / 100)), 6) + 0.0 AS soft, round(greatest(0.0, least(40.0, 1.12 * v)), 6) + 0.0 AS hard FROM sig")
def prj_softplus_gain(spark, d):
    return sig(spark, d).select("event_id", r6(S.softplus(F.lit(1.12) * F.col("v") / 100)).alias("soft"), r6(S.clip(F.lit(1.12) * F.col("v"), 0, 40)).alias("hard"))


@query("prj_conf_gauss", SIG + " SELECT event_id, round(exp(-0.5 * power((v / 1000) / 0.15, 2)), 6) + 0.0 AS conf FROM sig")
def prj_conf_gauss(spark, d):
    return sig(spark, d).select("event_id", r6(S.match_confidence(F.col("v") / 1000)).alias("conf"))


@query("prj_wheel_speed", SIG + " SELECT event_id, round((v + k) / 2.0 * 0.3, 6) + 0.0 AS w FROM sig")
def prj_wheel_speed(spark, d):
    return sig(spark, d).select("event_id", r6(S.wheel_speed(F.col("v"), F.col("k"))).alias("w"))


@query("prj_round_report", SIG + " SELECT event_id, round(v * 1.2345 + 1e-9, 3) + 0.0 AS r3, round(v * 1.2345 + 1e-9, 2) + 0.0 AS r2 FROM sig")
def prj_round_report(spark, d):
    return sig(spark, d).select("event_id", r6(F.col("v") * 1.2345 + 1e-9, 3).alias("r3"), r6(F.col("v") * 1.2345 + 1e-9, 2).alias("r2"))


@query("prj_velocity_from_speed_heading", SIG + " SELECT event_id, round(v * cos(radians(k)), 6) + 0.0 AS vn, round(v * sin(radians(k)), 6) + 0.0 AS ve FROM sig")
def prj_velocity(spark, d):
    n, e = S.velocity(F.col("v"), F.radians(F.col("k").cast("double")))
    return sig(spark, d).select("event_id", r6(n).alias("vn"), r6(e).alias("ve"))


@query("prj_rotate_body_world", ROUTE + " SELECT route_id, seq, round(ax * cos(psi) - ay * sin(psi), 6) + 0.0 AS an, round(ax * sin(psi) + ay * cos(psi), 6) + 0.0 AS ae FROM route")
def prj_rotate(spark, d):
    n, e = S.rotate(F.col("ax"), F.col("ay"), F.col("psi"))
    return route(spark, d).select("route_id", "seq", r6(n).alias("an"), r6(e).alias("ae"))


@query("prj_rotate_mount", SIG + ", m AS (SELECT session_id, radians(session_id % 90) AS a FROM sig GROUP BY session_id) SELECT event_id, round(cos(a) * v - sin(a) * k, 6) + 0.0 AS fx, round(sin(a) * v + cos(a) * k, 6) + 0.0 AS fy, round(0.5::DOUBLE * k, 6) + 0.0 AS yaw_rate FROM sig JOIN m USING (session_id)")
def prj_rotate_mount(spark, d):
    s = sig(spark, d)
    a = F.radians((F.col("session_id") % 90).cast("double"))
    x, y, _ = S.level(F.col("v"), F.col("k").cast("double"), F.lit(0.0), [[F.cos(a), -F.sin(a), F.lit(0.0)], [F.sin(a), F.cos(a), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]])
    return s.select("event_id", r6(x).alias("fx"), r6(y).alias("fy"), r6(F.lit(0.5) * F.col("k")).alias("yaw_rate"))


@query("prj_equirect", GEO + ", p AS (SELECT event_id, radians(lat - 52.4) * 6371000.0 AS n, radians(lon + 1.5) * 6371000.0 * cos(radians(52.4)) AS e, (lat - 52.4) * 111000.0 AS fn FROM geo) SELECT event_id, round(n, 3) + 0.0 AS n, round(e, 3) + 0.0 AS e, round(fn, 3) + 0.0 AS fn, round(52.4 + degrees(n / 6371000.0), 6) + 0.0 AS lat, round(-1.5 + degrees(e / (6371000.0 * cos(radians(52.4)))), 6) + 0.0 AS lon FROM p")
def prj_equirect(spark, d):
    n, e = S.north_east(F.col("lat"), F.col("lon"), 52.4, -1.5)
    fn, _ = S.north_east_flat(F.col("lat"), F.col("lon"), 52.4, -1.5)
    p = geo(spark, d).select("event_id", n.alias("n"), e.alias("e"), fn.alias("fn"))
    lat, lon = S.lat_lon(F.col("n"), F.col("e"), 52.4, -1.5)
    return p.select("event_id", r6(F.col("n"), 3).alias("n"), r6(F.col("e"), 3).alias("e"), r6(F.col("fn"), 3).alias("fn"), r6(lat).alias("lat"), r6(lon).alias("lon"))


@query("prj_haversine", GEO + " SELECT event_id, round(2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(lat - 52.41) / 2), 2) + cos(radians(52.41)) * cos(radians(lat)) * power(sin(radians(lon + 1.49) / 2), 2)))), 3) + 0.0 AS d FROM geo")
def prj_haversine(spark, d):
    return geo(spark, d).select("event_id", r6(S.haversine(F.lit(52.41), F.lit(-1.49), F.col("lat"), F.col("lon")), 3).alias("d"))


@query("flt_valid_pos", GEO + " SELECT event_id FROM geo WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) AND k % 7 <> 0")
def flt_valid_pos(spark, d):
    g = geo(spark, d).withColumn("lat", F.when(F.col("k") % 7 != 0, F.col("lat")))
    return g.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)").select("event_id")


@query("flt_moving", SIG + " SELECT session_id, count(*) FILTER (v / 3.6 > 1.0) AS n1, count(*) FILTER (v / 3.6 > 2.0) AS n2, count(*) FILTER (v > 5.0) AS n5 FROM sig GROUP BY session_id")
def flt_moving(spark, d):
    ms = S.kmh_to_ms(F.col("v"))
    return sig(spark, d).groupBy("session_id").agg(F.count_if(ms > 1.0).alias("n1"), F.count_if(ms > 2.0).alias("n2"), F.count_if(F.col("v") > 5.0).alias("n5"))


@query("flt_valid_target", SIG + " SELECT event_id, v - 20 AS y FROM sig WHERE v - 20 >= 0 AND k % 5 <> 0")
def flt_valid_target(spark, d):
    y = F.when(F.col("k") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("v") - 20)
    return sig(spark, d).select("event_id", y.alias("y")).where(~F.isnan("y") & (F.col("y") >= 0))


@query("flt_time_range", ROUTE + " SELECT count(*) FILTER (t >= 40 AND t < 100) AS half_open, count(*) FILTER (t BETWEEN 40 AND 100) AS closed FROM route")
def flt_time_range(spark, d):
    t = F.col("t")
    return route(spark, d).agg(F.count_if((t >= 40) & (t < 100)).alias("half_open"), F.count_if(t.between(40, 100)).alias("closed"))


@query("flt_confidence_gate", SIG + " SELECT event_id, exp(-v / 200) >= 0.85 AS road, CASE WHEN k % 2 = 0 THEN exp(-v / 200) >= 0.5 ELSE exp(-v / 200) > 0.65 END AS anchor FROM sig")
def flt_confidence_gate(spark, d):
    c = F.exp(-F.col("v") / 200)
    return sig(spark, d).select("event_id", (c >= 0.85).alias("road"), F.when(F.col("k") % 2 == 0, c >= 0.5).otherwise(c > 0.65).alias("anchor"))


@query("str_norm_header", "SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS h FROM part")
def str_norm_header(spark, d):
    return table(spark, d, "part").select("p_partkey", S.norm_header(F.col("p_name")).alias("h"))


@query("str_regex_extract", "SELECT c_custkey, regexp_extract((CASE WHEN c_custkey % 3 = 0 THEN 'v-' WHEN c_custkey % 3 = 1 THEN 'S-' ELSE 'X-' END) || c_name || '.CSV', '(?i)^[VS]-(.+)\\.csv$', 1) AS sid FROM customer")
def str_regex_extract(spark, d):
    prefix = F.when(F.col("c_custkey") % 3 == 0, "v-").when(F.col("c_custkey") % 3 == 1, "S-").otherwise("X-")
    return table(spark, d, "customer").select("c_custkey", S.session_of_file(F.concat(prefix, "c_name", F.lit(".CSV"))).alias("sid"))


@query("str_replace_prefix", "SELECT c_custkey, regexp_replace('S-' || c_name, '^S-', 'V-') AS f FROM customer")
def str_replace_prefix(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.regexp_replace(F.concat(F.lit("S-"), "c_name"), "^S-", "V-").alias("f"))


@query("str_contains", "SELECT p_partkey, contains(lower(p_name), 'e') AS e, p_type ILIKE '%a%' AS a FROM part")
def str_contains(spark, d):
    return table(spark, d, "part").select("p_partkey", F.contains(F.lower("p_name"), F.lit("e")).alias("e"), F.col("p_type").ilike("%a%").alias("a"))


@query("str_join_sorted_kv", "SELECT p_partkey, 'brand=' || p_brand || ',size=' || CAST(p_size AS VARCHAR) || ',type=' || p_type AS s FROM part")
def str_join_sorted_kv(spark, d):
    m = F.create_map(F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), "p_brand")
    return table(spark, d, "part").select("p_partkey", S.sorted_pairs(m).alias("s"))


@query("str_format_fixed", SIG + " SELECT event_id, printf('%.3f', v) AS s FROM sig")
def str_format_fixed(spark, d):
    return sig(spark, d).select("event_id", F.format_string("%.3f", "v").alias("s"))


@query("str_json_escape", "SELECT p_partkey, '{\"n\":\"' || replace(replace('a\\b\"' || p_name, '\\', '\\\\'), '\"', '\\\"') || '\"}' AS j FROM part")
def str_json_escape(spark, d):
    return table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.concat(F.lit('a\\b"'), "p_name").alias("n"))).alias("j"))


@query("json_get_number", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(json_extract_string(props, '$.zz') AS DOUBLE) AS zz FROM events")
def json_get_number(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", S.json_number(p, "k").alias("k"), S.json_number(p, "zz").alias("zz"))


@query("json_get_default", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.withheld') AS BOOLEAN), false) AS withheld, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_get_default(spark, d):
    j = F.from_json("props", "k LONG, withheld BOOLEAN")
    return table(spark, d, "events").select("event_id", F.coalesce(j["withheld"], F.lit(False)).alias("withheld"), j["k"].alias("k"))


@query("map_get_default", SIG + " SELECT event_id, CASE k % 4 WHEN 1 THEN 0.5 WHEN 2 THEN -1.25 ELSE 0.0 END::DOUBLE AS lag_s FROM sig")
def map_get_default(spark, d):
    m = F.create_map(F.lit(1), F.lit(0.5), F.lit(2), F.lit(-1.25))
    return sig(spark, d).select("event_id", S.map_get(m, F.col("k") % 4, 0.0).alias("lag_s"))


@query("est_trust_weight", SIG + " SELECT event_id, CASE WHEN abs(v / 100 - k / 10.0) > 1.5 * 1.75 THEN 2.5 ELSE 0.5 END::DOUBLE AS r FROM sig")
def est_trust_weight(spark, d):
    return sig(spark, d).select("event_id", S.trust_sigma(F.col("v") / 100, F.col("k") / F.lit(10.0)).alias("r"))


@query("est_process_noise", ROUTE + " SELECT route_id, seq, round(CASE WHEN t >= 40 AND t < 100 THEN 0.5 ELSE 0.05 END::DOUBLE * 0.1, 6) + 0.0 AS q_pos, round(CASE WHEN t >= 40 AND t < 100 THEN 0.2 ELSE 0.1 END::DOUBLE * 0.1, 6) + 0.0 AS q_vel, round(1e-3 * 0.1, 9) + 0.0 AS q_psi FROM route")
def est_process_noise(spark, d):
    q = S.process_noise(F.lit(0.1), (F.col("t") >= 40) & (F.col("t") < 100))
    return route(spark, d).select("route_id", "seq", r6(q[0]).alias("q_pos"), r6(q[2]).alias("q_vel"), r6(q[4], 9).alias("q_psi"))


@query("prj_zscore", "WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS ch FROM embeddings), s AS (SELECT ch, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS sd FROM c GROUP BY ch) SELECT ch::BIGINT AS ch, count(*) AS n, round(sum(abs((x - m) / sd)), 3) + 0.0 AS a FROM c JOIN s USING (ch) GROUP BY ch")
def prj_zscore(spark, d):
    from driftline.operators.aggregates import channel_stats

    c = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("ch", "x")).select("ch", F.col("x").cast("double"))
    stats = channel_stats(c, "ch", "x")
    j = c.join(F.broadcast(stats), "ch")  # one row a channel
    return j.groupBy(F.col("ch").cast("long").alias("ch")).agg(F.count("*").alias("n"), r6(F.sum(F.abs(S.zscore(F.col("x"), F.col("mean"), F.col("std")))), 3).alias("a"))
