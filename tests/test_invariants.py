import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import scalar as S
from driftline.operators import estimators as E
from driftline.operators import joins as J
from driftline.operators import ordered as O
from driftline.operators import splits as SP
from driftline.operators import tensors as T
from driftline.plans import kernel_queries as K
from driftline.sources import recordings as R
from driftline.sources import sinks
from driftline.sources.synthetic import synth_pair, synth_phone, synth_route


def test_filter_drift_and_covariance(spark, data):
    p = K.est_pipeline_batch(spark, data).toPandas().sort_values("seq")
    e = np.hypot(p.fused_n - p.tn, p.fused_e - p.te)
    assert e[p.t < 40].mean() < 3
    out = (p.t >= 40) & (p.t < 100)
    path = np.hypot(np.diff(p.tn), np.diff(p.te))[out.to_numpy()[1:]].sum()
    assert e[out].iloc[-1] / path < 0.15
    assert K.est_ukf_batch(spark, data).agg(F.min("p_min")).first()[0] > 0


def test_null_is_not_zero():
    a, b = (E.FusionFilter(np.array([0, 0, 10.0, 0, 0, 0, 0])) for _ in range(2))
    a.step(0.1, 0.0, a=None)
    b.step(0.1, 0.0, a=0.0)
    assert a.x[E.VN] == pytest.approx(10, abs=0.3) and b.x[E.VN] < 8


def test_signature_anchor_pulls_and_is_gated():
    for conf, moved in ((0.9, True), (0.5, False)):
        f = E.FusionFilter(np.zeros(7))
        f.step(0.1, 0.0, signature=(5.0, 0.0), confidence=conf)
        assert bool(f.x[E.PN] > 0.05) is moved


def test_disagreeing_channel_is_trusted_less():
    near, far = (E.FusionFilter(np.array([0, 0, 10.0, 0, 0, 0, 0])) for _ in range(2))
    near.step(0.1, 0.0, a=12.0, b=11.0)
    far.step(0.1, 0.0, a=12.0, b=2.0)
    assert near.x[E.VN] > far.x[E.VN]


def test_corridor_gate_and_floor():
    f = E.CorridorFilter()
    f.predict(1.0)
    f.anchor(50.0, 0.4)
    assert f.x[0] == 0
    f.anchor(50.0, 0.9)
    assert f.x[0] > 5
    f.speed(-50.0, 0.1)
    assert f.x[1] == 0


def test_viterbi_prefers_continuity():
    steps = [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)]
    cands = [[(1, 1.0, 0, 0), (9, 3.0, 500, 500)], [(2, 2.0, 7, 0), (9, 1.5, 500, 500)], [(3, 1.0, 14, 0)]]
    assert E.viterbi(steps, cands) == [1, 2, 3]


def test_batch_equals_stream(spark, data, tmp_path):
    from driftline.streaming.fusion import fuse_batch, fuse_stream

    rows = K.stream_rows(spark, data)
    for i, (lo, hi) in enumerate(((0, 30), (30, 70), (70, 1000))):
        rows.where((F.col("t") >= lo) & (F.col("t") < hi)).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = fuse_stream(src).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert q.exception() is None
    key = ["t", "phase", "pn", "psi", "late", "failed"]
    a = spark.read.parquet(str(tmp_path / "out")).select(key).orderBy("t").toPandas()
    b = fuse_batch(rows).select(key).orderBy("t").toPandas()
    assert len(a) == len(b) == rows.where("kind = 'imu'").count() > 900
    assert np.allclose(a[["t", "pn", "psi"]].astype(float), b[["t", "pn", "psi"]].astype(float), equal_nan=True)


def test_partition_count_does_not_matter(spark, data):
    name = "win_unwrap"
    from driftline.queries import QUERIES

    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, QUERIES[name](spark, data).collect()))

    try:
        assert run("1") == run("8")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_clock_repair_cases(spark):
    rows = [(0, 1, 0.0), (0, 2, 100.0), (0, 3, 100.0), (0, 4, 90.0), (0, 5, -186_301.0), (0, 6, -186_201.0), (0, 7, -180_000.0)]
    df = spark.createDataFrame(rows, "s int, seq int, raw double")
    got = O.clock_repair(df, "raw", "s", "seq").orderBy("seq").collect()
    assert [r.kind for r in got] == ["first", "step", "back", "back", "reset", "step", "gap"]
    assert [r.t for r in got] == [0, 100, 200, 300, 400, 500, 6701]


def test_radius_join_finds_long_segments(spark):
    segs = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 0.0)], "seg_id long, p1n double, p1e double, p2n double, p2e double")
    pts = spark.createDataFrame([(1, 40.0, 5.0), (2, 990.0, -9.0), (3, 500.0, 11.0)], "id int, n double, e double")
    assert sorted(r.id for r in J.radius_join(pts, segs, 10.0).collect()) == [1, 2]


def test_asof_and_interpolation_edges(spark):
    a = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 20.0), (2, 1.0)], "s int, t double")
    b = spark.createDataFrame([(1, 1.0, 10.0), (1, 9.0, 50.0)], "s int, t double, v double")
    got = {(r.s, r.t): r.r_v for r in J.asof_backward(a, b, ["s"], "t", ["v"]).collect()}
    assert got == {(1, 0.0): None, (1, 5.0): 10.0, (1, 20.0): 50.0, (2, 1.0): None}
    got = {(r.s, r.t): r.r_v for r in J.interpolate(a, b, ["s"], "t", ["v"]).collect()}
    assert got == {(1, 0.0): 10.0, (1, 5.0): 30.0, (1, 20.0): 50.0, (2, 1.0): None}


def test_sliding_shapes(spark):
    df = spark.range(21).select(F.lit(0).alias("s"), "id")
    n = lambda d: d.select("wid").distinct().count()
    assert n(T.sliding(df, ["s"], ["id"], 5, 4)) == 5
    assert n(T.sliding(df, ["s"], ["id"], 5, 4, drop_last=True)) == 4
    assert T.sliding(df, ["s"], ["id"], 22, 4).count() == 0


def test_split_is_stable_and_sized(spark):
    s = spark.range(200).select(F.col("id").cast("string").alias("session_id"))
    a = SP.hash_split(s).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in a} == {"train": 140, "val": 30, "test": 30}
    assert SP.hash_split(s.repartition(7)).where("split = 'val'").select("session_id").exceptAll(SP.hash_split(s).where("split = 'val'").select("session_id")).count() == 0


def test_csv_headers(spark, tmp_path):
    f = tmp_path / "V-a1.csv"
    f.write_bytes("Time  (s), Latitude ,Longitude,Velocity (km/h),Heading,Yaw Rate \xb0/s,Wheel speed front left,Wheel speed front right\n0,52,-1,36,90,1,10,11\nx,52,-1,72,90,1,10,11\n".encode("cp1252"))
    df = R.read_csv_any(spark, str(f), R.VEHICLE)
    rows = df.orderBy("velocity_kmh").collect()
    assert rows[0].velocity_kmh == 36 and rows[1].time_s is None and rows[0].file_name == "V-a1.csv"
    with pytest.raises(ValueError, match="lat"):
        R.resolve(["time"], {"time_s": "time", "lat": "latitude"})
    assert R.sniff(spark, str(f)) == "csv"


def test_log_round_trip(spark, tmp_path):
    imu, gnss = synth_phone(spark, duration_s=3)
    imu, gnss = imu.withColumn("session_id", F.lit("a")), gnss.withColumn("session_id", F.lit("a"))
    sinks.write_log(imu, gnss, str(tmp_path / "log"))
    lines = "\n".join(p.read_text() for p in (tmp_path / "log").rglob("part-*"))
    assert lines.startswith('{"type":"header"')
    (tmp_path / "one.jsonl").write_text(lines + '\n{"type":"imu","t":99.0,"ax\n\n{"type":"new","t":1}\n')
    got = R.read_log(spark, str(tmp_path / "one.jsonl"))
    assert got["imu"].count() == 300 and got["gnss"].count() == 3 and got["rejected"].count() == 0
    assert got["imu"].where("mx IS NOT NULL").count() == 0 and got["imu"].agg(F.min("t")).first()[0] == 0
    assert R.sniff(spark, str(tmp_path / "one.jsonl")) == "jsonl"
    (tmp_path / "bad.jsonl").write_text('{"type":"imu","t":1.0}\n')
    assert R.read_log(spark, str(tmp_path / "bad.jsonl"))["rejected"].count() == 1


def test_graphml(spark, tmp_path):
    f = tmp_path / "g.graphml"
    f.write_text('<?xml version="1.0"?><graphml><key id="d4" for="node" attr.name="y" attr.type="double"/><key id="d5" for="node" attr.name="x" attr.type="double"/><graph edgedefault="directed"><node id="1"><data key="d4">52.4</data><data key="d5">-1.5</data></node><node id="2"><data key="d4">52.5</data><data key="d5">-1.4</data></node><edge source="1" target="2"><data key="d9">z</data></edge></graph></graphml>')
    nodes, edges = R.read_graphml(spark, str(f))
    assert {(r.id, r.lat, r.lon) for r in nodes.collect()} == {("1", 52.4, -1.5), ("2", 52.5, -1.4)}
    assert [tuple(r) for r in edges.collect()] == [("1", "2")]


def test_discovery_and_manifest(spark, tmp_path):
    for n in ("x/V-a.csv", "x/S-a.csv", "y/v-b.CSV", "y/notes.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("a\n1\n")
    names = spark.createDataFrame([(str(p),) for p in tmp_path.rglob("*.*")], "path string")
    assert {r.session_id for r in R.pair_files(names, "path").collect()} == {"a", "unsync_b"}
    m = tmp_path / "m.json"
    m.write_text('{"seed": 0, "sessions": {"a": {"driver_code": "D1", "split": "train", "synced": true}}}')
    assert [tuple(r) for r in R.read_manifest(spark, str(m)).collect()] == [("a", "D1", "train", True)]


def test_catalog_recovery(spark):
    raw = spark.createDataFrame([("a", 1.0, 2.0), ("b", 5.0, 3.0), ("b", 6.0, 3.0), ("c", 99.0, 1.0)], "session_id string, t double, speed double")
    meta = spark.createDataFrame([("a", 1.0, 2.0, 10.0)], "session_id string, started double, ended double, distance_m double")
    got = sinks.recover_catalog(raw, meta, now=100.0).collect()
    assert [(r.session_id, r.recovered) for r in got] == [("b", True), ("a", False)]


def test_writers(spark, tmp_path):
    x = spark.range(6).select(F.lit("a").alias("session_id"), F.lit("imu").alias("stream"), "id")
    sinks.write_streams(x, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("stream = 'imu'").count() == 6
    w = T.tensor(T.sliding(x, ["session_id"], ["id"], 3, 3), ["session_id"], ["id"]).withColumn("split", F.lit("train"))
    sinks.write_tensors(w, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.append_regression(spark.range(1).select(F.lit(1.5).alias("drift")), str(tmp_path / "r"), "abc", "route")
    sinks.append_regression(spark.range(1).select(F.lit(2.5).alias("drift")), str(tmp_path / "r"), "abd", "route")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


def test_synthetic_inputs(spark):
    assert synth_route(spark, "straight").agg(F.max("psi")).first()[0] == 0
    a = synth_route(spark, "constant_turn", accel_noise=0.05).agg(F.stddev("ay")).first()[0]
    assert a == pytest.approx(0.05, rel=0.2)
    imu, _ = synth_phone(spark, duration_s=5)
    x = imu.agg(F.avg(S.norm3(F.col("ax"), F.col("ay"), F.col("az")))).first()[0]
    assert x == pytest.approx(9.80665, abs=1e-6)
    v, s = synth_pair(spark)
    frame = R.session_frame(v)
    assert frame.where("true_speed BETWEEN 0 AND 20").count() == v.count()
    p, _ = S.pitch_roll(F.col("gravity_x"), F.col("gravity_y"), F.col("gravity_z"))
    assert abs(math.degrees(s.select(p).first()[0])) == pytest.approx(2, abs=1)


def test_stationary_flags_short_sessions_false(spark):
    df = spark.range(9).select(F.lit(0).alias("s"), "id", F.lit(1.0).alias("x"))
    _, still = O.stationary(F.col("x"), "s", "id")
    assert df.where(F.lit(True)).select(still.alias("f")).where("f").count() == 0


def test_schedule_within_bounds(spark):
    s = spark.createDataFrame([("a", 600.0), ("b", 70.0)], "session_id string, d double")
    rows = E.schedule(s, "session_id", "d").orderBy("session_id", "start_s").collect()
    assert all(20 <= r.end_s - r.start_s <= 50 and r.start_s >= 60 for r in rows)
    assert {r.session_id for r in rows} == {"a"}


def test_viterbi_matches_every_point(spark, data):
    got = K.geo_viterbi(spark, data)
    want = K._points(spark, data).selectExpr("event_id div 2000 AS drive", "event_id % 2000 AS seq")
    assert got.count() == want.count() > 0 and want.join(got, ["drive", "seq"], "left_anti").isEmpty()


def test_nearest_beyond(spark):
    from driftline.operators import joins as J

    seg = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 0.0, 500.0, 10.0, 500.0)], "seg_id long, p1n double, p1e double, p2n double, p2e double")
    pts = spark.createDataFrame([(1, 5.0, 3.0), (2, 5.0, 240.0), (3, 5.0, 9000.0), (4, None, 1.0)], "id long, n double, e double")
    got = {r.id: (r.seg_id, round(r.dist, 6)) for r in J.nearest_beyond(pts, seg, 25.0, ["id"]).collect()}
    assert got == {2: (1, 240.0), 3: (2, 8500.0)}


def test_committed_steps_equal_a_decode_of_every_window():
    rnd = np.random.default_rng(3)
    for n, window in ((1, 15), (4, 15), (40, 5), (60, 15)):
        steps = rnd.normal(size=(n, 2)).cumsum(axis=0) * 8
        count = rnd.integers(1, 6, n)
        there = np.arange(5)[None, :] < count[:, None]
        dist, mid = rnd.uniform(0, 25, (n, 5)), steps[:, None, :] + rnd.normal(size=(n, 5, 2)) * 20
        got = E.committed(steps, dist, mid, there, window, at_once=7)
        cands = [[(j, dist[i, j], *mid[i, j]) for j in range(count[i])] for i in range(n)]
        want = [E.viterbi([tuple(x) for x in steps[i : i + window]], cands[i : i + window])[0] for i in range(max(1, n - window + 1))]
        assert got.tolist() == want


def test_score_match_resets_without_candidates(spark):
    rows = [(1, 0, 5, 5, 6, 1.0), (1, 0, 9, 9, 10, 0.5), (1, 1, 5, 5, 6, 0.0), (1, 1, 10, 10, 11, 9.0), (1, 2, None, None, None, None), (1, 3, 5, 5, 6, 1.0), (1, 3, 10, 10, 11, 1.5), (2, 0, 7, 7, 8, 3.0), (2, 0, 6, 6, 7, 3.0)]
    c = spark.createDataFrame(rows, "drive long, seq long, seg_id long, u long, v long, score double")
    got = sorted(tuple(r) for r in E.score_match(c, "drive").collect())
    assert got == [(1, 0, 9, 0.5, False), (1, 1, 10, 9.0, True), (1, 2, None, None, False), (1, 3, 5, 1.0, False), (2, 0, 6, 3.0, False)]


def test_chain_takes_the_nearest_next(spark):
    rows = [(0, i, 10.0 * i, 0.0, 10.0 * i + 9, 0.0) for i in range(30)] + [(0, 50, 9.5, 4.0, 500.0, 500.0), (0, 51, 900.0, 0.0, 910.0, 0.0)]
    got = [r.seg_id for r in E.chain(spark.createDataFrame(rows, "road int, seg_id long, p1n double, p1e double, p2n double, p2e double"), "road").orderBy("pos").collect()]
    assert got == list(range(30))


def test_spectra(spark):
    """A tone stands out at its frequency, and the density adds up to the variance; regimes with few samples have none."""
    t = np.arange(4000) / 10
    x = 3 * np.sin(2 * np.pi * 2.5 * t) + np.random.default_rng(0).normal(size=4000)
    freq, psd = E._psd(x, 10.0, 256)
    assert abs(freq[psd.argmax()] - 2.5) < 0.05 and psd.sum() * freq[1] == pytest.approx(x.var(), rel=0.05)
    rows = spark.createDataFrame([(1, i, float(v), 3.0 if i < 2000 else 12.0 if i < 3950 else 30.0) for i, v in enumerate(x)], "s int, i long, v double, speed double")
    got = E.welch_by_regime(rows, "s", "i", "v", "speed").toPandas()
    assert set(got.regime) == {"0-5 m/s", "10-15 m/s"} and (got.groupby("regime").psd.idxmax().map(got.freq) - 2.5).abs().max() < 0.05


@pytest.mark.parametrize("max_lag", [3, 40])
def test_lag_sums_by_definition(spark, max_lag):
    from driftline.operators import joins as J

    rnd = np.random.default_rng(max_lag)
    a = {int(i): float(v) for i, v in zip(rnd.choice(5000, 2500, replace=False) - 1000, rnd.normal(5, 2, 2500), strict=True)}
    b = {i - 2: v + rnd.normal() for i, v in a.items() if rnd.random() < 0.8}
    df = lambda x: spark.createDataFrame([("s", i, v) for i, v in x.items()], "by string, i long, x double")
    got = {r.lag: r for r in J.lag_table(df(a), df(b), ["by"], "i", "x", "x", max_lag, zero=True).collect()}
    for lag in range(-max_lag, max_lag + 1):
        pairs = np.array([(v, b[i - lag]) for i, v in a.items() if i - lag in b])
        assert got[lag].n == len(pairs) and got[lag].dot == pytest.approx((pairs[:, 0] * pairs[:, 1]).sum())
        assert got[lag].r == pytest.approx(np.corrcoef(pairs.T)[0, 1], abs=1e-9)
    assert J.lag_table(df(a), df(b), ["by"], "i", "x", "x", max_lag).where("lag = 0").count() == 0


def test_scans_over_many_batches(spark):
    """Scans give the same whether a session is in one batch or many, and sessions don't touch one another."""
    rnd = np.random.default_rng(5)
    rows = [(s, i, float(t), float(rnd.normal()), float(rnd.normal()) if rnd.random() < 0.05 else None) for s, n in enumerate((1, 2, 700, 3, 90)) for i, t in enumerate(rnd.uniform(0, 1, n).cumsum())]
    df = spark.createDataFrame(rows, "s int, i long, t double, a double, fix double")

    def all_of():
        return [sorted((tuple(r) for r in x.collect()), key=lambda r: r[:2]) for x in (O.ema(df, "a", "s", "i", 0.1), O.min_spacing(df, "t", "s", "i", 2.0), O.block_average(df, "a", "t", "s", "i", 3.0), O.integrate_reseed(df, "t", "a", "fix", "s", ["i"], -1.0, 1.0, 0.1))]

    whole = all_of()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for some, known in zip(all_of(), whole, strict=True):
            assert len(some) == len(known) and all(a == pytest.approx(b, abs=1e-12, nan_ok=True) if None not in a else a[:2] == b[:2] for a, b in zip(some, known, strict=True))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ema, kept, speed, last, state = {}, [], {}, {}, {}
    for s, i, t, a, fix in rows:
        ema[s, i] = a if i == 0 else 0.1 * a + 0.9 * ema[s, i - 1]
        if s not in last or t - last[s] >= 2.0:
            kept.append((s, i))
            last[s] = t
        before, at = state.get(s, (0.0, t))
        state[s] = (fix if fix is not None else max(-1.0, min(1.0, (before + a * (t - at)) * (1 - 0.1 * (t - at)))), t)
        speed[s, i] = state[s][0]
    assert {(r.s, r.i): pytest.approx(r.ema, abs=1e-12) for r in O.ema(df, "a", "s", "i", 0.1).collect()} == ema
    assert sorted((r.s, r.i) for r in O.min_spacing(df, "t", "s", "i", 2.0).collect()) == kept
    got = {(r.s, r.i): r.speed_est for r in O.integrate_reseed(df, "t", "a", "fix", "s", ["i"], -1.0, 1.0, 0.1).collect()}
    assert got.keys() == speed.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in speed.items())


def test_each_file_by_its_own_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Time (s),Note\n1,Müller é €\n".encode("windows-1252"))
    (tmp_path / "b.csv").write_bytes("Time (s),Note\n2,Müller é \ufffd\n".encode())
    got = R.read_csv_any(spark, str(tmp_path), {"time_s": "^time"}, {"note": "^note"})
    assert sorted((r.time_s, r.note) for r in got.collect()) == [(1.0, "Müller é €"), (2.0, "Müller é \ufffd")]


def test_npy_pairs(spark, tmp_path):
    x = spark.range(10).select(F.array(*[F.col("id").cast("float")] * 3).alias("w"), F.col("id").cast("double").alias("y")).repartition(3)
    sinks.write_npy(x, "w", "y", f"file://{tmp_path}/x")
    assert sorted((r.label, list(r.window)) for r in R.read_npy(spark, f"file://{tmp_path}/x").collect()) == [(float(i), [float(i)] * 3) for i in range(10)]
    np.save(tmp_path / "x" / "labels-00000.npy", np.zeros(99))
    with pytest.raises(Exception, match="differ in length"):
        R.read_npy(spark, f"file://{tmp_path}/x").collect()
    (tmp_path / "x" / "labels-00000.npy").unlink()
    with pytest.raises(Exception, match="missing"):
        R.read_npy(spark, f"file://{tmp_path}/x").collect()


def test_rotated_copies_keep_their_size(spark):
    df = spark.range(50).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    got = T.rotation_augmented(df, ["id"], "x", "y").toPandas()
    a, b = (got[got.augmented == f].sort_values("id").reset_index() for f in (False, True))
    assert len(a) == len(b) == 50 and np.allclose(np.hypot(a.x, a.y), np.hypot(b.x, b.y))
    turned = np.degrees(np.angle((b.x + 1j * b.y) / (a.x + 1j * a.y)))
    assert (np.abs(turned) <= 30).all() and np.std(turned) > 5


def test_live_path_equals_batch(spark, data):
    rows = lambda df: sorted(map(tuple, df.drop("late").collect()), key=lambda r: (r[0], r[1]))
    stream, batch = rows(K.stm_live_path(spark, data)), rows(K.stm_fused_stream(spark, data))
    assert len(stream) == len(batch) > 0
    for a, b in zip(stream, batch, strict=True):
        assert a[:3] == b[:3] and a[-1] == b[-1] and all(x == pytest.approx(y, abs=1e-9) for x, y in zip(a[3:-1], b[3:-1], strict=True))


def test_exported_networks(spark, data):
    """The int8 file is smaller and near the float one; weights that int8 can't hold fall back to half, or to float."""
    from driftline.operators.onnx_bytes import dense_network, export

    rnd = np.random.default_rng(1)
    layers = [(rnd.normal(size=(64, 32)), rnd.normal(size=32)), (rnd.normal(size=(32, 2)), rnd.normal(size=2))]
    kind, small = export(layers, rnd.normal(size=(100, 64)))
    assert kind == "int8" and len(small) < 0.5 * len(dense_network(layers))
    spiky = [(np.where(rnd.random((64, 32)) < 0.01, 1e4, rnd.normal(size=(64, 32))) * np.array([1.0] * 63 + [0.0])[:, None], np.zeros(32)), (np.ones((32, 1)), np.zeros(1))]
    spiky[0][0][0, 0] = 6e4
    sample = rnd.normal(size=(100, 64))
    sample[:, (np.abs(spiky[0][0]) > 100).any(axis=1)] = 0
    assert export(spiky, sample)[0] == "half"
    spiky[0][0][0, 0] = 1e6
    assert export(spiky, sample)[0] == "float"
    a, b = (x.toPandas().set_index("vec_id").prediction for x in (K.ml_onnx_network(spark, data), K.ml_export_quant(spark, data)))
    assert (a - b).abs().mean() < 0.05 * a.std() and (K.ml_export_quant(spark, data).first().weights) == "int8"


def test_live_path_stays_with_the_truth(spark, data):
    p = K.stm_fused_stream(spark, data).where("phase = 'RUNNING'").toPandas()
    truth = K.tracks(spark, data).selectExpr("cast(route_id as string) AS session_id", "t", "tn", "te").toPandas()
    m = p.merge(truth, on=["session_id", "t"])
    e = np.hypot(m.pn - m.tn, m.pe - m.te)
    path = np.hypot(np.diff(truth.sort_values("t").tn), np.diff(truth.sort_values("t").te)).sum()
    assert len(m) == len(p) > 900 and e[(m.t > 5) & (m.t < 40)].mean() < 5 and e[m.t < 100].max() < 0.15 * path


def _matches_sql(spark, tmp_path, name, rows):
    """A query of events (session, v, k), in this order, is the same as its SQL."""
    import duckdb
    from conftest import same

    from driftline.queries import QUERIES, SQL

    events = [(i, s, float(v), f'{{"k": {k}}}') for i, (s, v, k) in enumerate(rows)]
    df = spark.createDataFrame(events, "event_id long, user_id long, value double, props string")
    df.selectExpr("event_id", "timestamp'2024-01-01' + event_id * interval 1 second AS ts", "user_id", "'view' AS event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    same(QUERIES[name](spark, str(tmp_path)), con, SQL[name])


def test_unwrap_of_half_turns(spark, tmp_path):
    """Whether half a turn rounds to one side or the other moves all that follows by a turn."""
    rows = [(s, v, 0) for s in range(2000) for v in (s * 0.09, s * 0.09 + 90, s * 0.09, s * 0.05)]
    _matches_sql(spark, tmp_path, "win_unwrap", [(s, round(v, 2), k) for s, v, k in rows])


def test_zupt_of_variances_at_the_limit(spark, tmp_path):
    """The variance of each window of k / 1000 is exactly 0.001; which side it rounds to is the SQL's."""
    windows = ["89 53 28 43 14 0 97 52", "9 91 46 83 35 14 10 8", "52 21 5 1 67 93 75 58", "87 62 9 13 2 5 12 66", "15 56 2 74 86 31 1 7", "70 48 67 3 87 73 18 2", "11 6 35 90 91 48 62 17", "5 9 11 57 61 36 98 71"]
    _matches_sql(spark, tmp_path, "win_zupt_trailing", [(s, 1.0, k) for s, w in enumerate(windows) for k in w.split()])
    assert [np.var([int(k) for k in w.split()]) for w in windows] == [1000.0] * 8


def test_variance_in_order_without_nulls(spark):
    df = spark.createDataFrame([(0, None), (1, 3.0), (2, None), (3, 7.0), (4, 5.0)], "i int, x double")
    got = df.select("i", O.var_pop_in_order(F.col("x"), O.over([], "i").rowsBetween(-2, 0)).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [None, 0.0, 0.0, 4.0, 1.0]
