"""The live path: samples and fixes of many sessions through one stateful operator.

State is one value a session: phase, the quiet window, the filter's state and covariance, and a staged fix. It is small
and of fixed size, so a RocksDB state store holds as many sessions as a cluster sees. Rows of a batch are taken in time
order; a row at or before the last time is late and counted, a long step is clamped. A failure latches a session and
leaves the others alone. Batch and stream share the kernel, so both give the same track.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.estimators import FusionFilter, FusionSettings

OUTPUT = "session_id string, t double, phase string, pn double, pe double, vn double, ve double, psi double, late long, failed boolean"
COLUMNS = ["session_id", "kind", "t", "gyro", "quiet", "gnss_n", "gnss_e", "speed", "course"]
MAX_STEP = 0.2
#: A fix's course says something from this speed on, in m/s.
COURSE_FROM = 1.5
#: Between fixes a second apart the filter counts as without them, so the noise of those that come back starts lower than
#: in replays, where fixes come with every sample.
LIVE = FusionSettings(ramp_start=5.0)
LEVEL_S = 1.0


class Session:
    """One session's state, kept as JSON."""

    def __init__(self, blob: str | None = None):
        s = json.loads(blob) if blob else {}
        self.phase, self.last, self.quiet_from, self.late, self.failed = (s.get(k, d) for k, d in (("phase", "LEVELING"), ("last", None), ("quiet_from", None), ("late", 0), ("failed", False)))
        self.fix = s.get("fix")
        self.filter = None
        if s.get("x"):
            self.filter = FusionFilter(np.array(s["x"]), LIVE, np.array(s["p"]).reshape(7, 7), s["outage"], s["since"])

    def dump(self) -> str:
        s = {k: getattr(self, k) for k in ("phase", "last", "quiet_from", "late", "failed", "fix")}
        if self.filter is not None:
            s |= {"x": self.filter.x.tolist(), "p": self.filter.p.ravel().tolist(), "outage": self.filter.outage, "since": self.filter.since}
        return json.dumps(s)

    def _measured(self) -> tuple[tuple | None, tuple | None, float | None]:
        """Position, velocity and course of the staged fix; a course counts from COURSE_FROM on."""
        if not self.fix:
            return None, None, None
        n, e, speed, course = self.fix
        vel = (speed * float(np.cos(course)), speed * float(np.sin(course))) if speed is not None and course is not None else None
        return (n, e), vel, course if vel and speed >= COURSE_FROM else None

    def row(self, r) -> tuple | None:
        """Takes a row; an IMU row gives an output row."""
        if r.kind == "gnss":
            self.fix = [None if x != x else float(x) for x in (np.nan if x is None else x for x in (r.gnss_n, r.gnss_e, r.speed, r.course))]
            return None
        if self.failed:
            return None
        if self.last is not None and r.t <= self.last:
            self.late += 1
            return None
        dt = 0.0 if self.last is None else min(r.t - self.last, MAX_STEP)
        self.last = r.t
        try:
            if self.phase == "LEVELING":
                self.quiet_from = (r.t if self.quiet_from is None else self.quiet_from) if r.quiet else None
                if self.quiet_from is not None and r.t - self.quiet_from >= LEVEL_S:
                    self.phase = "WAITING_FOR_GNSS"
            if self.phase == "WAITING_FOR_GNSS" and self.fix:
                x, (pos, vel, course) = np.zeros(7), self._measured()
                x[:2], x[2:4], x[4] = pos, vel or (0.0, 0.0), course or 0.0
                self.filter, self.phase, self.fix = FusionFilter(x, LIVE), "RUNNING", None
            elif self.phase == "RUNNING":
                pos, vel, course = self._measured()
                speed = self.fix[2] if self.fix and vel is None else None
                self.fix = None
                self.filter.step(dt, r.gyro, pos, vel, course, a=speed)
        except (np.linalg.LinAlgError, ValueError):
            self.failed = True
        x = self.filter.x if self.filter is not None else [None] * 5
        return (r.t, self.phase, *x[:5], self.late, self.failed)


def _order(pdf: pd.DataFrame) -> pd.DataFrame:
    """By time, fixes before the sample of the same time."""
    return pdf.sort_values(["t", "kind"], kind="stable")


def _frame(session_id: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(session_id, *r) for r in rows], columns=["session_id", "t", "phase", "pn", "pe", "vn", "ve", "psi", "late", "failed"])


def fuse_stream(rows: DataFrame) -> DataFrame:
    """A stream of COLUMNS to a stream of OUTPUT; kind is imu or gnss."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = Session(state.get[0] if state.exists else None)
        pdf = pd.concat(list(batches))
        out = [o for r in _order(pdf).itertuples(index=False) if (o := s.row(r)) is not None]
        state.update((s.dump(),))
        yield _frame(key[0], out)

    return rows.select(*COLUMNS).groupBy("session_id").applyInPandasWithState(step, OUTPUT, "blob string", "append", "NoTimeout")


def fuse_batch(rows: DataFrame) -> DataFrame:
    """The same over a table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Session()
        return _frame(pdf["session_id"].iloc[0], [o for r in _order(pdf).itertuples(index=False) if (o := s.row(r)) is not None])

    return rows.select(*COLUMNS).groupBy("session_id").applyInPandas(run, OUTPUT)


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Runs a streaming query over what its source has now, exactly once into Parquet files at `path`, and reads those.

    The checkpoint beside them holds offsets, state and the files of each batch, so a query that is run again after a
    failure goes on where it stopped and adds nothing twice.
    """
    done = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def rate_counter(events: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Events a second and key, with a watermark for late ones."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 second"), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "12 hours", late: str = "10 minutes") -> DataFrame:
    """Session windows of a key, emitted once the watermark passes their end."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
