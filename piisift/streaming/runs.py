"""Runs as a live state machine (H4, H7): RUNNING until a run ends, FAILED by timer when it falls silent.

Events (run_id, seq, event, at, scan_path, report_path) arrive in any order within the watermark's delay.  Each run keeps
one small state; every change is a new row with the next ``version``.  A running run has one event-time timer, ``silence``
after its newest event; when the watermark passes it the run is FAILED, ended at that time.  An end that is reported
later than that still counts, as any event does: the event with the highest ``seq`` decides.
"""

from __future__ import annotations

from typing import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = ("start long, ended long, end_seq long, scan_path string, scan_seq long, report_path string, status string, "
         "status_seq long, newest long, version long")
FIELDS = [f.split()[0] for f in STATE.split(", ")]
STATES = "run_id string, status string, start_ms long, end_ms long, scan_path string, report_path string, version long"


class RunStates(StatefulProcessor):
    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("run", STATE)

    def _row(self, key, s: dict) -> Row:
        return Row(run_id=key[0], status=s["status"], start_ms=s["start"], end_ms=s["ended"], scan_path=s["scan_path"],
                   report_path=s["report_path"], version=s["version"])

    def _timer(self, s: dict) -> int | None:
        """When the run is failed unless it speaks: the one timer of a running run."""
        return s["newest"] + self.silence_ms if s["status"] == "RUNNING" else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a call of the state's server takes longer than all else here: the timer is known without asking
        held = self.held.get()
        s = dict(zip(FIELDS, held)) if held is not None else {**dict.fromkeys(FIELDS), "version": 0}
        before = self._timer(s)
        for e in rows:
            at, seq = e["at_ms"], int(e["seq"])
            s["newest"] = at if s["newest"] is None else max(s["newest"], at)
            if e["event"] == "started":
                s["start"] = at if s["start"] is None else min(s["start"], at)
                if s["scan_seq"] is None or seq > s["scan_seq"]:
                    s["scan_path"], s["scan_seq"] = e["scan_path"], seq
            elif s["end_seq"] is None or seq > s["end_seq"]:
                done = e["event"] == "finished"
                s["ended"], s["end_seq"], s["report_path"] = at, seq, e["report_path"] if done else None
            if s["status_seq"] is None or seq > s["status_seq"]:
                s["status"] = {"finished": "COMPLETED", "failed": "FAILED"}.get(e["event"], "RUNNING")
                s["status_seq"] = seq
        s["version"] += 1
        after = self._timer(s)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        self.held.update(tuple(s[f] for f in FIELDS))
        yield self._row(key, s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = dict(zip(FIELDS, self.held.get()))
        s["status"], s["ended"], s["version"] = "FAILED", s["newest"] + self.silence_ms, s["version"] + 1
        self.held.update(tuple(s[f] for f in FIELDS))
        yield self._row(key, s)

    def close(self) -> None:
        pass


def run_changes(events: DataFrame, silence_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Every state that any run takes: run_id, status, start_time, end_time, scan_path, report_path, version."""
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withColumn("at_ms", F.unix_millis("at"))
    rows = timed.withWatermark("at", delay).groupBy("run_id").transformWithState(
        statefulProcessor=RunStates(silence_ms), outputStructType=STATES, outputMode="Update", timeMode="EventTime")
    return rows.select("run_id", "status", F.timestamp_millis("start_ms").alias("start_time"),
                       F.timestamp_millis("end_ms").alias("end_time"), "scan_path", "report_path", "version")


def start_changes_sink(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the changes, one folder per micro-batch (a batch run again replaces its own), and stop when all is read."""
    from .stream import _start_with_partitions
    spark, key = changes.sparkSession, "spark.sql.streaming.stateStore.providerClass"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    old = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)  # the stream runs on a copy of the session
    try:
        w = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
        return _start_with_partitions(spark, w.trigger(availableNow=True), None)
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def states_now(changes: DataFrame) -> DataFrame:
    """The newest state of every run."""
    others = [c for c in changes.columns if c not in ("run_id", "epoch", "version")]
    return changes.groupBy("run_id").agg(F.max_by(F.struct(*others), F.col("version")).alias("r")).select("run_id", "r.*")
