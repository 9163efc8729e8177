"""Deadlines, cancellations and failures of running scans on a stream, with a timer for each bucket of scans at the deadline that is next.

Events are combined in the JVM before the state sees them: per scan, short pane of time and salt, so a scan with much of the stream is combined
by as many tasks as there are salts, and its state takes some rows a pane, whatever the number of events. Scans are kept in buckets of bounded number,
so Python calls the state once a bucket and batch, and not once a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palisade import session  # noqa: F401  (makes the processor below travel by value)

PANE = "30 seconds"
SALTS = 16
BUCKETS = 1024
STATE = "scan_id bigint, deadline bigint, done boolean"
OUTPUT = "scan_id bigint, status string, current_stage string, ended_at timestamp"
_NEVER = 1 << 62
_KINDS = ("cancel", "broke", "completed")
_SHOWN = {"cancel": ("cancelled", "cancelled"), "deadline": ("failed", "timed_out"), "broke": ("failed", "failed")}
_UNNAMED = -1  # the bucket of events without a scan


def combined(events: DataFrame, lateness: str, pane: str = PANE, salts: int = SALTS) -> DataFrame:
    """One row per scan, pane and salt of ``events(scan_id, event_id, ts, kind, deadline_at)``: the deadline, and when the scan was first cancelled or broke.

    Events that say none of this, like heartbeats, move the watermark and are one group a pane, which goes no further.
    """
    tells = F.col("deadline_at").isNotNull() | F.col("kind").isin(*_KINDS)
    # The groups are folded and not filtered before: a filter would be moved below the watermark, which counts all events.
    keys = {"scan_id": F.when(tells, F.col("scan_id")), "salt": F.when(tells, F.pmod(F.xxhash64("event_id"), F.lit(salts)))}
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.unix_millis("ts"))).alias(kind)
    grouped = events.withWatermark("ts", lateness).groupBy(F.window("ts", pane).alias("pane"), *(k.alias(n) for n, k in keys.items()))
    return grouped.agg(F.max(F.unix_millis("deadline_at")).alias("deadline"), *(first(k) for k in _KINDS)).filter(F.coalesce("deadline", *_KINDS).isNotNull()).select(
        "scan_id", "deadline", *_KINDS, F.window_time("pane").alias("ts"))


class Deadlines(StatefulProcessor):
    """State per bucket of scans: of each its deadline and whether it has ended. The end that comes first counts; at one time a cancellation wins, then the
    deadline. A bucket has one timer, at the earliest deadline that is still to come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("scans", STATE)

    def _scans(self) -> dict[int, tuple[int, bool]]:
        return {scan: (deadline, done) for scan, deadline, done in self.state.get()}

    def _keep(self, scans: dict[int, tuple[int, bool]]) -> None:
        self.state.put([(scan, *held) for scan, held in scans.items()])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        coming = min((deadline for deadline, done in scans.values() if not done), default=_NEVER)
        if coming < _NEVER:
            self.handle.registerTimer(coming)

    @staticmethod
    def _frame(key, ends: list[tuple[int, str, int]]) -> pd.DataFrame:
        rows = [(None if key[0] == _UNNAMED else scan, *_SHOWN[how], pd.Timestamp(at, unit="ms")) for scan, how, at in ends]
        return pd.DataFrame(rows, columns=["scan_id", "status", "current_stage", "ended_at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scans, first = self._scans(), {}
        deadlines: dict[int, int] = {}
        for frame in rows:
            for scan, deadline, *times in zip(*(frame[c].tolist() for c in ("scan_id", "deadline", *_KINDS))):
                # Missing times are not equal to themselves.
                if deadline == deadline:
                    deadlines[scan] = max(deadlines.get(scan, int(deadline)), int(deadline))
                known = first.get(scan, (_NEVER,) * len(_KINDS))
                first[scan] = tuple(min(k, int(t)) if t == t else k for k, t in zip(known, times))
        ends = []
        for scan, (cancel, broke, completed) in first.items():
            deadline, done = scans.get(scan, (_NEVER, False))
            if done:
                continue
            deadline = deadlines.get(scan, deadline)
            how, at = min([("cancel", cancel), ("deadline", deadline), ("completed", completed), ("broke", broke)], key=lambda o: o[1])
            done = min(cancel, broke, completed) < _NEVER
            scans[scan] = (deadline, done)
            if done and how != "completed":
                ends.append((scan, how, at))
        self._keep(scans)
        yield self._frame(key, ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        scans, mark = self._scans(), timerValues.getCurrentWatermarkInMs()
        due = [(scan, "deadline", at) for scan, (at, done) in scans.items() if not done and (at < mark or at <= expiredTimerInfo.getExpiryTimeInMs())]
        self._keep(scans | {scan: (at, True) for scan, _, at in due})
        yield self._frame(key, due)

    def close(self) -> None:
        pass


def ended(events: DataFrame, lateness: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """``OUTPUT``: scans that are cancelled, run past their deadline or break, each once. The session needs the RocksDB state store."""
    bucket = F.when(F.col("scan_id").isNull(), F.lit(_UNNAMED)).otherwise(F.pmod(F.xxhash64("scan_id"), F.lit(buckets)).cast("int"))
    told = combined(events, lateness).withColumns({"bucket": bucket, "scan_id": F.coalesce("scan_id", F.lit(0).cast("bigint"))})
    return told.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Deadlines(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
