"""Heartbeat watchdog: scans that go quiet are queued again, or failed after too many attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palisade import session  # noqa: F401  (makes the processor below travel by value)
from palisade.operators.lifecycle import MAX_ATTEMPTS, STALE_AFTER_SECONDS

INPUT = "scan_id bigint, event_id bigint, ts timestamp, kind string"
INPUT_COLUMNS = ["scan_id", "event_id", "ts", "kind"]
STATE = "open boolean, heartbeat bigint, attempts int"
OUTPUT = "scan_id bigint, alarm_at timestamp, attempt int, action string"
_QUIET = STALE_AFTER_SECONDS * 1000
_ALIVE = ("queued", "heartbeat", "progress")


class Watchdog(StatefulProcessor):
    """State per scan: whether it is open, its last heartbeat (milliseconds) and the alarms raised so far.

    ``queued`` opens a scan and clears its alarms; ``completed`` and ``failed`` close it. Fifteen quiet minutes
    raise an alarm: the scan is queued again, and from the third alarm on it has failed and stays closed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("scan", STATE)

    def _read(self) -> tuple[bool, int, int]:
        return self.state.get() if self.state.exists() else (True, -1, 0)

    @staticmethod
    def _alarm(key, heartbeat: int, attempts: int) -> tuple[dict, bool]:
        attempt = attempts + 1
        failed = attempt >= MAX_ATTEMPTS
        row = {
            "scan_id": key[0], "alarm_at": pd.Timestamp(heartbeat + _QUIET, unit="ms", tz="UTC").tz_localize(None),
            "attempt": attempt, "action": "failed" if failed else "requeued",
        }
        return row, not failed

    @staticmethod
    def _frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["scan_id", "alarm_at", "attempt", "action"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        is_open, heartbeat, attempts = self._read()
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        times = batch["ts"].astype("datetime64[us]").astype("int64") // 1000
        alarms = []
        for at, kind in zip(times, batch["kind"]):
            if is_open and 0 <= heartbeat and at - heartbeat > _QUIET:
                alarm, is_open = self._alarm(key, heartbeat, attempts)
                alarms.append(alarm)
                attempts, heartbeat = attempts + 1, -1
            if kind == "queued":
                is_open, attempts = True, 0
            if is_open and kind in _ALIVE:
                heartbeat = max(heartbeat, at)
            elif kind in ("completed", "failed"):
                is_open, heartbeat = False, -1
        self.state.update((is_open, int(heartbeat), int(attempts)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if is_open and heartbeat >= 0:
            self.handle.registerTimer(int(heartbeat) + _QUIET)
        yield self._frame(alarms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        is_open, heartbeat, attempts = self._read()
        if not is_open or heartbeat < 0 or heartbeat + _QUIET != expiredTimerInfo.getExpiryTimeInMs():
            yield self._frame([])
            return
        alarm, stays_open = self._alarm(key, heartbeat, attempts)
        self.state.update((stays_open, -1, attempts + 1))
        yield self._frame([alarm])

    def close(self) -> None:
        pass


def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drop heartbeats that lie between two others of the same scan and minute.

    They cannot open a quiet period of fifteen minutes, so no alarm changes; what a busy scan sends to its one
    state is bounded by the minutes it covers, not by its number of heartbeats.
    """
    for rows in batches:
        rows = rows.sort_values(["scan_id", "ts", "event_id"], na_position="last")
        alive = rows["kind"].isin(("heartbeat", "progress"))
        minute = rows["ts"].dt.floor("min")

        def continues(step: int) -> pd.Series:
            return alive.shift(step, fill_value=False) & (rows["scan_id"].shift(step) == rows["scan_id"]) & (minute.shift(step) == minute)

        yield rows[~(alive & continues(1) & continues(-1))]


def watch(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Alarms of a stream of ``events(scan_id, event_id, ts, kind)``. Needs the RocksDB state store (``events.run_available`` starts with it)."""
    # The row that ends a bounded input has no ids; -1 keeps the columns whole numbers in pandas.
    whole = [F.coalesce(c, F.lit(-1)).alias(c) if c in ("scan_id", "event_id") else F.col(c) for c in INPUT_COLUMNS]
    thinned = events.select(whole).mapInPandas(thin, INPUT)
    keyed = thinned.withWatermark("ts", lateness).groupBy("scan_id")
    return keyed.transformWithStateInPandas(
        statefulProcessor=Watchdog(), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")
