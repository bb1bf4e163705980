"""The keyed state of calls over a stream of sightings and tombstones: first and last sighting, expiry, and rows that never return.

Events are (uid, ts, event_id, kind, deadline, posted, rolling); kind is 'seen' or 'tombstone'. A call keeps
* the first and the last sighting: late events move the first one back and never the last one;
* a deadline, a posting date and a rolling mark: what the earliest sighting that has one says, later ones do not change it;
* the time of its first tombstone, for ever: sightings after it are counted, and bring nothing back;
* an expiry: the end of its deadline's day (UTC); without a deadline, `stale` days after the last sighting, or after its
  posting unless it is rolling, whichever comes first. A timer closes the call when the watermark passes it; a later
  sighting opens a call without a deadline again.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DateType, LongType, StructField, StructType

STATE = "first_seen long, last_seen long, deadline date, deadline_at long, deadline_id long, posted date, posted_at long, posted_id long, rolling boolean, rolling_at long, rolling_id long, tombstone long, suppressed long, closed long, version long, timer long"
CHANGE = "uid long, version long, status string, first_seen long, last_seen long, deadline date, posted date, rolling boolean, suppressed long, closed_at long"
_NAMES = [c.split()[0] for c in STATE.split(", ")]
_KINDS = {"long": LongType(), "date": DateType(), "boolean": BooleanType()}
_DAY = 86_400_000
_EPOCH = datetime.date(1970, 1, 1)


def expiry(state: dict[str, Any], stale: int) -> int | None:
    """When a call closes, in milliseconds; null for one that was never seen."""
    if state["deadline"] is not None:
        return ((state["deadline"] - _EPOCH).days + 1) * _DAY
    ends = [] if state["last_seen"] is None else [state["last_seen"] + stale * _DAY]
    if state["posted"] is not None and not state["rolling"]:
        ends.append(((state["posted"] - _EPOCH).days + stale) * _DAY)
    return min(ends) if ends else None


class CallLedger(StatefulProcessor):
    """One call's state; each batch that changes it gives one row, the last version of which is the call's standing."""

    def __init__(self, stale: int) -> None:
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", StructType([StructField(n, _KINDS[k]) for n, k in (c.split() for c in STATE.split(", "))]))

    def _load(self) -> dict[str, Any]:
        held = self.call.get()
        return dict(zip(_NAMES, held, strict=True)) if held is not None else {n: None for n in _NAMES} | {"suppressed": 0, "version": 0}

    def _emit(self, key: Any, state: dict[str, Any]) -> Row:
        state["version"] += 1
        self.call.update(tuple(state[n] for n in _NAMES))
        status = "tombstoned" if state["tombstone"] is not None else "closed" if state["closed"] is not None else "open"
        return Row(uid=key[0], version=state["version"], status=status, first_seen=state["first_seen"], last_seen=state["last_seen"], deadline=state["deadline"], posted=state["posted"], rolling=state["rolling"], suppressed=state["suppressed"], closed_at=state["closed"])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state, now = self._load(), timerValues.getCurrentWatermarkInMs()
        for ts, _, kind, row in sorted(((r.ms, r.event_id, r.kind, r) for r in rows), key=lambda x: (x[0], x[2] != "tombstone", x[1])):
            if kind == "tombstone":
                state["tombstone"] = ts if state["tombstone"] is None else min(state["tombstone"], ts)
                continue
            if state["tombstone"] is not None and ts >= state["tombstone"]:
                state["suppressed"] += 1
                continue
            state["first_seen"] = ts if state["first_seen"] is None else min(state["first_seen"], ts)
            state["last_seen"] = ts if state["last_seen"] is None else max(state["last_seen"], ts)
            for field in ("deadline", "posted", "rolling"):
                said, at = row[field], (state[f"{field}_at"], state[f"{field}_id"])
                if said is not None and (at[0] is None or (ts, row.event_id) < at):
                    state[field], state[f"{field}_at"], state[f"{field}_id"] = said, ts, row.event_id
        state["closed"], end, timer = None, expiry(state, self.stale), None
        if state["tombstone"] is None and end is not None:
            if end <= now:
                state["closed"] = end
            else:
                timer = end
        # the state knows its timer: each question to the store is a round trip, and most rows leave the timer as it is
        if timer != state["timer"]:
            if state["timer"] is not None:
                self.handle.deleteTimer(state["timer"])
            if timer is not None:
                self.handle.registerTimer(timer)
            state["timer"] = timer
        yield self._emit(key, state)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state = self._load()
        state["closed"], state["timer"] = expiredTimerInfo.getExpiryTimeInMs(), None
        yield self._emit(key, state)

    def close(self) -> None:
        pass


def call_changes(events: DataFrame, late: str, stale: int) -> DataFrame:
    """A stream of changes of calls; needs the state store that keeps timers (STORE in the session's settings)."""
    keyed = events.select("uid", "ts", F.unix_millis("ts").alias("ms"), "event_id", "kind", "deadline", "posted", "rolling").withWatermark("ts", late).groupBy("uid")
    changes = keyed.transformWithState(CallLedger(stale), CHANGE, "Update", "EventTime")
    return changes.withColumns({c: F.timestamp_millis(c) for c in ("first_seen", "last_seen", "closed_at")})


STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def standing(changes: DataFrame) -> DataFrame:
    """Each call's last version."""
    last = Window.partitionBy("uid").orderBy(F.desc("version"))
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "version")
