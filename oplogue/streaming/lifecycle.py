"""The lease lifecycle as a stateful stream: submits, grants, acks, nacks and event-time expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "job_id string, at_ms bigint, event string, epoch bigint, lease_seq bigint, state string"


class LeaseProcessor(StatefulProcessor):
    """State of one job: (state, lease_seq, max_attempts, visibility_ms, not_before_ms). A lease sets a timer at its
    deadline; an unacknowledged one then goes back to ready at once, or to the dead letters when attempts are spent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, seq bigint, most bigint, visible bigint, not_before bigint, deadline bigint")

    def _drop_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)

    def _step(self, at: int, event: str, seq: int | None, most: int, visible: int) -> tuple[str, int, str]:
        if event == "submit":
            if self.job.exists():
                s = self.job.get()
                return "duplicate", s[1], s[0]
            self.job.update(("ready", 0, most or 5, visible or 30000, 0, 0))
            return "created", 0, "ready"
        if not self.job.exists():
            return "unknown", 0, "none"
        state, n, most, visible, not_before, deadline = self.job.get()
        if event == "lease":
            if state != "ready" or at < not_before:
                return "none", n, state
            if n + 1 > most:
                self.job.update(("dead_letter", n, most, visible, 0, 0))
                return "dead_letter", n, "dead_letter"
            self.job.update(("leased", n + 1, most, visible, 0, at + visible))
            self.handle.registerTimer(at + visible)
            return "granted", n + 1, "leased"
        current = state == "leased" and seq == n
        late = state == "ready" and seq is not None and seq <= n or state == "dead_letter"
        if event == "ack":
            if state == "done":
                return "ok", n, state
            if not (current or late):
                return "not_leased", n, state
            self._drop_timers()
            self.job.update(("done", n, most, visible, 0, 0))
            return "done", n, "done"
        if event == "nack" and current:
            self._drop_timers()
            wait = min(1000 << min(max(n - 1, 0), 6), 60000)
            self.job.update(("ready", n, most, visible, at + wait, 0))
            return "requeued", n, "ready"
        return "not_leased", n, state

    def _overdue(self, job_id: str, at: int) -> list[tuple]:
        """Expire a lease whose deadline has come by ``at``, so that results do not hang on where batches are cut."""
        if not self.job.exists():
            return []
        state, n, most, visible, _, deadline = self.job.get()
        if state != "leased" or deadline > at:
            return []
        state = "dead_letter" if n >= most else "ready"
        self.job.update((state, n, most, visible, 0, 0))
        return [(job_id, deadline, "expired", 1, n, state)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_ms", "ord"])
        out, number = [], lambda x: 0 if pd.isna(x) else int(x)
        for r in events.itertuples():
            seq = None if pd.isna(r.lease_seq) else int(r.lease_seq)
            out += self._overdue(key[0], int(r.at_ms))
            what, n, state = self._step(int(r.at_ms), r.event, seq, number(r.max_attempts), number(r.visibility_ms))
            out.append((key[0], int(r.at_ms), what, 1, n, state))
        yield pd.DataFrame(out, columns=["job_id", "at_ms", "event", "epoch", "lease_seq", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._overdue(key[0], expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield pd.DataFrame(out, columns=["job_id", "at_ms", "event", "epoch", "lease_seq", "state"])

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Stream of (job_id, ts, ord, event, lease_seq, max_attempts, visibility_ms) -> stream of what each did.

    Jobs spread by id; state needs the RocksDB provider. Timers run on the watermark of ``ts``.
    """
    rows = events.withWatermark("ts", delay).withColumn("at_ms", F.unix_millis("ts"))
    return rows.groupBy("job_id").transformWithStateInPandas(LeaseProcessor(), OUT, "Append", "EventTime")


def dedup(submits: DataFrame, horizon: str | None = None) -> DataFrame:
    """First submit of each key: for ever, or within a watermark of ``ts`` where the horizon bounds the state."""
    return submits.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["key"]) if horizon else submits.dropDuplicates(["key"])
