"""The queue of one owner as a stateful stream: first in, first out, over all jobs that the node owns.

A worker asks the node, not a job: the processor picks the first ready job past its back-off. Tokens carry the epoch, so
what was leased before a takeover is told from what was leased after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "owner string, ts timestamp, ord bigint, event string, job_id string, key string, epoch bigint, lease_seq bigint, max_attempts bigint, visibility_ms bigint, reachable boolean"
OUT = "owner string, at_ms bigint, event string, job_id string, epoch bigint, lease_seq bigint, state string"
#: Defaults where a submit gives 0, and the longest key.
VISIBLE_MS, ATTEMPTS, KEY_BYTES = 30000, 5, 64


class OwnerProcessor(StatefulProcessor):
    """State of an owner: its jobs (state, epoch, lease_seq, attempts left, deadline, back-off), the ids by key, and the
    order of the queue. Keys are kept for ever, so a repeated submit is answered with the first one's job.

    Events: submit (validated, one job a key), poll (a worker asks; ``reachable`` false means that no copy answers),
    ack and nack under a token (epoch, lease_seq), claim (the job changes hands at a higher epoch: ``owner`` loses it)
    and adopt (this owner takes it over at ``epoch`` with the largest sequence found, one visibility window to wait).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id string", "state string, epoch bigint, seq bigint, most bigint, visible bigint, not_before bigint, deadline bigint, place bigint")
        self.keys = handle.getMapState("keys", "key string", "job_id string")
        self.queue = handle.getValueState("queue", "next bigint")

    def _put(self, job_id: str, **change) -> tuple:
        names = ("state", "epoch", "seq", "most", "visible", "not_before", "deadline", "place")
        old = dict(zip(names, self.jobs.getValue((job_id,)) if self.jobs.containsKey((job_id,)) else ("", 1, 0, ATTEMPTS, VISIBLE_MS, 0, 0, 0), strict=True)) | change
        self.jobs.updateValue((job_id,), tuple(old[n] for n in names))
        return tuple(old[n] for n in names)

    def _place(self) -> int:
        n = self.queue.get()[0] if self.queue.exists() else 0
        self.queue.update((n + 1,))
        return n

    def _overdue(self, owner: str, at: int) -> list[tuple]:
        """Leases whose deadline has come: back to ready at the tail, or to the dead letters when attempts are spent."""
        late = sorted((j[6], k[0], j) for k, j in list(self.jobs.iterator()) if j[0] == "leased" and j[6] <= at)
        out = []
        for deadline, job_id, j in late:
            state = "dead_letter" if j[2] >= j[3] else "ready"
            self._put(job_id, state=state, deadline=0, place=self._place())
            out.append((owner, deadline, "expired", job_id, j[1], j[2], state))
        return out

    def _poll(self, at: int, reachable: bool) -> tuple:
        ready = sorted((j[7], k[0], j) for k, j in list(self.jobs.iterator()) if j[0] == "ready" and j[5] <= at)
        if not ready:
            return "no_job", None, None, None, None
        _, job_id, j = ready[0]
        if not reachable:
            return "no_quorum", job_id, j[1], j[2], "ready"
        if j[2] + 1 > j[3]:
            self._put(job_id, state="dead_letter")
            return "no_job", job_id, j[1], j[2], "dead_letter"
        self._put(job_id, state="leased", seq=j[2] + 1, deadline=at + j[4], not_before=0)
        self.handle.registerTimer(at + j[4])
        return "granted", job_id, j[1], j[2] + 1, "leased"

    def _settle(self, at: int, event: str, job_id: str, epoch: int, seq: int) -> tuple:
        state, now, last, most, visible, _, _, _ = self.jobs.getValue((job_id,))
        current = state == "leased" and epoch <= now and seq == last
        amnesty = state == "ready" and (epoch < now or epoch == now and seq <= last)
        parked = state == "dead_letter" and epoch <= now
        if event == "ack":
            if state == "done":
                return "ok", job_id, now, last, state
            if current or amnesty or parked:
                self._put(job_id, state="done", deadline=0)
                return "done", job_id, now, last, "done"
        elif current:
            self._put(job_id, state="ready", not_before=at + min(1000 << min(max(last - 1, 0), 6), 60000), deadline=0, place=self._place())
            return "requeued", job_id, now, last, "ready"
        return "not_leased", job_id, now, last, state

    def _step(self, r, at: int) -> tuple:
        n = lambda x, other=0: other if pd.isna(x) or not int(x) else int(x)
        if r.event == "submit":
            if not r.key or pd.isna(r.key) or len(r.key.encode()) > KEY_BYTES:
                return "invalid", r.job_id, None, None, None
            if self.keys.containsKey((r.key,)):
                first = self.keys.getValue((r.key,))[0]
                j = self.jobs.getValue((first,))
                return "duplicate", first, j[1], j[2], j[0]
            self.keys.updateValue((r.key,), (r.job_id,))
            self._put(r.job_id, state="ready", epoch=1, most=n(r.max_attempts, ATTEMPTS), visible=n(r.visibility_ms, VISIBLE_MS), place=self._place())
            return "created", r.job_id, 1, 0, "ready"
        if r.event == "poll":
            return self._poll(at, not pd.isna(r.reachable) and bool(r.reachable))
        if r.event == "adopt":
            seq = n(r.lease_seq)
            state = "leased" if seq else "ready"
            self._put(r.job_id, state=state, epoch=n(r.epoch), seq=seq, most=n(r.max_attempts, ATTEMPTS), visible=n(r.visibility_ms, VISIBLE_MS), deadline=at + n(r.visibility_ms, VISIBLE_MS) if seq else 0, place=self._place())
            if seq:
                self.handle.registerTimer(at + n(r.visibility_ms, VISIBLE_MS))
            return "adopted", r.job_id, n(r.epoch), seq, state
        if not self.jobs.containsKey((r.job_id,)):
            return "unknown", r.job_id, None, None, None
        if r.event == "claim":
            j = self.jobs.getValue((r.job_id,))
            if n(r.epoch) <= j[1]:
                return "stale_epoch", r.job_id, j[1], j[2], j[0]
            self.jobs.removeKey((r.job_id,))
            return "handed_over", r.job_id, n(r.epoch), j[2], j[0]
        return self._settle(at, r.event, r.job_id, n(r.epoch), n(r.lease_seq))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values(["at_ms", "ord"]).itertuples():
            out += self._overdue(key[0], int(r.at_ms))
            out.append((key[0], int(r.at_ms), *self._step(r, int(r.at_ms))))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._overdue(key[0], expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["owner", "at_ms", "event", "job_id", "epoch", "lease_seq", "state"])
        return made.astype({"epoch": "Int64", "lease_seq": "Int64"})

    def close(self) -> None:
        pass


def owner_queue(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Stream of :data:`EVENTS` -> stream of what each did. Owners spread over tasks; timers run on the watermark of ``ts``;
    state needs the RocksDB provider."""
    rows = events.withWatermark("ts", delay).withColumn("at_ms", F.unix_millis("ts"))
    return rows.groupBy("owner").transformWithStateInPandas(OwnerProcessor(), OUT, "Append", "EventTime")
