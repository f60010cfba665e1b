"""Delivery of leased jobs from a stream, at least once, under their idempotency keys."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

#: post(url, headers, body) -> HTTP code, 0 where nothing answered.
Post = Callable[[str, dict, bytes], int]
OUT = "job_id string, epoch bigint, lease_seq bigint, code int, ok boolean, ack_code int, ack_tries int"
ACK_TRIES, ACK_WAIT = 50, 0.2


def deliver(leases: DataFrame, post: Post, ack_url: str, wait: float = ACK_WAIT) -> DataFrame:
    """Leases (job_id, url, idem_key, attempt, epoch, lease_seq, body) -> what came of each.

    The body is posted with its key and attempt as headers; 2xx is success. The outcome is then acknowledged under the
    lease's token, again while the service answers 0 or 503: both calls may be repeated, since keys and tokens are.
    """
    def run(batches):
        import pandas as pd

        for rows in batches:
            out = []
            for r in rows.itertuples():
                code = post(r.url, {"Idempotency-Key": r.idem_key, "Attempt": str(r.attempt)}, bytes(r.body or b""))
                ok = 200 <= code < 300
                target = f"{ack_url}?id={r.job_id}&epoch={r.epoch}&seq={r.lease_seq}&result={'ok' if ok else 'fail'}"
                for tries in range(1, ACK_TRIES + 1):
                    acked = post(target, {}, b"")
                    if acked not in (0, 503):
                        break
                    time.sleep(wait)
                out.append((r.job_id, r.epoch, r.lease_seq, code, ok, acked, tries))
            yield pd.DataFrame(out, columns=["job_id", "epoch", "lease_seq", "code", "ok", "ack_code", "ack_tries"])

    return leases.select("job_id", "url", "idem_key", "attempt", "epoch", "lease_seq", "body").mapInPandas(run, OUT)


def delivery_sink(post: Post, ack_url: str, out: str, wait: float = ACK_WAIT):
    """A ``foreachBatch`` function: delivers a batch and writes its outcomes to ``out``/batch=N, anew if it is rerun."""

    def write(batch: DataFrame, number: int) -> None:
        deliver(batch, post, ack_url, wait).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write
