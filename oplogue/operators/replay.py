"""The deterministic fold of one node's log into its job table, inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEAD, DEAD_LETTER, DONE, EXPIRE, FINISHED, LEASE, LEASED, READY, REPLICATE, SUBMIT, TAKEOVER
from .merge import advance_key

NONE = "struct<state:int,epoch:bigint,lease_seq:bigint,attempts:bigint,owner:string,body:string>"


def _step(job: Column, r: Column) -> Column:
    kind, exists = r["rec_type"], job["state"].isNotNull()
    fresh = exists & (r["epoch"] >= job["epoch"])

    def made(state, epoch, seq, attempts, owner, body):
        return F.struct(
            state.cast("int").alias("state"), epoch.alias("epoch"), seq.alias("lease_seq"), attempts.alias("attempts"), owner.alias("owner"), body.alias("body")
        )

    copy = made(r["copy_state"], r["epoch"], r["lease_seq"], r["lease_seq"], r["owner"], r["body"])
    keep = [job["epoch"], job["lease_seq"], job["attempts"], job["owner"], job["body"]]
    newer = advance_key(r["epoch"], r["copy_state"], r["lease_seq"]) > advance_key(job["epoch"], job["state"], job["lease_seq"])
    return (
        F.when(kind == SUBMIT, copy)
        .when((kind == REPLICATE) & (~exists | newer), copy)
        .when((kind == LEASE) & fresh & ~job["state"].isin(FINISHED, DEAD), made(F.lit(LEASED), r["epoch"], r["lease_seq"], r["lease_seq"], *keep[3:]))
        .when((kind == DONE) & fresh & (job["state"] != FINISHED), made(F.lit(FINISHED), r["epoch"], *keep[1:4], F.lit("")))
        .when((kind == EXPIRE) & fresh & (job["state"] == LEASED) & (r["lease_seq"] == job["lease_seq"]), made(F.lit(READY), r["epoch"], *keep[1:]))
        .when((kind == DEAD_LETTER) & fresh & (job["state"] != FINISHED), made(F.lit(DEAD), r["epoch"], *keep[1:]))
        .when((kind == TAKEOVER) & exists & (r["epoch"] > job["epoch"]), made(job["state"], r["epoch"], *keep[1:3], r["owner"], job["body"]))
        .otherwise(job)
    )


def replay(log: DataFrame) -> DataFrame:
    """(node, job_id, state, epoch, lease_seq, attempts, owner, body) after each node's records in log order.

    ``owner`` of a record is that of the copy, or the new one of a takeover; a completion clears the body. A job's records
    on one node are folded by a higher-order function over their array: the queue itself holds them in memory too, and
    grants are bounded by ``max_attempts``.
    """
    rec = F.struct("pos", "rec_type", "epoch", "lease_seq", "copy_state", "owner", "body")
    return log.groupBy("node", "job_id").agg(F.array_sort(F.collect_list(rec)).alias("records")).select(
        "node", "job_id", F.aggregate("records", F.lit(None).cast(NONE), _step).alias("job")
    ).where("job.state is not null").select("node", "job_id", "job.*")


def owned(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("owner") == F.col("node"))


def queue_depth(jobs: DataFrame) -> DataFrame:
    """Jobs that each node owns, by state."""
    return owned(jobs).groupBy("node", "state").agg(F.count("*").alias("n"))


def misplaced(log: DataFrame) -> DataFrame:
    """Records whose own LSN differs from their place in the log."""
    return log.where(F.col("lsn") != F.col("pos"))


def counters(log: DataFrame) -> DataFrame:
    """Event counters that the log itself shows, per node."""
    kind = F.col("rec_type")
    names = {"submits": SUBMIT, "replicas": REPLICATE, "grants": LEASE, "completions": DONE, "expirations": EXPIRE, "dead_letters": DEAD_LETTER, "takeovers": TAKEOVER}
    return log.groupBy("node").agg(*(F.count_if(kind == k).alias(n) for n, k in names.items()))
