"""Grants, acknowledgements and deduplication of submits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import nack_backoff_ms
from ..schemas import DEAD, LEASED, READY


def next_lease(queue: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Queue entries (node, enq_seq, job_id, not_before) and jobs (job_id, state, owner, ...) -> per node the first
    entry in queue order whose job exists, is ready, is the node's own and is past its back-off."""
    fit = queue.join(jobs, "job_id").where((F.col("state") == READY) & (F.col("owner") == F.col("node")) & (now >= F.col("not_before")))
    rest = [c for c in fit.columns if c not in ("node", "enq_seq")]
    return fit.groupBy("node").agg(F.min(F.struct("enq_seq", *rest)).alias("x")).select("node", "x.*")


def grant(picked: DataFrame, confirmed: Column, can_reach: Column) -> DataFrame:
    """Outcome of a poll for the job picked: no_quorum without reachable copies (nothing is spent), dead_letter once
    attempts are spent, leased where ``confirmed``, else no_quorum with the sequence spent and a back-off."""
    following = F.col("lease_seq") + 1
    spent = following > F.col("max_attempts")
    outcome = F.when(~can_reach, "no_quorum").when(spent, "dead_letter").when(confirmed, "leased").otherwise("no_quorum")
    taken = can_reach & ~spent
    return picked.withColumn("outcome", outcome).withColumn("lease_seq", F.when(taken, following).otherwise(F.col("lease_seq"))).withColumn(
        "back_off_ms", F.when(taken & ~confirmed, nack_backoff_ms(F.col("lease_seq")))
    )


def lease_view(jobs: DataFrame) -> DataFrame:
    """What a worker gets to see of a job it leased."""
    return jobs.select("job_id", "url", "body", "idem_key", "epoch", "lease_seq", "visibility_ms", F.col("lease_seq").alias("attempt"))


def grant_numbers(grants: DataFrame) -> DataFrame:
    """Grants (job_id, log_ord, pos) -> with ``grant_no``, their number within the job."""
    return grants.withColumn("grant_no", F.row_number().over(Window.partitionBy("job_id").orderBy("log_ord", "pos")))


def ack_outcome(tokens: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, tok_epoch, tok_seq) against jobs: current, amnesty (late but not granted again), late_after_park, or
    not_leased. Lateness is judged by the token, not by time."""
    cur = (F.col("state") == LEASED) & (F.col("tok_epoch") <= F.col("epoch")) & (F.col("tok_seq") == F.col("lease_seq"))
    am = (F.col("state") == READY) & ((F.col("tok_epoch") < F.col("epoch")) | ((F.col("tok_epoch") == F.col("epoch")) & (F.col("tok_seq") <= F.col("lease_seq"))))
    park = (F.col("state") == DEAD) & (F.col("tok_epoch") <= F.col("epoch"))
    outcome = (
        F.when(F.col("state").isNull(), "unknown").when(F.col("state") == 3, "already_done").when(cur, "current").when(am, "amnesty").when(park, "late_after_park").otherwise("not_leased")
    )
    return tokens.join(jobs.select("job_id", "state", "epoch", "lease_seq"), "job_id", "left").withColumn("outcome", outcome)


def idem_dedup(submits: DataFrame, order: str) -> DataFrame:
    """(key, ...) -> the id each submit is answered with: the first of its key creates, later ones are duplicates."""
    w = Window.partitionBy("key").orderBy(order)
    return submits.withColumn("job_id", F.first("id").over(w)).withColumn("created", F.row_number().over(w) == 1)
