"""Merge order of job copies and the state that an audit of all logs ends with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DEAD, DEAD_LETTER, DONE, FINISHED, LEASE, LEASED, READY, REPLICATE, SUBMIT, TAKEOVER


def advance_key(epoch: Column, state: Column, seq: Column) -> Column:
    """A copy replaces another iff its key is strictly greater."""
    return F.struct(epoch.alias("epoch"), (state == FINISHED).alias("done"), (state == DEAD).alias("dead"), seq.alias("seq"), (state == LEASED).alias("leased"))


def first_seen(*order: str) -> list[Column]:
    """Ties keep the copy that comes first in log order."""
    return [(-F.col(c)).alias(f"before_{c}") for c in order]


def merge_latest_copy(log: DataFrame) -> DataFrame:
    """Most advanced full copy of each job: (job_id, epoch, lease_seq, state)."""
    key = F.struct(advance_key(F.col("epoch"), F.col("copy_state"), F.col("lease_seq")).alias("k"), *first_seen("log_ord", "pos"))
    best = F.max_by(F.struct("epoch", "lease_seq", F.col("copy_state").alias("state")), key)
    return log.where(F.col("rec_type").isin(SUBMIT, REPLICATE)).groupBy("job_id").agg(best.alias("c")).select("job_id", "c.*")


def job_facts(log: DataFrame) -> DataFrame:
    """Per job: final state by the order-dependent audit fold, distinct completions, largest grant and epoch.

    Completions and dead letters act as copies at the largest epoch seen so far in log order, so one window gives each
    record what came before it; the fold is then an argmax over copies and markers.
    """
    so_far = Window.partitionBy("job_id").orderBy("log_ord", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.col("rec_type")
    grown = log.withColumn("run_epoch", F.greatest(F.lit(1), F.max(F.when(kind.isin(SUBMIT, REPLICATE, LEASE, TAKEOVER), F.col("epoch"))).over(so_far))).withColumn(
        "has_copy", F.max(kind.isin(SUBMIT, REPLICATE, DONE)).over(so_far)
    )
    at = F.greatest("run_epoch", "epoch")
    state = F.when(kind.isin(SUBMIT, REPLICATE), F.col("copy_state")).when(kind == DONE, FINISHED).when((kind == DEAD_LETTER) & F.col("has_copy"), DEAD)
    marker = kind.isin(DONE, DEAD_LETTER)
    key = F.struct(
        advance_key(F.when(marker, at).otherwise(F.col("epoch")), state, F.when(marker, 0).otherwise(F.col("lease_seq"))).alias("k"), *first_seen("log_ord", "pos")
    )
    return grown.groupBy("job_id").agg(
        F.coalesce(F.max_by(state, F.when(state.isNotNull(), key)), F.lit(READY)).cast("int").alias("state"),
        F.count_distinct(F.when(kind == DONE, F.col("lease_seq"))).alias("done_seqs"),
        F.coalesce(F.max(F.when(kind.isin(SUBMIT, REPLICATE, LEASE), F.col("lease_seq"))), F.lit(0)).alias("max_lease_seq"),
        F.greatest(F.coalesce(F.max(F.when(kind.isin(SUBMIT, REPLICATE, LEASE, TAKEOVER), F.col("epoch"))), F.lit(1)), F.lit(1)).alias("max_epoch"),
        F.max(kind != 5).alias("seen"),
    ).where("seen").drop("seen")


def idempotency_index(log: DataFrame) -> DataFrame:
    """Key -> job of the last submit or copy, adopted or not."""
    return log.where(F.col("rec_type").isin(SUBMIT, REPLICATE)).groupBy("idem_key").agg(F.max_by("job_id", F.struct("log_ord", "pos")).alias("job_id"))


def key_jobs(log: DataFrame) -> DataFrame:
    return log.where(F.col("rec_type").isin(SUBMIT, REPLICATE)).groupBy("idem_key").agg(F.count_distinct("job_id").alias("n_jobs"))
