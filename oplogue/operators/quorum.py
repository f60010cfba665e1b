"""Acknowledgement counts, submit outcomes and repair masks. Only accepted answers count, once a slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def commit_outcome(answers: DataFrame, peers: DataFrame) -> DataFrame:
    """(txn, slot, ok) and (txn, n_peers), the copies asked -> (txn, acks, answered, outcome).

    A write counts itself, so one other copy makes two; without peers it commits alone. It fails once every copy asked
    has answered and none accepted, and is pending until then.
    """
    got = answers.groupBy("txn").agg(
        F.count_distinct(F.when(F.col("ok"), F.col("slot"))).alias("acks"), F.count_distinct("slot").alias("answered")
    )
    j = peers.join(got, "txn", "left").select("txn", "n_peers", F.coalesce("acks", F.lit(0)).alias("acks"), F.coalesce("answered", F.lit(0)).alias("answered"))
    needed = F.when(F.col("n_peers") > 0, 1).otherwise(0)
    outcome = F.when(F.col("acks") >= needed, "created").when(F.col("answered") >= F.col("n_peers"), "no_quorum").otherwise("pending")
    return j.select("txn", "acks", "answered", outcome.alias("outcome"))


def confirmed_mask(acks: DataFrame, want: Column) -> DataFrame:
    """Bit mask of slots that confirmed, and whether all wanted ones did."""
    bit = F.when(F.col("ok"), F.expr("shiftleft(1, slot)")).otherwise(0)
    return acks.groupBy("txn").agg(F.bit_or(bit).cast("int").alias("mask")).withColumn("complete", F.col("mask").bitwiseAND(want) == want)


def repair_backlog(masks: DataFrame) -> DataFrame:
    return masks.agg(F.count_if(~F.col("complete")).alias("backlog"))


def resend(masks: DataFrame, jobs: DataFrame, self_node: Column, alive: Column) -> DataFrame:
    """(txn, slot, peer) still to be confirmed: jobs that the node owns, at peers that are alive."""
    j = masks.select("txn", "mask").join(jobs.where(F.col("owner") == self_node).select(F.col("job_id").alias("txn"), "replicas"), "txn")
    each = j.select("txn", "mask", F.posexplode("replicas").alias("slot", "peer"))
    return each.where((F.col("peer") != "") & (F.col("peer") != self_node) & F.array_contains(alive, F.col("peer")) & (F.expr("mask & shiftleft(1, slot)") == 0)).select("txn", "slot", "peer")


def completion_again(done: DataFrame, backlog: DataFrame) -> DataFrame:
    """A repeated completion (job_id): confirmed only if no copy is still to be repaired."""
    return done.join(backlog.select("job_id", F.lit(True).alias("open")), "job_id", "left").select("job_id", F.when(F.col("open"), "no_quorum").otherwise("ok").alias("status"))


def slot_of(replicas: Column, node: Column) -> Column:
    """Slot of a responder, from 0; null for a node outside the set."""
    at = F.array_position(replicas, node)
    return F.when(at > 0, at - 1)


def peer_slots(jobs: DataFrame, self_node: Column) -> DataFrame:
    """One row for each copy held elsewhere: (job_id, slot, peer)."""
    return jobs.select("*", F.posexplode("replicas").alias("slot", "peer")).where((F.col("peer") != self_node) & (F.col("peer") != ""))
