"""Fences, claims and hand-offs: which messages a node may act on, and what a new owner makes of the answers it got."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import state_rank
from ..schemas import DEAD, FINISHED, LEASED
from .merge import advance_key

CREATED, INVALID, UNKNOWN, STALE, NOT_OWNER = "created", "invalid", "unknown_job", "stale_epoch", "not_owner"


def peers(replicas: Column, self_node: Column) -> Column:
    """Copies held elsewhere: neither empty nor this node."""
    return F.filter(replicas, lambda r: (r != "") & (r != self_node))


def active(state: Column) -> Column:
    """Neither done nor a dead letter."""
    return ~state.isin(FINISHED, DEAD)


def reachable(replicas: Column, self_node: Column, alive: Column) -> Column:
    """Some peer is alive, or there is none to ask."""
    others = peers(replicas, self_node)
    return (F.size(others) == 0) | F.exists(others, lambda r: F.array_contains(alive, r))


def without_self(alive: Column, self_node: Column) -> Column:
    return F.array_except(alive, F.array(self_node))


def with_self(alive: Column, self_node: Column) -> Column:
    return F.array_union(F.array(self_node), alive)


def apply_outcome(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, sender, epoch, takeover) against the receiver's jobs (job_id, owner, epoch) -> with ``status``.

    A lower epoch is fenced; a record of the same or a later one comes from the owner or is a takeover.
    """
    own = jobs.select("job_id", F.col("owner").alias("known_owner"), F.col("epoch").alias("known_epoch"))
    status = (
        F.when(F.col("known_epoch").isNull(), UNKNOWN).when(F.col("epoch") < F.col("known_epoch"), STALE)
        .when((F.col("sender") != F.col("known_owner")) & ~F.col("takeover"), NOT_OWNER).otherwise(CREATED)
    )
    return messages.join(own, "job_id", "left").withColumn("status", status).drop("known_owner", "known_epoch")


def fenced(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """How many messages the epoch fence stopped."""
    return outcomes.groupBy(*by).agg(F.count_if(F.col("status") == STALE).alias("fenced_stale"))


def replicate_outcome(copies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Copies (job_id, epoch, copy_state, lease_seq) sent to a node: stale below its epoch, else taken into the log;
    ``adopted`` where the copy also replaces the node's own."""
    own = jobs.select("job_id", *(F.col(c).alias(f"known_{c}") for c in ("epoch", "state", "lease_seq")))
    newer = advance_key(F.col("epoch"), F.col("copy_state"), F.col("lease_seq")) > advance_key(F.col("known_epoch"), F.col("known_state"), F.col("known_lease_seq"))
    stale = F.coalesce(F.col("epoch") < F.col("known_epoch"), F.lit(False))
    j = copies.join(own, "job_id", "left").withColumn("status", F.when(stale, STALE).otherwise(CREATED))
    return j.withColumn("adopted", ~stale & (F.col("known_epoch").isNull() | newer)).drop("known_epoch", "known_state", "known_lease_seq")


def claim_outcome(claims: DataFrame, jobs: DataFrame) -> DataFrame:
    """Claims (job_id, sender, new_owner, proposed) -> with ``status`` and ``takeover``, whether a record is written.

    A claim is made in the first person, by a member of the job's replica set; a lower epoch, or the same one by another
    owner, is stale; the same one by the same owner is granted again.
    """
    own = jobs.select("job_id", F.col("replicas").alias("known_replicas"), F.col("owner").alias("known_owner"), F.col("epoch").alias("known_epoch"))
    behind = (F.col("proposed") < F.col("known_epoch")) | ((F.col("proposed") == F.col("known_epoch")) & (F.col("known_owner") != F.col("new_owner")))
    status = (
        F.when(F.col("sender") != F.col("new_owner"), INVALID).when(F.col("known_epoch").isNull(), UNKNOWN)
        .when(~F.array_contains("known_replicas", F.col("new_owner")), NOT_OWNER).when(behind, STALE).otherwise(CREATED)
    )
    j = claims.join(own, "job_id", "left").withColumn("status", status)
    takeover = (F.col("status") == CREATED) & (F.col("proposed") > F.col("known_epoch"))
    return j.withColumn("takeover", takeover).drop("known_replicas", "known_owner", "known_epoch")


def takeover_action(merged: DataFrame, jobs: DataFrame) -> DataFrame:
    """What a new owner records after its claim: merged (job_id, best_state, best_seq) over its own copy -> (job_id,
    action, lease_seq, wait): done, dead_letter, lease (inherited) or none; ``wait`` where one visibility window passes
    before the job can be granted again."""
    m, mine = F.col("best_state"), F.col("state")
    done = (m == FINISHED) & (mine != FINISHED)
    dead = ~done & (m == DEAD) & active(mine)
    inherits = ~done & ~dead & ((m == LEASED) | (F.col("best_seq") > F.col("lease_seq")))
    writes = inherits & ((mine != LEASED) | (F.col("lease_seq") < F.col("best_seq")))
    action = F.when(done, "done").when(dead, "dead_letter").when(writes, "lease").otherwise("none")
    seq = F.when(writes, F.greatest("best_seq", "lease_seq")).otherwise(F.col("lease_seq"))
    wait = inherits | (~done & ~dead & (mine == LEASED))
    return merged.join(jobs.select("job_id", "state", "lease_seq"), "job_id").select("job_id", action.alias("action"), seq.alias("lease_seq"), wait.alias("wait"))


def resync(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(job_id, epoch, state, lease_seq, owner) copies: each local job after it adopted the most advanced remote copy
    that advances it; ``adopted`` tells where it did."""
    key = lambda: advance_key(F.col("epoch"), F.col("state"), F.col("lease_seq"))
    best = remote.groupBy("job_id").agg(F.max_by(F.struct("epoch", "state", "lease_seq", "owner"), F.struct(key().alias("k"), "owner")).alias("r"))
    j = local.join(best, "job_id", "left")
    r = lambda c: F.col(f"r.{c}")
    adopted = F.coalesce(advance_key(r("epoch"), r("state"), r("lease_seq")) > key(), F.lit(False))
    return j.select("job_id", *(F.when(adopted, r(c)).otherwise(F.col(c)).alias(c) for c in ("epoch", "state", "lease_seq", "owner")), adopted.alias("adopted"))


def takeover_targets(jobs: DataFrame, dead: Column, alive: Column) -> DataFrame:
    """Active jobs of nodes that died -> (job_id, successor, proposed): the first alive replica claims the next epoch."""
    successor = F.try_element_at(F.filter("replicas", lambda r: F.array_contains(alive, r)), F.lit(1))
    return jobs.where(active(F.col("state")) & F.array_contains(dead, F.col("owner"))).select(
        "job_id", successor.alias("successor"), (F.col("epoch") + 1).alias("proposed")
    )


def drain_plan(jobs: DataFrame, self_node: Column, alive: Column) -> DataFrame:
    """(job_id, to) for each active job of a draining node: the first alive other copy is asked to claim it, if any."""
    to = F.try_element_at(F.filter(peers(F.col("replicas"), self_node), lambda r: F.array_contains(alive, r)), F.lit(1))
    return jobs.where((F.col("owner") == self_node) & active(F.col("state"))).select("job_id", to.alias("to"))


def drained(plan: DataFrame) -> DataFrame:
    """One row: jobs that remain, and whether the drain is complete."""
    return plan.agg(F.count("*").alias("remaining")).withColumn("complete", F.col("remaining") == 0)


def merged_answers(answers: DataFrame, jobs: DataFrame, set_size: int) -> DataFrame:
    """Claim answers (job_id, slot, status, state, lease_seq) and the claimer's own copies -> (job_id, best_seq,
    best_state, slots, granted). Only accepted answers count, once a slot; the largest sequence and the strongest state
    are taken apart from each other, own copy included; a majority of the set, the claimer among it, grants."""
    ok = F.col("status") == CREATED
    got = answers.groupBy("job_id").agg(
        F.max(F.when(ok, F.col("lease_seq"))).alias("seq"), F.max_by("state", F.when(ok, state_rank(F.col("state")))).alias("st"),
        F.count_distinct(F.when(ok, F.col("slot"))).alias("slots"),
    )
    better = F.coalesce(state_rank(F.col("st")) > state_rank(F.col("state")), F.lit(False)) & F.col("seq").isNotNull()
    return jobs.select("job_id", "state", "lease_seq").join(got, "job_id").select(
        "job_id", F.greatest("seq", "lease_seq").alias("best_seq"), F.when(better, F.col("st")).otherwise(F.col("state")).alias("best_state"),
        "slots", (F.col("slots") >= set_size // 2).alias("granted"),
    )
