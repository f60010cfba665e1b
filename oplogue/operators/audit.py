"""Offline audit: nothing accepted is lost, each job is completed once, every duplicate delivery has a cause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DEAD, FINISHED
from .merge import job_facts, key_jobs


def accepted_keys(accepted: DataFrame) -> DataFrame:
    """Accepted submits, the last line of a key: (key, id)."""
    return accepted.where(F.col("code").isin("200", "201")).groupBy("key").agg(F.max_by("id", "line_no").alias("id"))


def deliveries(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("key").agg(F.count("*").alias("n"))


def lost(accepted: DataFrame, facts: DataFrame, allow_dlq: bool = False) -> DataFrame:
    """(key, id, state, dead, lost) of every accepted key; state -1 where no log knows the job."""
    j = accepted.join(facts.select(F.col("job_id").alias("id"), "state"), "id", "left").withColumn("state", F.coalesce("state", F.lit(-1)))
    fine = (F.col("state") == FINISHED) | (F.lit(allow_dlq) & (F.col("state") == DEAD))
    return j.select("key", "id", "state", (F.col("state") == DEAD).alias("dead"), (~fine).alias("lost"))


def double_done(facts: DataFrame) -> DataFrame:
    return facts.where("done_seqs > 1").select("job_id", "done_seqs")


def duplicates(delivered: DataFrame, accepted: DataFrame, facts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, twin, attributable) of keys delivered more than once."""
    known = accepted.join(facts.select(F.col("job_id").alias("id"), "max_lease_seq", "max_epoch"), "id").select("key", "max_lease_seq", "max_epoch")
    twins = keys.select(F.col("idem_key").alias("key"), "n_jobs")
    twin = F.coalesce(F.col("n_jobs") > 1, F.lit(False))
    cause = F.coalesce((F.col("max_lease_seq") > 1) | (F.col("max_epoch") > 1), F.lit(False))
    return delivered.where("n > 1").join(known, "key", "left").join(twins, "key", "left").select("key", "n", twin.alias("twin"), (twin | cause).alias("attributable"))


def summary(log: DataFrame, accepted: DataFrame, receipts: DataFrame, allow_dlq: bool = False) -> DataFrame:
    """The one-row verdict. Jobs, keys and deliveries become one line of facts, counted together."""
    facts, keys, acc, got = job_facts(log), key_jobs(log), accepted_keys(accepted), deliveries(receipts)
    named = acc.groupBy("id").agg(F.collect_list("key").alias("keys"))  # one key, but for odd lists
    by_job = facts.select(F.col("job_id").alias("id"), "state", "done_seqs", "max_lease_seq", "max_epoch").join(named, "id", "full")
    by_job = by_job.select("*", F.posexplode_outer("keys").alias("nth", "key"))
    once = F.coalesce(F.col("nth"), F.lit(0)) == 0
    known = by_job.select(
        "key", (once & F.col("done_seqs").isNotNull()).alias("is_job"), (once & (F.col("done_seqs") > 1)).alias("double"), F.coalesce("state", F.lit(-1)).alias("state"),
        F.coalesce((F.col("max_lease_seq") > 1) | (F.col("max_epoch") > 1), F.lit(False)).alias("cause"),
    )
    twins = keys.select(F.col("idem_key").alias("key"), "n_jobs").where("n_jobs > 1")
    # Per key: whether it was accepted, what became of its job, how often it was delivered, and whether it has twins.
    marks = (
        known.select("key", F.when(F.col("key").isNotNull(), 1).otherwise(0).alias("accepted"), "is_job", "double", "state", "cause", F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("twin"))
        .union(got.select("key", F.lit(0), F.lit(False), F.lit(False), F.lit(None).cast("int"), F.lit(False), "n", F.lit(False)))
        .union(twins.select("key", F.lit(0), F.lit(False), F.lit(False), F.lit(None).cast("int"), F.lit(False), F.lit(0).cast("bigint"), F.lit(True)))
    )
    fine = (F.col("state") == FINISHED) | (F.lit(allow_dlq) & (F.col("state") == DEAD))
    each = marks.groupBy("key").agg(
        F.max("accepted").alias("accepted"), F.count_if("is_job").alias("jobs"), F.count_if("double").alias("doubles"),
        F.count_if((F.col("accepted") == 1) & ~fine).alias("lost"), F.count_if((F.col("accepted") == 1) & (F.col("state") == DEAD)).alias("dead"),
        F.max("cause").alias("cause"), F.sum("n").alias("n"), F.max("twin").alias("twin"),
    )
    real, again = F.col("key").isNotNull(), F.col("n") > 1
    total = each.agg(
        F.coalesce(F.sum("accepted"), F.lit(0)).cast("bigint").alias("accepted"), F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"), F.coalesce(F.sum("dead"), F.lit(0)).alias("dead_letter"),
        F.count_if(F.col("n") > 0).alias("delivered_keys"), F.coalesce(F.sum(F.when(again, F.col("n") - 1)), F.lit(0)).cast("bigint").alias("duplicate_deliveries"),
        F.count_if(again & F.col("twin")).alias("fallback_twins"), F.count_if(again & ~F.col("twin") & ~(real & F.col("cause") & (F.col("accepted") == 1))).alias("unexplained"),
        F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs_seen"), F.coalesce(F.sum("doubles"), F.lit(0)).alias("double_done"),
    )
    logs = log.agg(F.count_distinct("log_ord").alias("logs"))
    rows = logs.join(F.broadcast(total), F.lit(True))  # one row each
    return rows.withColumn("passed", (F.col("lost") == 0) & (F.col("double_done") == 0) & (F.col("unexplained") == 0))


def verdict_line(summary_row: DataFrame) -> DataFrame:
    """The verdict as a line of text with its exit code."""
    said = F.format_string("%s: accepted=%d lost=%d dead_letter=%d double_done=%d unexplained=%d", F.when(F.col("passed"), "PASS").otherwise("FAIL"), "accepted", "lost", "dead_letter", "double_done", "unexplained")
    return summary_row.select(said.alias("line"), F.when(F.col("passed"), 0).otherwise(1).alias("exit_code"))
