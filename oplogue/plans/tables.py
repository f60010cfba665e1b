"""The driver's tables read as logs, lists, receipts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = [f"192.0.2.{i}:7400" for i in range(31, 36)]
ALIVE = ["n0", "n2", "n3"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), "ts")
    kind = F.expr("""case event_type when 'signup' then if(event_id % 3 = 0, 1, 2) when 'view' then 3 when 'purchase' then 4
        when 'error' then if(k % 4 = 0, 6, 5) when 'click' then if(k % 2 = 0, 7, 3) end""")
    num = F.expr("user_id * 8 + event_id % 8")
    return e.select(
        F.concat(F.lit("node"), F.expr("event_id % 5").cast("string")).alias("node"), F.expr("event_id % 5").alias("log_ord"), F.expr("event_id div 5").alias("pos"),
        kind.alias("rec_type"), F.concat(F.lit("j-"), num.cast("string")).alias("job_id"), F.expr("cast(1 + k % 3 as bigint)").alias("epoch"),
        F.expr("cast(k % 4 as bigint)").alias("lease_seq"), F.expr("case when k % 10 < 5 then 1 when k % 10 < 8 then 2 when k % 10 = 8 then 3 else 4 end").alias("copy_state"),
        F.concat(F.lit("k-"), F.expr("if(user_id % 7 = 0, user_id * 8, user_id * 8 + event_id % 8)").cast("string")).alias("idem_key"),
        F.when(kind == 1, F.concat(F.lit("node"), F.expr("event_id % 5").cast("string"))).when(kind.isin(2, 7), F.concat(F.lit("node"), F.expr("k % 5").cast("string"))).alias("owner"),
        F.when(kind.isin(1, 2), F.concat(F.lit("b"), F.col("k").cast("string"))).alias("body"), "ts",
    )


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten orders in a row are lines of one key, so keys grow with the table."""
    n = F.expr("o_orderkey div 10").cast("string")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line_no"), F.concat(F.lit("k-"), n).alias("key"), F.concat(F.lit("j-"), n).alias("id"),
        F.expr("case when o_orderkey % 10 = 0 then '503' when o_orderkey % 3 = 0 then '200' else '201' end").alias("code"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's seventh line stands for a delivery of its key."""
    return read(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.concat(F.lit("k-"), F.expr("l_orderkey div 10").cast("string")).alias("key"))


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is a copy's answer: transaction by order, slot by line number, refused where discounted by 5 % or more."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("txn"), F.expr("cast(l_linenumber % 3 as int)").alias("slot"), (F.col("l_discount") < 0.05).alias("ok"),
        F.expr("cast(1 + l_partkey % 4 as int)").alias("state"), F.expr("l_suppkey % 9").alias("lease_seq"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a job: owner and replica set by customer, the third slot empty for each eleventh."""
    node = lambda i: F.concat(F.lit("n"), F.expr(f"(o_custkey + {i}) % 5").cast("string"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), node(0).alias("owner"), F.array(node(0), node(1), F.when(F.expr("o_orderkey % 11 = 0"), "").otherwise(node(2))).alias("replicas"),
        F.expr("cast(1 + o_orderkey % 4 as int)").alias("state"), F.expr("cast(1 + o_orderkey % 3 as bigint)").alias("epoch"), F.expr("cast(o_custkey % 4 as bigint)").alias("lease_seq"),
        F.lit(3).cast("bigint").alias("max_attempts"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is a message about its order's job, or about one that nobody knows."""
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("if(l_suppkey % 10 = 0, -l_orderkey, l_orderkey)").alias("job_id"), F.concat(F.lit("n"), F.expr("l_suppkey % 5").cast("string")).alias("sender"),
        F.concat(F.lit("n"), F.expr("if(l_partkey % 8 = 0, l_partkey, l_suppkey) % 5").cast("string")).alias("new_owner"), F.expr("cast(1 + l_partkey % 4 as bigint)").alias("epoch"),
        F.expr("l_linenumber % 3 = 0").alias("takeover"), F.expr("cast(1 + l_suppkey % 4 as int)").alias("copy_state"), F.expr("cast(l_linenumber % 5 as bigint)").alias("lease_seq"),
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is an entry of the queue of the node that its supplier stands for."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("n"), F.expr("l_suppkey % 5").cast("string")).alias("node"), F.expr("l_orderkey * 10 + l_linenumber").alias("enq_seq"), F.col("l_orderkey").alias("job_id"),
        F.expr("l_partkey % 97").alias("not_before"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter scrapes, an event each: every instance each 15 s; counters grow by 7 or so and start anew now and then."""
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("node"), F.expr("event_id % 5").cast("string")).alias("instance"), F.expr("event_id * 3").alias("at"),
        F.expr("cast((event_id div 5 * 7 + event_id % 3) % 1000 as double)").alias("value"), F.expr("event_id % 3").alias("shard"),
    )


def bucket_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrapes of a histogram of four buckets, cumulative."""
    e = read(spark, sf_dir, "events").select(
        F.concat(F.lit("node"), F.expr("event_id % 5").cast("string")).alias("instance"), F.expr("event_id * 3").alias("at"), F.expr("event_id div 5").alias("n"),
        F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0), F.lit(1e18))).alias("le"),
    )
    return e.select("instance", "at", "le", F.expr("cast(case le when 0.25 then n * 2 when 0.5 then n * 5 when 1.0 then n * 9 else n * 10 end as double)").alias("value"))


LOG_SQL = """
with e as (select *, cast(json_extract_string(props, '$.k') as int) k from events),
log as (select 'node' || (event_id % 5) node, event_id % 5 log_ord, event_id // 5 pos,
  case event_type when 'signup' then case when event_id % 3 = 0 then 1 else 2 end when 'view' then 3 when 'purchase' then 4
    when 'error' then case when k % 4 = 0 then 6 else 5 end when 'click' then case when k % 2 = 0 then 7 else 3 end end rec_type,
  'j-' || (user_id * 8 + event_id % 8) job_id, cast(1 + k % 3 as bigint) epoch, cast(k % 4 as bigint) lease_seq,
  case when k % 10 < 5 then 1 when k % 10 < 8 then 2 when k % 10 = 8 then 3 else 4 end copy_state,
  'k-' || (case when user_id % 7 = 0 then user_id * 8 else user_id * 8 + event_id % 8 end) idem_key,
  case when event_type = 'signup' and event_id % 3 = 0 then 'node' || (event_id % 5) when event_type = 'signup' or (event_type = 'click' and k % 2 = 0) then 'node' || (k % 5) end owner,
  case when event_type = 'signup' then 'b' || k end body, ts from e),
acc0 as (select o_orderkey line_no, 'k-' || (o_orderkey // 10) key, 'j-' || (o_orderkey // 10) id,
  case when o_orderkey % 10 = 0 then '503' when o_orderkey % 3 = 0 then '200' else '201' end code from orders),
acc as (select key, arg_max(id, line_no) id from acc0 where code in ('200', '201') group by key),
rcp as (select 'k-' || (l_orderkey // 10) key from lineitem where l_linenumber = 7),
dlv as (select key, count(*) n from rcp group by key),
acks as (select l_orderkey txn, cast(l_linenumber % 3 as int) slot, l_discount < 0.05 ok, cast(1 + l_partkey % 4 as int) state, l_suppkey % 9 lease_seq from lineitem),
jobs as (select o_orderkey job_id, 'n' || (o_custkey % 5) owner, ['n' || (o_custkey % 5), 'n' || ((o_custkey + 1) % 5), case when o_orderkey % 11 = 0 then '' else 'n' || ((o_custkey + 2) % 5) end] replicas,
  cast(1 + o_orderkey % 4 as int) state, cast(1 + o_orderkey % 3 as bigint) epoch, cast(o_custkey % 4 as bigint) lease_seq, 3::bigint max_attempts from orders),
msg as (select l_orderkey, l_linenumber, case when l_suppkey % 10 = 0 then -l_orderkey else l_orderkey end job_id, 'n' || (l_suppkey % 5) sender,
  'n' || (case when l_partkey % 8 = 0 then l_partkey else l_suppkey end % 5) new_owner, cast(1 + l_partkey % 4 as bigint) epoch, l_linenumber % 3 = 0 takeover,
  cast(1 + l_suppkey % 4 as int) copy_state, cast(l_linenumber % 5 as bigint) lease_seq from lineitem),
queue as (select 'n' || (l_suppkey % 5) node, l_orderkey * 10 + l_linenumber enq_seq, l_orderkey job_id, l_partkey % 97 not_before from lineitem),
grown as (select *,
  greatest(1, max(case when rec_type in (1, 2, 3, 7) then epoch end) over w) run_epoch, bool_or(rec_type in (1, 2, 4)) over w has_copy
  from log window w as (partition by job_id order by log_ord, pos rows between unbounded preceding and current row)),
cand as (select *, case when rec_type in (1, 2) then copy_state when rec_type = 4 then 3 when rec_type = 6 and has_copy then 4 end st,
  case when rec_type in (4, 6) then greatest(run_epoch, epoch) else epoch end ke, case when rec_type in (4, 6) then 0 else lease_seq end ks from grown),
facts as (select job_id,
  coalesce(cast((list(st order by ke desc, st = 3 desc, st = 4 desc, ks desc, st = 2 desc, log_ord, pos) filter (st is not null))[1] as int), 1) state,
  count(distinct case when rec_type = 4 then lease_seq end) done_seqs, coalesce(max(case when rec_type in (1, 2, 3) then lease_seq end), 0) max_lease_seq,
  greatest(1, coalesce(max(case when rec_type in (1, 2, 3, 7) then epoch end), 1)) max_epoch
  from cand group by job_id having bool_or(rec_type <> 5)),
keys as (select idem_key, count(distinct job_id) n_jobs from log where rec_type in (1, 2) group by 1),
lost as (select key, id, coalesce(state, -1) state, coalesce(state, -1) = 4 dead, coalesce(state, -1) <> 3 lost from acc left join facts on id = job_id),
dup as (select d.key, n, coalesce(n_jobs > 1, false) twin, coalesce(n_jobs > 1, false) or coalesce(max_lease_seq > 1 or max_epoch > 1, false) attributable
  from dlv d left join acc a on d.key = a.key left join facts f on a.id = f.job_id left join keys k on d.key = k.idem_key where n > 1)
"""
