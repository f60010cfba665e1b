"""Registered queries: each runs an operator over whole tables; ORACLES holds the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, text
from ..operators import audit, fences, leases, loads, merge, metrics, placement, quorum, replay, requests
from ..sources import text as lines
from . import tables as t
from .tables import LOG_SQL, NODES

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(LOG_SQL + """select (select count(distinct log_ord) from log) logs, (select count(*) from acc) accepted,
  (select count(*) from lost where lost) lost, (select count(*) from lost where dead) dead_letter,
  (select count(*) from dlv) delivered_keys, (select cast(coalesce(sum(n - 1), 0) as bigint) from dlv) duplicate_deliveries,
  (select count(*) from dup where twin) fallback_twins, (select count(*) from dup where not attributable) unexplained,
  (select count(*) from facts) jobs_seen, (select count(*) from facts where done_seqs > 1) double_done,
  (select count(*) from lost where lost) = 0 and (select count(*) from facts where done_seqs > 1) = 0
    and (select count(*) from dup where not attributable) = 0 passed""")
def audit_summary(spark, d):
    return audit.summary(t.log_records(spark, d), t.accepted(spark, d), t.receipts(spark, d))


@query(LOG_SQL + "select key, id, state, dead, lost from lost")
def audit_lost(spark, d):
    return audit.lost(audit.accepted_keys(t.accepted(spark, d)), merge.job_facts(t.log_records(spark, d)))


@query(LOG_SQL + "select key, id, state from lost where lost order by key limit 10")
def audit_first_lost(spark, d):
    return audit_lost(spark, d).where("lost").select("key", "id", "state").orderBy("key").limit(10)


@query(LOG_SQL + "select job_id, done_seqs from facts where done_seqs > 1")
def audit_double_done(spark, d):
    return audit.double_done(merge.job_facts(t.log_records(spark, d)))


@query(LOG_SQL + "select key, n, twin, attributable from dup")
def audit_duplicates(spark, d):
    log = t.log_records(spark, d)
    return audit.duplicates(audit.deliveries(t.receipts(spark, d)), audit.accepted_keys(t.accepted(spark, d)), merge.job_facts(log), merge.key_jobs(log))


@query(LOG_SQL + "select job_id, state, done_seqs, max_lease_seq, max_epoch from facts")
def verifier_state(spark, d):
    return merge.job_facts(t.log_records(spark, d))


@query(LOG_SQL + """select job_id, epoch, lease_seq, copy_state state from (select *, row_number() over (partition by job_id
  order by epoch desc, copy_state = 3 desc, copy_state = 4 desc, lease_seq desc, copy_state = 2 desc, log_ord, pos) r from log where rec_type in (1, 2)) where r = 1""")
def merge_latest_copy(spark, d):
    return merge.merge_latest_copy(t.log_records(spark, d))


@query(LOG_SQL + "select idem_key, n_jobs from keys where n_jobs > 1")
def idem_twins(spark, d):
    return merge.key_jobs(t.log_records(spark, d)).where("n_jobs > 1")


@query(LOG_SQL + "select idem_key, (list(job_id order by log_ord desc, pos desc))[1] job_id from log where rec_type in (1, 2) group by 1")
def idem_index(spark, d):
    return merge.idempotency_index(t.log_records(spark, d))


_NONE = "'c': 0, 'n': '', 'b': ''"
_JOB = lambda e, s, st, at, o, b: f"{{'pos': r.pos, 't': 0, 'e': {e}, 's': {s}, 'c': 0, 'n': '', 'b': {b}, 'st': {st}, 'at': {at}, 'o': {o}}}"
REPLAY_SQL = LOG_SQL + f""", folded as (select node, job_id, list_reduce(list_prepend(
  {{'pos': cast(-1 as bigint), 't': 0, 'e': cast(0 as bigint), 's': cast(0 as bigint), {_NONE}, 'st': cast(0 as int), 'at': cast(0 as bigint), 'o': ''}},
  list({{'pos': pos, 't': rec_type, 'e': epoch, 's': lease_seq, 'c': copy_state, 'n': owner, 'b': body, 'st': cast(0 as int), 'at': cast(0 as bigint), 'o': ''}} order by pos)),
  lambda j, r: case
    when r.t = 1 or (r.t = 2 and (j.st = 0 or (r.e, r.c = 3, r.c = 4, r.s, r.c = 2) > (j.e, j.st = 3, j.st = 4, j.s, j.st = 2))) then {_JOB("r.e", "r.s", "r.c", "r.s", "r.n", "r.b")}
    when r.t = 3 and j.st in (1, 2) and r.e >= j.e then {_JOB("r.e", "r.s", "2", "r.s", "j.o", "j.b")}
    when r.t = 4 and j.st in (1, 2, 4) and r.e >= j.e then {_JOB("r.e", "j.s", "3", "j.at", "j.o", "''")}
    when r.t = 5 and j.st = 2 and r.e >= j.e and r.s = j.s then {_JOB("r.e", "j.s", "1", "j.at", "j.o", "j.b")}
    when r.t = 6 and j.st in (1, 2, 4) and r.e >= j.e then {_JOB("r.e", "j.s", "4", "j.at", "j.o", "j.b")}
    when r.t = 7 and j.st > 0 and r.e > j.e then {_JOB("r.e", "j.s", "j.st", "j.at", "r.n", "j.b")}
    else j end) j from log group by node, job_id),
held as (select node, job_id, j.st state, j.e epoch, j.s lease_seq, j.at attempts, j.o owner, j.b body from folded where j.st > 0)
"""


@query(REPLAY_SQL + "select * from held")
def replay_jobs(spark, d):
    return replay.replay(t.log_records(spark, d))


@query(REPLAY_SQL + "select node, state, count(*) n from held where owner = node group by 1, 2")
def queue_depth(spark, d):
    return replay.queue_depth(replay.replay(t.log_records(spark, d)))


@query(LOG_SQL + """select node, count(*) filter (rec_type = 1) submits, count(*) filter (rec_type = 2) replicas, count(*) filter (rec_type = 3) grants,
  count(*) filter (rec_type = 4) completions, count(*) filter (rec_type = 5) expirations, count(*) filter (rec_type = 6) dead_letters,
  count(*) filter (rec_type = 7) takeovers from log group by node""")
def counters(spark, d):
    return replay.counters(t.log_records(spark, d))


@query("""select o_orderkey, o_custkey, first_value(o_orderkey) over w job_id, row_number() over w = 1 created from orders window w as (partition by o_custkey order by o_orderkey)""")
def idem_dedup(spark, d):
    s = t.read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"))
    return leases.idem_dedup(s, "o_orderkey").select("o_orderkey", "o_custkey", "job_id", "created")


HIST_SQL = """with b as (select case when i < 17 then 0.001::double * pow(2.0, i) else 1e18 end le from range(18) r(i)),
v as (select 'node' || (user_id % 5) instance, value / 1000 secs from events),
own as (select instance, min(le) le from (select instance, v.rowid_ , le from (select *, row_number() over () rowid_ from v) v join b on secs <= le) group by instance, rowid_),
cnt as (select instance, le, count(*) n from own group by 1, 2),
h as (select i.instance, b.le, coalesce(n, 0) n from (select distinct instance from v) i cross join b left join cnt c on c.instance = i.instance and c.le = b.le),
hist as (select instance, le, n, cast(sum(n) over (partition by instance order by le) as bigint) cum from h),
prev as (select *, lag(le, 1, 0) over w prev_le, lag(cum, 1, 0) over w prev_cum, max(cum) over (partition by instance) total from hist window w as (partition by instance order by le)),
qs as (select *, q * total target from prev cross join (values (0.5::double), (0.95::double), (0.99::double)) t(q))
"""


def _seconds(spark, d):
    return t.read(spark, d, "events").select(F.concat(F.lit("node"), F.expr("user_id % 5").cast("string")).alias("instance"), (F.col("value") / 1000).alias("seconds"))


@query(HIST_SQL + "select instance, le, n, cum from hist")
def latency_hist(spark, d):
    return metrics.histogram(_seconds(spark, d), ["instance"])


@query("select 'node' || (user_id % 5) instance, count(*) \"count\", round(sum(value / 1000), 6) \"sum\" from events group by 1")
def latency_totals(spark, d):
    return metrics.totals(_seconds(spark, d), ["instance"]).select("instance", "count", F.round("sum", 6).alias("sum"))


SCRAPE_SQL = """with b as (select o_custkey % 7 run, o_orderkey % 5 node, case when o_orderkey % 13 = 0 then 503 else 200 end code, round(o_totalprice)::bigint % 100 n, o_orderkey from orders),
c as (select run, node, code, le, case le when 0.25 then n // 3 when 0.5 then n // 2 else n end cum, n + 1 total from b, (values (0.25::double), (0.5::double), (1.0::double)) v(le)),
s as (select run, le, sum(cum)::bigint cum, sum(total)::bigint total from c where code = 200 group by run, le),
"""


def _scrapes(spark, d):
    b = t.read(spark, d, "orders").select(
        F.expr("o_custkey % 7").alias("run"), F.expr("o_orderkey % 5").alias("node"), F.expr("if(o_orderkey % 13 = 0, 503, 200)").alias("code"), F.expr("cast(round(o_totalprice) as bigint) % 100").alias("n"),
    )
    return b.select("*", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0))).alias("le")).withColumn("cum", F.expr("case le when 0.25 then n div 3 when 0.5 then n div 2 else n end"))


@query(SCRAPE_SQL.rstrip(",\n") + " select run, le, cum from s")
def scrape_sums(spark, d):
    return metrics.sum_scrapes(_scrapes(spark, d), ["run"])


@query("select o_custkey % 7 run, count(*) filter (o_orderkey % 13 = 0) unreachable from orders group by 1")
def unreachable_nodes(spark, d):
    return metrics.unreachable(_scrapes(spark, d).where("le = 0.25"), ["run"])


@query(SCRAPE_SQL + """p as (select *, lag(le, 1, 0.0) over w prev_le, lag(cum, 1, 0) over w prev_cum from s window w as (partition by run order by le)),
x as (select *, q * total target from p, (values (0.5::double), (0.99::double), (1.0::double)) v(q))
select run, q, coalesce(arg_min((prev_le + (le - prev_le) * case when cum - prev_cum <= 0 then 1.0 else (target - prev_cum) / (cum - prev_cum) end) * 1000.0, le) filter (cum >= target), max(le) * 1000.0) "value"
  from x group by run, q""")
def count_quantiles(spark, d):
    s = _scrapes(spark, d)
    counts = s.where("le = 0.25 and code = 200").groupBy("run").agg(F.sum(F.col("n") + 1).alias("count"))
    return metrics.quantiles(metrics.sum_scrapes(s, ["run"]), ["run"], [0.5, 0.99, 1.0], counts=counts)


@query("""select o_orderstatus, count(*) offered, count(*) filter (o_orderkey % 10 <> 0) accepted, count(*) filter (o_orderkey % 10 = 0) errors from orders group by 1""")
def load_tally(spark, d):
    rows = t.read(spark, d, "orders").select("o_orderstatus", F.expr("case when o_orderkey % 10 = 0 then '503' when o_orderkey % 3 = 0 then '200' else '201' end").alias("code"))
    return loads.tally(rows, ["o_orderstatus"])


@query("""select (i % 4)::int thread, i // 4 n, ((i // 4) * 1000 * 4 / 50)::bigint due_ms, 'load-' || (i % 4) || '-' || (i // 4) "key", (((i % 4) + (i // 4)) % 3)::int gateway from range(500) r(i)""")
def load_plan(spark, d):
    return loads.plan(spark, 50, 10, 4, 3)


@query("""select user_id % 5 node, count(*) filter (was is not null and was <> alive) churn from (select *, lag(alive) over (partition by user_id order by event_id) was
  from (select user_id, event_id, event_id % 7 < 4 alive from events)) group by 1""")
def membership_churn(spark, d):
    e = t.read(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("at"), F.expr("event_id % 7 < 4").alias("alive"), F.expr("user_id % 5").alias("of"))
    return loads.churn(e, ["of"]).withColumnRenamed("of", "node")


@query("""select o_orderkey, printf('{"id":"%s","state":"%s","epoch":%d,"attempts":%d,"owner":"%s"}', 'j-' || o_orderkey, ['ready', 'leased', 'done', 'dead_letter'][1 + o_orderkey % 4],
  1 + o_orderkey % 3, o_custkey % 4, 'n' || (o_custkey % 5)) status, printf('{"id":"%s","status":"%s"}', 'j-' || o_orderkey, case when o_orderkey % 2 = 0 then 'created' else 'duplicate' end) submitted,
  '[{"node":"n' || (o_custkey % 5) || '"},{"node":"n' || ((o_custkey + 1) % 5) || '"}]' nodes, 'n' || (o_custkey % 5) captured from orders""")
def status_json(spark, d):
    j = t.jobs(spark, d)
    jid = F.concat(F.lit("j-"), F.col("job_id").cast("string"))
    status = text.job_json(jid, codes.state_name(F.col("state")), F.col("epoch"), F.col("lease_seq"), F.col("owner"))
    return j.select(
        F.col("job_id").alias("o_orderkey"), status.alias("status"), text.submit_json(jid, F.col("job_id") % 2 == 0).alias("submitted"),
        text.nodes_json(F.slice("replicas", 1, 2)).alias("nodes"), text.captured(status, "owner").alias("captured"),
    )


@query("""select 'node' || (user_id % 5) instance, event_type, printf('events_total{instance="%s",kind="%s"} %d', 'node' || (user_id % 5), event_type, count(*)) line from events group by 1, 2""")
def exposition(spark, d):
    g = t.read(spark, d, "events").groupBy(F.concat(F.lit("node"), F.expr("user_id % 5").cast("string")).alias("instance"), "event_type").agg(F.count("*").alias("n"))
    rows = g.select("instance", "event_type", F.lit("events_total").alias("name"), F.create_map(F.lit("kind"), F.col("event_type"), F.lit("instance"), F.col("instance")).alias("labels"), F.col("n").alias("value"))
    return lines.exposition(rows, "counter").select(F.regexp_extract("value", 'instance="([^"]*)"', 1).alias("instance"), F.regexp_extract("value", 'kind="([^"]*)"', 1).alias("event_type"), F.col("value").alias("line"))


@query(HIST_SQL + """select instance, q, arg_min((prev_le + (case when le > 1e17 then prev_le * 2 else le end - prev_le) *
  case when cum - prev_cum <= 0 then 1.0 else (target - prev_cum) / (cum - prev_cum) end) * 1000.0, le) "value" from qs where cum >= target group by 1, 2""")
def latency_quantiles(spark, d):
    return metrics.quantiles(metrics.histogram(_seconds(spark, d), ["instance"]), ["instance"], [0.5, 0.95, 0.99])


@query(HIST_SQL + """select instance, q, arg_min(case when le > 1e17 then prev_le else prev_le + (le - prev_le) *
  case when cum - prev_cum <= 0 then 1.0 else (target - prev_cum) / (cum - prev_cum) end end, le) "value" from qs where cum >= target group by 1, 2""")
def promql_quantile(spark, d):
    return metrics.quantiles(metrics.histogram(_seconds(spark, d), ["instance"]), ["instance"], [0.5, 0.95, 0.99], prometheus=True)


@query("""with c as (select le, event_id % 2 half, count(*) n from (select event_id, case when value <= 10 then 10 when value <= 100 then 100 else 1000 end le from events) group by 1, 2)
select a.le, greatest(a.n - coalesce(b.n, 0), 0) n, a.n < coalesce(b.n, 0) clamped from c a left join c b on a.le = b.le and b.half = 0 where a.half = 1""")
def hist_delta(spark, d):
    c = t.read(spark, d, "events").select(F.expr("event_id % 2").alias("half"), F.expr("case when value <= 10 then 10 when value <= 100 then 100 else 1000 end").alias("le"))
    c = c.groupBy("le", "half").agg(F.count("*").alias("n"))
    return metrics.delta(c.where("half = 1"), c.where("half = 0"), ["le"], "n")


def _range_sql(source: str, keys: str, seconds: int, step: int) -> str:
    """The rule of a sliding range, each sample paired with each evaluation time."""
    return f"""s as ({source}),
l as (select *, lag(value) over w was, lag("at") over w since from s window w as (partition by {keys} order by "at", value)),
t as (select distinct {keys}, g.ev from s, lateral (select unnest(range(((s."at" + {step - 1}) // {step}) * {step}, s."at" + {seconds}, {step})) ev) g),
x as (select t.*, l."at" ts, value, since, was from t join l using ({keys}) where l."at" > ev - {seconds} and l."at" <= ev),
a as (select {keys}, ev, min(ts) t0, max(ts) t1, count(*) n, arg_min(value, ts * 1e6 + value) v0,
  coalesce(sum(case when value < was then value else value - was end) filter (since > ev - {seconds}), 0) grown from x group by {keys}, ev having count(*) >= 2 and max(ts) > min(ts)),
d as (select *, (t1 - t0)::double span, (t1 - t0)::double / (n - 1) gap, (t0 - ev + {seconds})::double head0, (ev - t1)::double tail0 from a),
h as (select *, case when head0 >= gap * 1.1 then gap / 2 else head0 end head1, case when tail0 >= gap * 1.1 then gap / 2 else tail0 end tail1,
  case when grown > 0 and v0 >= 0 then span * v0 / grown end zero from d),
ranged as (select {keys}, ev "at", grown * ((span + case when zero < head1 then zero else head1 end + tail1) / span) "increase" from h)"""


_SAMPLES = """select 'node' || (event_id % 5) instance, event_id * 3 "at", cast((event_id // 5 * 7 + event_id % 3) % 1000 as double) "value" from events"""


@query("with " + _range_sql(_SAMPLES, "instance", 60, 15) + """ select instance, "at", round("increase", 6) "increase", round("increase" / 60, 6) rate from ranged""")
def rate_1m(spark, d):
    r = metrics.over_range(t.samples(spark, d).select("instance", "at", "value"), ["instance"], 60, 15)
    return r.select("instance", "at", F.round("increase", 6).alias("increase"), F.round("rate", 6).alias("rate"))


@query("with " + _range_sql(_SAMPLES, "instance", 300, 60) + """ select "at", round(sum("increase"), 6) "increase" from ranged group by "at\"""")
def increase_5m(spark, d):
    r = metrics.over_range(t.samples(spark, d).select("instance", "at", "value"), ["instance"], 300, 60)
    return metrics.sum_by(r, ["at"], "increase").select("at", F.round("increase", 6).alias("increase"))


@query("with " + _range_sql("""select 'node' || (event_id % 5) instance, event_id * 3 "at", le, cast(event_id // 5 * m as double) "value" from events,
  (values (0.25, 2), (0.5, 5), (1.0, 9), (1e18, 10)) b(le, m)""", "instance, le", 60, 60) + """,
c as (select "at", le, sum("increase" / 60) cum from ranged group by "at", le),
p as (select *, lag(le, 1, 0.0) over w prev_le, lag(cum, 1, 0.0) over w prev_cum, max(cum) over (partition by "at") total from c window w as (partition by "at" order by le)),
q as (select *, q * total target from p, (values (0.5), (0.95), (0.99)) v(q))
select "at", q::double q, round(arg_min(case when le > 1e17 then prev_le else prev_le + (le - prev_le) * case when cum <= prev_cum then 1.0 else (target - prev_cum) / (cum - prev_cum) end end, le)
  filter (cum >= target), 6) "value" from q group by "at", q.q having max(total) > 0""")
def quantile_of_rates(spark, d):
    r = metrics.over_range(t.bucket_samples(spark, d), ["instance", "le"], 60, 60)
    cum = metrics.sum_by(r, ["at", "le"], "rate").withColumnRenamed("rate", "cum")
    return metrics.quantiles(cum, ["at"], [0.5, 0.95, 0.99], prometheus=True).where("value is not null").select("at", "q", F.round("value", 6).alias("value"))


@query("""select sum("value") "value" from (select arg_max(cast((event_id // 5 * 7 + event_id % 3) % 1000 as double), event_id) "value" from events where event_id % 3 = 1 group by event_id % 5)""")
def instant_sum(spark, d):
    return metrics.latest(t.samples(spark, d), ["instance"], F.col("shard") == 1).agg(F.sum("value").alias("value"))


@query("select 'node' || (event_id % 5) instance, arg_max(cast((event_id // 5 * 7 + event_id % 3) % 1000 as double), event_id) \"value\" from events group by 1")
def instant_latest(spark, d):
    return metrics.latest(t.samples(spark, d), ["instance"])


_M = "18446744073709551616::hugeint"


def _times(a: str, b: int) -> str:
    """(a * b) modulo 2^64 of unsigned numbers, in halves that a hugeint holds."""
    return f"((({a}) % 4294967296::hugeint * {b}::hugeint) % {_M} + (((({a}) // 4294967296::hugeint) * {b % 2**32}::hugeint) % 4294967296::hugeint) * 4294967296::hugeint) % {_M}"


# The ring from the nodes' addresses: endpoint key, then the finaliser, both in SQL.
RING_SQL = f"""with n0(node) as (values {', '.join(f"('{n}')" for n in NODES)}),
n1 as (select node, string_split(string_split(node, ':')[1], '.') o, string_split(node, ':')[2]::hugeint port from n0),
n2 as (select node, (o[1]::hugeint + o[2]::hugeint * 256 + o[3]::hugeint * 65536 + o[4]::hugeint * 16777216) * 65536 + (port % 256) * 256 + port // 256 x from n1),
n3 as (select node, (x + 11400714819323198485::hugeint) % {_M} x from n2),
n4 as (select node, xor(x, x // 1073741824::hugeint) x from n3),
n5 as (select node, {_times("x", 0xBF58476D1CE4E5B9)} x from n4),
n6 as (select node, xor(x, x // 134217728::hugeint) x from n5),
n7 as (select node, {_times("x", 0x94D049BB133111EB)} x from n6),
nodes as (select node, xor(x, x // 2147483648::hugeint) pos from n7),
k as (select distinct 'k-' || o_custkey "key" from orders),
h as (select "key", list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, len("key") + 1), lambda i: ord("key"[i])::hugeint)),
  lambda a, b: (xor(a, b) * 1099511628211::hugeint) % {_M}) hash from k),
r as (select "key", hash, node, row_number() over (partition by "key" order by pos < hash, pos) i from h cross join nodes)
"""


def _keys(spark, d):
    return t.read(spark, d, "orders").select(F.concat(F.lit("k-"), F.col("o_custkey").cast("string")).alias("key")).distinct()


@query(RING_SQL + 'select "key", node as owner from r where i = 1')
def ring_owner(spark, d):
    return placement.place(_keys(spark, d), NODES).select("key", "owner")


@query(RING_SQL + 'select "key", string_agg(node, \',\' order by i) replicas from r where i <= 3 group by 1')
def replica_set(spark, d):
    return placement.place(_keys(spark, d), NODES).select("key", F.array_join("replicas", ",").alias("replicas"))


@query(RING_SQL + f"select \"key\", (list(node order by i) filter (node in ('{NODES[1]}', '{NODES[3]}')))[1] alive from r where i <= 3 group by 1")
def first_alive(spark, d):
    alive = F.array(F.lit(NODES[1]), F.lit(NODES[3]))
    return placement.place(_keys(spark, d), NODES).select("key", placement.first_alive(F.col("replicas"), alive).alias("alive"))


@query(RING_SQL + f"select \"key\", i - 1 slot, node peer from r where i <= 3 and node <> '{NODES[0]}'")
def peer_slots(spark, d):
    p = placement.place(_keys(spark, d), NODES)
    return quorum.peer_slots(p, F.lit(NODES[0])).select("key", F.col("slot").cast("bigint").alias("slot"), "peer")


@query(LOG_SQL + """select o_orderkey txn, count(distinct case when ok then slot end) acks, count(distinct slot) answered,
  case when count(distinct case when ok then slot end) >= case when o_custkey % 4 > 0 then 1 else 0 end then 'created'
    when count(distinct slot) >= o_custkey % 4 then 'no_quorum' else 'pending' end outcome from orders left join acks on txn = o_orderkey group by o_orderkey, o_custkey""")
def quorum_commit(spark, d):
    peers = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("txn"), F.expr("o_custkey % 4").alias("n_peers"))
    return quorum.commit_outcome(t.acks(spark, d), peers)


@query(LOG_SQL + "select txn, bit_or(case when ok then 1 << slot else 0 end) mask, bit_or(case when ok then 1 << slot else 0 end) & 7 = 7 complete from acks group by txn")
def confirmed_mask(spark, d):
    return quorum.confirmed_mask(t.acks(spark, d), F.lit(7))


@query(LOG_SQL + "select count(*) backlog from (select txn from acks group by txn having bit_or(case when ok then 1 << slot else 0 end) & 7 <> 7)")
def repair_backlog(spark, d):
    return quorum.repair_backlog(quorum.confirmed_mask(t.acks(spark, d), F.lit(7)))


_ALIVE = "['n0', 'n2', 'n3']"
_alive = lambda: F.array(*map(F.lit, t.ALIVE))


@query(LOG_SQL + f"""select m.txn, cast(s as int) slot, replicas[s + 1] peer from (select txn, bit_or(case when ok then 1 << slot else 0 end) m from acks group by txn) m
  join jobs on job_id = txn and owner = 'n0' cross join range(3) r(s) where m & (1 << cast(s as int)) = 0 and replicas[s + 1] not in ('', 'n0') and list_contains({_ALIVE}, replicas[s + 1])""")
def repair_resend(spark, d):
    return quorum.resend(quorum.confirmed_mask(t.acks(spark, d), F.lit(7)), t.jobs(spark, d), F.lit("n0"), _alive())


_RANK = "case {} when 3 then 3 when 4 then 2 when 2 then 1 else 0 end"
MERGED_SQL = LOG_SQL + f""", ans as (select txn job_id, count(distinct case when ok then slot end) slots, max(case when ok then lease_seq end) seq,
    max(case when ok then {_RANK.format("state")} end) strongest from acks group by txn),
merged as (select j.job_id, greatest(seq, j.lease_seq) best_seq, slots, slots >= 1 granted,
  case when coalesce(strongest, -1) > {_RANK.format("j.state")} then case strongest when 3 then 3 when 2 then 4 when 1 then 2 else 1 end else j.state end best_state
  from ans a join jobs j on a.job_id = j.job_id)
"""


def _merged(spark, d):
    answers = t.acks(spark, d).select(F.col("txn").alias("job_id"), "slot", F.when(F.col("ok"), "created").otherwise("stale_epoch").alias("status"), "state", "lease_seq")
    return fences.merged_answers(answers, t.jobs(spark, d), 3)


@query(MERGED_SQL + "select job_id, best_seq, best_state, slots, granted from merged")
def claim_merge(spark, d):
    return _merged(spark, d)


@query(MERGED_SQL + """select m.job_id, case when best_state = 3 and state <> 3 then 'done' when best_state = 4 and state not in (3, 4) then 'dead_letter'
    when (best_state = 2 or best_seq > lease_seq) and (state <> 2 or lease_seq < best_seq) then 'lease' else 'none' end "action",
  case when best_state = 3 and state <> 3 or best_state = 4 and state not in (3, 4) then lease_seq
    when (best_state = 2 or best_seq > lease_seq) and (state <> 2 or lease_seq < best_seq) then greatest(best_seq, lease_seq) else lease_seq end lease_seq,
  not (best_state = 3 and state <> 3) and not (best_state = 4 and state not in (3, 4)) and (best_state = 2 or best_seq > lease_seq or state = 2) wait
  from merged m join jobs j on m.job_id = j.job_id where granted""")
def takeover_action(spark, d):
    return fences.takeover_action(_merged(spark, d).where("granted"), t.jobs(spark, d))


APPLY_SQL = LOG_SQL + """, applied as (select l_orderkey, l_linenumber, case when j.epoch is null then 'unknown_job' when m.epoch < j.epoch then 'stale_epoch'
  when sender <> owner and not takeover then 'not_owner' else 'created' end status from msg m left join jobs j on m.job_id = j.job_id)
"""


@query(APPLY_SQL + "select * from applied")
def apply_fence(spark, d):
    return fences.apply_outcome(t.messages(spark, d), t.jobs(spark, d)).select("l_orderkey", "l_linenumber", "status")


@query(APPLY_SQL + "select l_linenumber, count(*) filter (status = 'stale_epoch') fenced_stale from applied group by 1")
def fenced_stale(spark, d):
    return fences.fenced(fences.apply_outcome(t.messages(spark, d), t.jobs(spark, d)), ["l_linenumber"])


@query(LOG_SQL + """select l_orderkey, l_linenumber, case when m.epoch < j.epoch then 'stale_epoch' else 'created' end status, j.epoch is null or (not m.epoch < j.epoch
  and (m.epoch, m.copy_state = 3, m.copy_state = 4, m.lease_seq, m.copy_state = 2) > (j.epoch, j.state = 3, j.state = 4, j.lease_seq, j.state = 2)) adopted
  from msg m left join jobs j on m.job_id = j.job_id""")
def replicate_fence(spark, d):
    return fences.replicate_outcome(t.messages(spark, d), t.jobs(spark, d)).select("l_orderkey", "l_linenumber", "status", "adopted")


@query(LOG_SQL + """, c as (select l_orderkey, l_linenumber, case when sender <> new_owner then 'invalid' when j.epoch is null then 'unknown_job'
    when not list_contains(replicas, new_owner) then 'not_owner' when m.epoch < j.epoch or (m.epoch = j.epoch and owner <> new_owner) then 'stale_epoch' else 'created' end status,
  m.epoch > j.epoch later from msg m left join jobs j on m.job_id = j.job_id)
select l_orderkey, l_linenumber, status, status = 'created' and later takeover from c""")
def claim_fence(spark, d):
    claims = t.messages(spark, d).drop("takeover").withColumnRenamed("epoch", "proposed")
    return fences.claim_outcome(claims, t.jobs(spark, d)).select("l_orderkey", "l_linenumber", "status", "takeover")


@query(LOG_SQL + """, best as (select job_id, (list({'e': epoch, 'st': copy_state, 's': lease_seq, 'o': sender} order by epoch desc, copy_state = 3 desc, copy_state = 4 desc, lease_seq desc,
    copy_state = 2 desc, sender desc))[1] r from msg group by job_id),
x as (select j.*, r, r is not null and (r.e, r.st = 3, r.st = 4, r.s, r.st = 2) > (epoch, state = 3, state = 4, lease_seq, state = 2) adopted from jobs j left join best b on j.job_id = b.job_id)
select job_id, case when adopted then r.e else epoch end epoch, case when adopted then r.st else state end state, case when adopted then r.s else lease_seq end lease_seq,
  case when adopted then r.o else owner end owner, adopted from x""")
def resync(spark, d):
    remote = t.messages(spark, d).select("job_id", "epoch", F.col("copy_state").alias("state"), "lease_seq", F.col("sender").alias("owner"))
    return fences.resync(t.jobs(spark, d), remote)


@query(LOG_SQL + f"""select job_id, list_filter(replicas, lambda r: list_contains({_ALIVE}, r))[1] successor, epoch + 1 proposed from jobs where state not in (3, 4) and owner in ('n1', 'n4')""")
def takeover_targets(spark, d):
    return fences.takeover_targets(t.jobs(spark, d), F.array(F.lit("n1"), F.lit("n4")), _alive())


@query(LOG_SQL + f"""select job_id, list_filter(replicas, lambda r: r not in ('', 'n0') and list_contains({_ALIVE}, r))[1] "to" from jobs where owner = 'n0' and state not in (3, 4)""")
def drain_plan(spark, d):
    return fences.drain_plan(t.jobs(spark, d), F.lit("n0"), _alive())


@query(LOG_SQL + "select count(*) remaining, count(*) = 0 complete from jobs where owner = 'n0' and state not in (3, 4)")
def drain_status(spark, d):
    return fences.drained(fences.drain_plan(t.jobs(spark, d), F.lit("n0"), _alive()))


@query(LOG_SQL + """select job_id, case when exists (select 1 from acks where txn = job_id group by txn having bit_or(case when ok then 1 << slot else 0 end) & 7 <> 7) then 'no_quorum' else 'ok' end status
  from jobs where state = 3""")
def completion_again(spark, d):
    backlog = quorum.confirmed_mask(t.acks(spark, d), F.lit(7)).where("not complete").select(F.col("txn").alias("job_id"))
    return quorum.completion_again(t.jobs(spark, d).where("state = 3"), backlog)


@query(LOG_SQL + f"""select job_id, coalesce(list_position(replicas, 'n2'), 0)::bigint - 1 slot, array_to_string(list_filter({_ALIVE}, lambda a: a <> 'n0'), ',') others,
  array_to_string(list_concat(['n1'], {_ALIVE}), ',') everyone,
  len(list_filter(replicas, lambda r: r not in ('', 'n0'))) = 0 or len(list_filter(replicas, lambda r: r not in ('', 'n0') and list_contains({_ALIVE}, r))) > 0 reachable,
  owner = 'n0' and state not in (3, 4) owned_active, array_to_string(case when owner = 'n0' then ['n0', 'n2', 'n3'] else [owner] || list_filter({_ALIVE}, lambda a: a <> owner)[1:2] end, ',') fallback
  from jobs""")
def membership(spark, d):
    j, n0 = t.jobs(spark, d), F.lit("n0")
    return j.select(
        "job_id", F.coalesce(quorum.slot_of(F.col("replicas"), F.lit("n2")), F.lit(-1)).cast("bigint").alias("slot"), F.array_join(fences.without_self(_alive(), n0), ",").alias("others"),
        F.array_join(fences.with_self(_alive(), F.lit("n1")), ",").alias("everyone"),
        fences.reachable(F.col("replicas"), n0, _alive()).alias("reachable"), ((F.col("owner") == n0) & fences.active(F.col("state"))).alias("owned_active"),
        F.array_join(placement.fallback(F.col("owner"), _alive()), ",").alias("fallback"),
    )


QUEUE_SQL = LOG_SQL + """, fit as (select q.*, lease_seq, max_attempts, replicas, row_number() over (partition by node order by enq_seq) r
  from queue q join jobs j on q.job_id = j.job_id where state = 1 and owner = node and not_before <= 20)
"""


@query(QUEUE_SQL + "select node, enq_seq, job_id from fit where r = 1")
def fifo_lease(spark, d):
    return leases.next_lease(t.queue(spark, d), t.jobs(spark, d), F.lit(20)).select("node", "enq_seq", "job_id")


@query(QUEUE_SQL + """, g as (select job_id, enq_seq, lease_seq, max_attempts, job_id % 2 = 0 ok, len(list_filter(replicas, lambda r: r not in ('', node) and r in ('n0', 'n3'))) > 0 reach from fit)
select enq_seq, job_id, case when not reach then 'no_quorum' when lease_seq + 1 > max_attempts then 'dead_letter' when ok then 'leased' else 'no_quorum' end outcome,
  case when reach and lease_seq + 1 <= max_attempts then lease_seq + 1 else lease_seq end lease_seq,
  case when reach and lease_seq + 1 <= max_attempts and not ok then (1000 * pow(2, lease_seq))::bigint else 0 end back_off_ms from g""")
def grant_outcome(spark, d):
    q = t.queue(spark, d).join(t.jobs(spark, d), "job_id").where("state = 1 and owner = node and not_before <= 20")
    can = fences.reachable(F.col("replicas"), F.col("node"), F.array(F.lit("n0"), F.lit("n3")))
    return leases.grant(q, F.col("job_id") % 2 == 0, can).select("enq_seq", "job_id", "outcome", "lease_seq", F.coalesce("back_off_ms", F.lit(0)).alias("back_off_ms"))


@query(LOG_SQL + "select job_id, log_ord, pos, row_number() over (partition by job_id order by log_ord, pos)::int grant_no from log where rec_type = 3")
def grant_numbers(spark, d):
    return leases.grant_numbers(t.log_records(spark, d).where("rec_type = 3")).select("job_id", "log_ord", "pos", "grant_no")


@query(LOG_SQL + "select node, pos, (7::bigint << 32) | (row_number() over (partition by node order by pos) - 1) nonce from log")
def job_nonces(spark, d):
    return codes.nonces(t.log_records(spark, d), 7, "pos").select("node", "pos", "nonce")


@query(LOG_SQL + """, tok as (select job_id, log_ord, pos, epoch tok_epoch, lease_seq tok_seq from log where rec_type = 3),
j as (select job_id, epoch, lease_seq, copy_state state from (select *, row_number() over (partition by job_id
  order by epoch desc, copy_state = 3 desc, copy_state = 4 desc, lease_seq desc, copy_state = 2 desc, log_ord, pos) r from log where rec_type in (1, 2)) where r = 1)
select tok.job_id, log_ord, pos, case when state is null then 'unknown' when state = 3 then 'already_done'
  when state = 2 and tok_epoch <= epoch and tok_seq = lease_seq then 'current'
  when state = 1 and (tok_epoch < epoch or (tok_epoch = epoch and tok_seq <= lease_seq)) then 'amnesty'
  when state = 4 and tok_epoch <= epoch then 'late_after_park' else 'not_leased' end outcome from tok left join j on tok.job_id = j.job_id""")
def ack_outcome(spark, d):
    log = t.log_records(spark, d)
    tok = log.where("rec_type = 3").select("job_id", "log_ord", "pos", F.col("epoch").alias("tok_epoch"), F.col("lease_seq").alias("tok_seq"))
    return leases.ack_outcome(tok, merge.merge_latest_copy(log)).select("job_id", "log_ord", "pos", "outcome")


@query("""with q as (select event_id req_id, user_id u, ts sent, event_id % 70000 bytes from events where event_type = 'click'),
r as (select req_id, bytes, sent, min(got) filter (event_type = 'view') got, min(got) filter (event_type = 'error') died
  from q left join (select user_id u, ts got, event_type from events where event_type in ('view', 'error')) p on q.u = p.u and got >= sent and got <= sent + interval 86400000 milliseconds group by all),
o as (select *, case when bytes > 65536 then 'too_large' when died is not null and (got is null or died < got) then 'peer_down' when got is not null then 'ok' else 'timeout' end outcome from r)
select req_id, outcome, case when outcome = 'ok' then got end got from o""")
def request_timeout(spark, d):
    e = t.read(spark, d, "events")
    sent = e.where("event_type = 'click'").select(F.col("event_id").alias("req_id"), F.col("user_id").alias("peer"), F.col("ts").alias("sent"), F.expr("event_id % 70000").alias("bytes"))
    at = lambda kind, name: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("peer"), F.col("ts").alias(name))
    return requests.outcomes(sent, at("view", "got"), 86_400_000, at("error", "died"))


ROUTES = ["/", "/en", "/en/1", "/de", "/fr/8", "/es/"]


@query("""with p as (select page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) path from pages), r(prefix) as (values ('/'), ('/en'), ('/en/1'), ('/de'), ('/fr/8'), ('/es/'))
select page_id, arg_max(prefix, length(prefix)) route from p left join r on starts_with(path, prefix) group by page_id""")
def prefix_route(spark, d):
    p = t.read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    return requests.route(p, spark.createDataFrame([(r,) for r in ROUTES], "prefix string"))


@query("""select i attempt, cast(case when i > 6 then least(64000, 60000) else 1000 * pow(2, greatest(i - 1, 0)) end as bigint) backoff_ms,
  case when i in (0, 1) then 200 when i in (2, 6, 7) then 409 when i = 4 then 400 when i = 5 then 404 else 503 end http_code,
  case i when 1 then 'ready' when 2 then 'leased' when 3 then 'done' when 4 then 'dead_letter' else '?' end state_name from range(12) r(i)""")
def backoff_and_codes(spark, d):
    i = F.col("id")
    return spark.range(12).select(i.alias("attempt"), codes.nack_backoff_ms(i).alias("backoff_ms"), codes.http_code(i).alias("http_code"), codes.state_name(i).alias("state_name"))


@query("""select page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) ref,
  case when starts_with(url, 'http://') then regexp_extract(url, '^http://([^/:?#]+)', 1) end host from pages""")
def url_query(spark, d):
    q = t.read(spark, d, "pages").select("page_id", "url", F.explode(F.array(text.query_map(F.col("url")))).alias("q"))
    get = lambda k: F.coalesce(F.try_element_at("q", F.lit(k)), F.lit(""))
    return q.select("page_id", get("page").alias("page"), get("ref").alias("ref"), text.host_port_path(F.col("url"))["host"].alias("host"))
