"""Explicit schemas of the log, its companions and the metrics."""

LOG_RECORDS = """node string, log_ord int, seg string, pos bigint, lsn bigint, rec_type tinyint, job_id string, epoch bigint,
lease_seq bigint, worker decimal(20,0), new_owner string,
job struct<idem_key:string,url:string,body:binary,visibility_ms:bigint,max_attempts:bigint,replicas:array<string>,
state:tinyint,owner:string,epoch:bigint,lease_seq:bigint,attempts:bigint>"""
ACCEPTED = "line_no bigint, key string, id string, code string"
RECEIPTS = "line_no bigint, mono_ms bigint, key string, attempt string, path string, bytes bigint"
METRICS = "scrape_ts timestamp, instance string, name string, labels map<string,string>, value double"
BENCH = "rate int, offered bigint, accepted bigint, errors bigint, completed bigint, p50_ms double, p95_ms double, p99_ms double"
LOSS_BENCH = f"loss double, {BENCH}"

# Record types and job states of the log.
SUBMIT, REPLICATE, LEASE, DONE, EXPIRE, DEAD_LETTER, TAKEOVER = range(1, 8)
READY, LEASED, FINISHED, DEAD = 1, 2, 3, 4
STATE_NAMES = {READY: "ready", LEASED: "leased", FINISHED: "done", DEAD: "dead_letter"}
