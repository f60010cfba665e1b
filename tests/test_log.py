"""Log codec and source, the replay fold against a plain loop, stream lifecycle."""

import random
import re
import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from oplogue.functions import codes, hashing, text
from oplogue.operators import audit, fences, leases, loads, merge, metrics, placement, replay
from oplogue.sources import text as lines
from oplogue.sources import wal

ID = "00000000000000010000000000000002"
JOB = {
    "idem_key": "invoice/77", "url": "http://hooks.test:8443/in", "body": b"{}", "visibility_ms": 4000, "max_attempts": 6,
    "replicas": ["192.0.2.7:7400", "192.0.2.8:7400", None], "state": 1, "owner": "192.0.2.7:7400", "epoch": 1, "lease_seq": 0, "attempts": 0,
}


def rec(kind, **kw):
    base = dict.fromkeys(("epoch", "lease_seq", "worker", "new_owner", "job"))
    return base | {"rec_type": kind, "job_id": ID} | kw


ALL = [
    rec(1, job=JOB), rec(2, job=JOB), rec(3, epoch=1, lease_seq=2, worker=2**63 + 1), rec(4, epoch=1, lease_seq=2), rec(5, epoch=1, lease_seq=2),
    rec(6, epoch=3), rec(7, epoch=4, new_owner="192.0.2.9:65535"),
]


def test_codec_round_trip_and_truncation():
    assert wal.crc32c(b"123456789") == 0xE3069283
    for i, r in enumerate(ALL):
        body = wal.encode(r, i)
        assert wal.decode(body) == r | {"lsn": i}
        for cut in range(0, len(body), 7):
            assert wal.decode(body[:cut]) is None
    assert wal.decode(struct.pack("<BQ", 99, 0)) is None and wal.decode(b"abcde") is None
    for bad in (b"", b"x" * 65537):
        with pytest.raises(ValueError):
            wal.frame(bad)


def test_torn_and_flipped_frames_end_the_scan():
    data = b"".join(wal.frame(x) for x in (b"one", b"three", b"fifteen"))
    assert list(wal.frames(data)) == [b"one", b"three", b"fifteen"]
    assert list(wal.frames(data[:-3])) == [b"one", b"three", None]
    assert list(wal.frames(data[:-1] + b"?")) == [b"one", b"three", None]
    assert list(wal.frames(b"")) == []


def test_source_writes_and_reads_in_order(spark, tmp_path):
    wal.register(spark)
    schema = spark.read.format("oplogue_wal").option("dirs", str(tmp_path)).load().schema
    rows = [
        Row(**{f.name: None for f in schema} | {k: v for k, v in r.items() if k != "worker"} | {"job": tuple(r["job"].values()) if r["job"] else None})
        for r in ALL * 3
    ]
    spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema).coalesce(1).write.format("oplogue_wal").option(
        "path", str(tmp_path / "w")
    ).option("segment_bytes", 300).mode("append").save()
    (folder,) = wal.log_dirs(str(tmp_path / "w"))
    assert [f.name for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")] == [folder.rsplit("/", 1)[-1]]
    assert len(wal.segments(folder)) > 3
    got = spark.read.format("oplogue_wal").option("dirs", f"{folder},{folder}").load()
    assert [r.rec_type for r in got.where("log_ord = 1").orderBy("pos").collect()] == [r["rec_type"] for r in ALL * 3]
    assert replay.misplaced(got).count() == 0 and got.count() == 42 and got.rdd.getNumPartitions() > 6
    first = wal.segments(folder)[0]
    with open(first, "r+b") as f:
        f.truncate(20)
    with pytest.raises(Exception, match="bad frame"):
        spark.read.format("oplogue_wal").option("dirs", folder).load().count()
    assert spark.read.format("oplogue_wal").option("dirs", folder).option("mode", "permissive").load().count() < 21


def loop(records):
    job = None
    for r in records:
        t, e, s, c = r["rec_type"], r["epoch"], r["lease_seq"], r["copy_state"]
        key = lambda e, st, q: (e, st == 3, st == 4, q, st == 2)
        if t == 1 or t == 2 and (job is None or key(e, c, s) > key(job["e"], job["st"], job["s"])):
            job = {"st": c, "e": e, "s": s, "a": s, "o": r["owner"], "b": r["body"]}
        elif job is None:
            continue
        elif t == 3 and e >= job["e"] and job["st"] not in (3, 4):
            job |= {"st": 2, "e": e, "s": s, "a": s}
        elif t == 4 and e >= job["e"] and job["st"] != 3:
            job |= {"st": 3, "e": e, "b": ""}
        elif t == 5 and e >= job["e"] and job["st"] == 2 and s == job["s"]:
            job |= {"st": 1, "e": e}
        elif t == 6 and e >= job["e"] and job["st"] != 3:
            job |= {"st": 4, "e": e}
        elif t == 7 and e > job["e"]:
            job |= {"e": e, "o": r["owner"]}
    return job


def audit_loop(records):
    merged, have, top = None, False, 1
    key = lambda x: (x[0], x[1] == 3, x[1] == 4, x[2], x[1] == 2)
    for r in records:
        t, e, s, c = r["rec_type"], r["epoch"], r["lease_seq"], r["copy_state"]
        if t in (1, 2):
            if not have or key((e, c, s)) > key(merged):
                merged = (e, c, s)
            have = True
        if t in (1, 2, 3, 7):
            top = max(top, e)
        if t == 4 or t == 6 and have:
            m = (max(top, e), 3 if t == 4 else 4, merged[2] if merged else 0)
            if not have or key(m) > key(merged):
                merged, have = m, True
    return merged[1] if merged else 1


def test_folds_equal_plain_loops(spark):
    rng = random.Random(3)
    rows = []
    for j in range(400):
        for p in range(rng.randint(1, 9)):
            rows.append(Row(node="n", log_ord=0, pos=j * 10 + p, rec_type=rng.randint(1, 7), job_id=f"j{j}", epoch=rng.randint(1, 3), lease_seq=rng.randint(0, 3), copy_state=rng.randint(1, 4), owner=f"o{rng.randint(0, 3)}", body="x"))
    rng.shuffle(rows)
    log = spark.createDataFrame(rows)
    by = {}
    for r in sorted(rows, key=lambda r: r.pos):
        by.setdefault(r.job_id, []).append(r.asDict())
    got = {r.job_id: (r.state, r.epoch, r.lease_seq, r.attempts, r.owner, r.body) for r in replay.replay(log).collect()}
    want = {k: loop(v) for k, v in by.items()}
    assert got == {k: (v["st"], v["e"], v["s"], v["a"], v["o"], v["b"]) for k, v in want.items() if v}
    facts = {r.job_id: r.state for r in merge.job_facts(log).collect()}
    assert facts == {k: audit_loop(by[k]) for k in facts}
    assert set(facts) == {k for k, v in by.items() if any(r["rec_type"] != 5 for r in v)}


def test_expressions(spark):
    one = spark.range(1)
    got = one.select(
        hashing.fnv1a(F.lit("")).alias("a"), hashing.fnv1a(F.lit("kéy-1")).alias("b"), text.url_decode(F.lit("a%20b+c%zz%4")).alias("c"),
        text.query_map(F.lit("http://h/p?a=1&b=%2F&a=2&c#x")).alias("d"), text.host_port_path(F.lit("http://h:81/x")).alias("e"), text.host_port_path(F.lit("http://h")).alias("f"),
        codes.job_id(F.lit(1), F.lit(-1)).alias("g"), codes.segment_name(F.lit(7)).alias("h"), codes.valid_submit(F.lit("k"), F.lit("u"), F.lit("b" * 641)).alias("i"),
        codes.default_if_zero(F.lit(0), 5).alias("j"), text.listed(F.lit(",a,,b")).alias("k"), text.number_or(F.lit("x"), 3).alias("l"),
    ).first()
    h = 0xCBF29CE484222325
    for b in "kéy-1".encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert got.a & 2**64 - 1 == 0xCBF29CE484222325 and got.b & 2**64 - 1 == h
    assert got.c == "a b c%zz%4" and got.d == {"a": "2", "b": "/", "c": ""}
    assert tuple(got.e) == ("h", 81, "/x") and tuple(got.f) == ("h", 80, "/")
    assert got.g == "0" * 15 + "1" + "f" * 16 and got.h == "wal-00000000000000000007.log" and not got.i and got.j == 5 and got.k == ["a", "b"] and got.l == 3


def test_histogram_golden(spark):
    v = spark.createDataFrame([(0.0005,), (0.003,), (0.003,), (1000.0,)], "seconds double")
    h = {round(r.le, 3): r.cum for r in metrics.histogram(v, []).collect()}
    assert h[0.001] == 1 and h[0.004] == 3 and h[1e18] == 4
    empty = spark.createDataFrame([(0.001, 0), (1e18, 0)], "le double, cum bigint")
    assert metrics.quantiles(empty, [], [0.5]).first().value == -1.0


def test_line_sources(spark, tmp_path):
    (tmp_path / "s").write_text("k1,aa,201\nbad\nk1,bb,200,x\n")
    (tmp_path / "m").write_text('# HELP\nm_bucket{le="0.001"} 3\nm_bucket{le="+Inf"} 4\nok 1.5\n')
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.txt").write_text("k,first,201\n")
    (folder / "b.txt").write_text("x,y,201\n" * 2000 + "k,second,201\n")
    with_splits = lines.accepted(lines.lines(spark, str(folder)))
    assert {r.id for r in audit.accepted_keys(with_splits).where("key = 'k'").collect()} == {"second"}
    a = lines.accepted(lines.lines(spark, str(tmp_path / "s"))).orderBy("line_no").collect()
    assert [(r.key, r.id, r.code) for r in a] == [("k1", "aa", "201"), ("k1", "bb", "200")]
    m = lines.metrics(lines.lines(spark, str(tmp_path / "m")))
    assert m.count() == 3 and {(r.le, r.cum) for r in lines.buckets(m, "m").collect()} == {(0.001, 3), (1e18, 4)}
    assert sorted(r.value for r in lines.exposition(m).collect())[0] == 'm_bucket{le="+Inf"} 4.000000'


def test_lease_lifecycle_stream(spark, tmp_path):
    import datetime as dt

    from oplogue.streaming.lifecycle import lifecycle

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "job_id string, ts timestamp, ord bigint, event string, lease_seq bigint, max_attempts bigint, visibility_ms bigint"
    batches = [
        [("a", at(0), 0, "submit", None, 2, 2000), ("a", at(1), 1, "lease", None, None, None), ("b", at(0), 2, "submit", None, 2, 2000), ("b", at(0), 3, "submit", None, 2, 2000)],
        [("z", at(10), 4, "submit", None, 2, 2000)],
        [("a", at(11), 5, "ack", 1, None, None), ("b", at(11), 6, "lease", None, None, None), ("b", at(11), 7, "nack", 1, None, None), ("b", at(11.5), 8, "lease", None, None, None)],
        [("z", at(30), 9, "submit", None, 2, 2000)],
    ]
    src = tmp_path / "src"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src / f"b{i}"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
        q = lifecycle(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {(r.job_id, r.event, r.lease_seq) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert {("a", "created", 0), ("a", "granted", 1), ("a", "expired", 1), ("a", "done", 1), ("b", "duplicate", 0), ("b", "requeued", 1), ("b", "none", 1)} <= got


def log_of(spark, records, folder):
    """Records written as one node's log, read again as operator rows."""
    wal.register(spark)
    schema = spark.read.format("oplogue_wal").option("dirs", str(folder)).load().schema
    rows = [tuple((tuple(r["job"].values()) if r["job"] else None) if f.name == "job" else r.get(f.name) for f in schema) for r in records]
    spark.createDataFrame(rows, schema).coalesce(1).write.format("oplogue_wal").option("path", str(folder)).option("segment_bytes", 400).mode("append").save()
    return wal.log_dirs(str(folder))[0]


def about(kind, number, **kw):
    return rec(kind, **kw) | {"job_id": f"{number:032x}"}


def held(key, **kw):
    return JOB | {"idem_key": key} | kw


def test_audit_of_real_logs(spark, tmp_path):
    """Two nodes' logs, lists with odd lines, and the verdict: a loss, a double completion, a twin, an unexplained delivery."""
    first = [
        about(1, 1, job=held("k1")), about(3, 1, epoch=1, lease_seq=1), about(4, 1, epoch=1, lease_seq=1), about(1, 2, job=held("k2")), about(3, 2, epoch=1, lease_seq=1),
        about(1, 3, job=held("k3")), about(3, 3, epoch=1, lease_seq=1), about(4, 3, epoch=1, lease_seq=1), about(1, 4, job=held("k4")), about(6, 4, epoch=1), about(1, 5, job=held("k5")), about(4, 5, epoch=1, lease_seq=1),
    ]
    second = [
        about(2, 1, job=held("k1")), about(7, 3, epoch=2, new_owner="192.0.2.8:7400"), about(3, 3, epoch=2, lease_seq=2), about(4, 3, epoch=2, lease_seq=2), about(1, 9, job=held("k5")), about(4, 9, epoch=1, lease_seq=1),
    ]
    dirs = [log_of(spark, first, tmp_path / "n1"), log_of(spark, second, tmp_path / "n2")]
    log = wal.operator_rows(spark.read.format("oplogue_wal").option("dirs", ",".join(dirs)).load())
    (tmp_path / "s").write_text("".join(f"k{i},{i:032x},201\n" for i in (1, 2, 3, 4, 5)) + "k7,ff,503\nbad\n")
    (tmp_path / "r").write_text("1 k1 1 /in 2\n2 k3 1 /in 2\n3 k3 2 /in 2\n4 k5 1 /in 2\n5 k5 1 /in 2\n6 - 1 /in 2\n7 k4 1 /in 2\n8 k4 1 /in 2\nodd\n")
    accepted, receipts = lines.accepted(lines.lines(spark, str(tmp_path / "s"))), lines.receipts(lines.lines(spark, str(tmp_path / "r")))
    got = audit.summary(log, accepted, receipts)
    row = got.first().asDict()
    assert row == {
        "logs": 2, "accepted": 5, "lost": 2, "dead_letter": 1, "delivered_keys": 5, "duplicate_deliveries": 3, "fallback_twins": 1, "unexplained": 1, "jobs_seen": 6, "double_done": 1, "passed": False,
    }
    assert audit.summary(log, accepted, receipts, allow_dlq=True).first().lost == 1
    said = audit.verdict_line(got).first()
    assert said.exit_code == 1 and said.line == "FAIL: accepted=5 lost=2 dead_letter=1 double_done=1 unexplained=1"
    jobs = {(r.node.split("-")[0], int(r.job_id, 16)): r for r in replay.replay(log).collect()}
    assert {k[1]: v.state for k, v in jobs.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 9: 3} or len(jobs) == 7
    first_list = spark.createDataFrame([], accepted.schema)
    assert audit.summary(log.limit(0), first_list, receipts.limit(0)).first().passed


def test_owner_after_takeover_and_fences(spark, tmp_path):
    folder = log_of(spark, [about(1, 1, job=held("k", owner="192.0.2.7:7400")), about(7, 1, epoch=2, new_owner="192.0.2.8:7400"), about(4, 1, epoch=2, lease_seq=0)], tmp_path / "n")
    job = replay.replay(wal.operator_rows(spark.read.format("oplogue_wal").option("dirs", folder).load())).first()
    assert (job.state, job.epoch, job.owner, job.body) == (3, 2, "192.0.2.8:7400", "")
    jobs = spark.createDataFrame([("a", "x", 2, ["x", "y", ""])], "job_id string, owner string, epoch long, replicas array<string>")
    said = spark.createDataFrame([("a", "x", 1, False), ("a", "y", 2, False), ("a", "y", 2, True), ("a", "x", 2, False), ("b", "x", 9, False)], "job_id string, sender string, epoch long, takeover boolean")
    assert [r.status for r in fences.apply_outcome(said.coalesce(1), jobs).orderBy("job_id", "epoch", "sender", "takeover").collect()] == ["stale_epoch", "created", "not_owner", "created", "unknown_job"]


def test_metrics_rules(spark):
    cum = spark.createDataFrame([(0.5, 4), (1.0, 6)], "le double, cum long")
    more = spark.createDataFrame([(10,)], "count long")
    assert [r.value for r in metrics.quantiles(cum, [], [0.4, 0.9], counts=more).orderBy("q").collect()] == [500.0, 1000.0]  # past all buckets: the last bound
    samples = spark.createDataFrame([("a", t, v) for t, v in [(0, 0.0), (15, 15.0), (30, 30.0), (45, 5.0), (60, 20.0)]], "s string, at long, value double")
    got = {r.at: round(r.increase, 6) for r in metrics.over_range(samples, ["s"], 60, 60).collect()}
    assert got[60] == round((15 + 5 + 15) * (45 + 15 + 0) / 45, 6)  # (0, 60]: 15 to 30, reset to 5, to 20; half a gap or less added at the ends
    tie = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0)], "s string, at long, value double")
    assert metrics.latest(tie, ["s"]).first().value == 3.0


def test_a_long_series_is_cut_into_ranges(spark):
    rng = random.Random(3)
    at = sorted(rng.choices(range(-500, 4000), k=300)) + [9000, 9059, 9061]
    rows = [(rng.choice("ab"), t, float(rng.randrange(50))) for t in at]
    held = {}
    for s, t, v in sorted(rows):
        held.setdefault(s, []).append((t, v))
    want = {}
    for s, own in held.items():
        for ev in range(-600, 9300, 15):
            some = [k for k, (t, _) in enumerate(own) if ev - 60 < t <= ev]
            if len(some) < 2 or own[some[-1]][0] == own[some[0]][0]:
                continue
            up = sum(own[k][1] if own[k][1] < own[k - 1][1] else own[k][1] - own[k - 1][1] for k in some[1:])
            t0, t1 = own[some[0]][0], own[some[-1]][0]
            gap, head, tail = (t1 - t0) / (len(some) - 1), t0 - ev + 60, ev - t1
            head = gap / 2 if head >= gap * 1.1 else head
            head = min(head, (t1 - t0) * own[some[0]][1] / up) if up > 0 else head
            tail = gap / 2 if tail >= gap * 1.1 else tail
            want[s, ev] = round(up * ((t1 - t0 + head + tail) / (t1 - t0)), 6)
    ranged = metrics.over_range(spark.createDataFrame(rows, "s string, at long, value double"), ["s"], 60, 15)
    assert {(r.s, r.at): round(r.increase, 6) for r in ranged.collect()} == want
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(s#" in plan and not re.search(r"hashpartitioning\(s#\d+, \d+\)", plan)  # nothing is dealt by the series alone


def test_small_functions(spark):
    r = spark.range(1).select(
        codes.endpoint(F.lit(0xC0000207).cast("bigint"), F.lit(7400)).alias("a"), codes.endpoint_parts(F.lit("192.0.2.7:7400")).alias("b"), codes.endpoint_parts(F.lit("nowhere")).alias("c"),
        codes.next_port(F.lit("192.0.2.7:7400"), 1).alias("d"), codes.segment_lsn(F.lit("wal-00000000000000000042.log")).alias("e"), codes.segment_lsn(F.lit("x")).alias("f"),
        text.header_map(F.array(F.lit("A: 1"), F.lit("bad"), F.lit("a:  2"))).alias("g"), text.lower_ascii(F.lit("ÄBc")).alias("h"), text.bounded(F.lit(9), 0, 5).alias("i"),
        codes.reason(F.lit(404)).alias("j"), codes.delivered(F.lit(204)).alias("k"), codes.retry_ack(F.lit(503)).alias("l"), codes.is_job_id(F.lit("0" * 32)).alias("m"), codes.delta_or_zero(F.lit(1), F.lit(2)).alias("n"),
        codes.bucket_bound(F.lit(16)).alias("o"), text.bucket_line("x", F.lit(0.5), F.lit(3)).alias("p"), text.captured(F.lit('{"id":"q"}'), "id").alias("q"),
        text.histogram_lines("h", F.array(F.lit(0.5), F.lit(1e18)), F.array(F.lit(1), F.lit(2)), F.lit(0.25), F.lit(2)).alias("r"), placement.fallback(F.lit("a"), F.array(*map(F.lit, "abcd"))).alias("s"),
        text.counter_line("c", "", F.lit(3)).alias("t"), text.gauge_line("g", '{s="r"}', F.lit(1.5)).alias("u"),
    ).first()
    assert r.a == "192.0.2.7:7400" and tuple(r.b) == (0xC0000207, 7400) and r.c is None and r.d == "192.0.2.7:7401" and (r.e, r.f) == (42, None)
    assert r.g == {"a": "2"} and r.h == "Äbc" and r.i == 5 and r.j == "Not Found" and r.k and r.l and r.m and r.n == 0 and abs(r.o - 65.536) < 1e-9
    assert r.p == 'x_bucket{le="0.500"} 3' and r.q == "q" and r.r == ['h_bucket{le="0.500"} 1', 'h_bucket{le="+Inf"} 2', "h_sum 0.250000", "h_count 2"] and r.s == ["a", "b", "c"]
    assert r.t == "c 3" and r.u == 'g{s="r"} 1.500000'


def test_load_runs_and_files(spark, tmp_path):
    run = spark.createDataFrame([(100, 5, 5, 0, 5, 1.25, 2.0, 3.04)], "rate int, offered long, accepted long, errors long, completed long, p50_ms double, p95_ms double, p99_ms double")
    line = loads.bench_line(run).first().value
    (tmp_path / "b.csv").write_text("rate,offered,accepted,errors,completed,p50_ms,p95_ms,p99_ms\n" + line + "\n100,5,4,1,4,1,2,-1\n")
    back = lines.bench(spark, str(tmp_path / "b.csv"))
    assert line == "100,5,5,0,5,1.3,2.0,3.0" and metrics.publishable(back).count() == 1
    assert loads.settled(lambda: True) and not loads.settled(lambda: False, 0.02, 0.01)
    (tmp_path / "l").write_text("a,1\nb,1\nc,2\nx\n")
    assert tuple(loads.line_counts(lines.lines(spark, str(tmp_path / "l")), F.col("value").contains(",")).first()) == (3, 2)
    got = spark.createDataFrame([(5, None, "2", "/in", 3), (6, "k", "", "/in", 0)], "mono_ms long, key string, attempt string, path string, bytes long")
    assert sorted(r.value for r in lines.receipt_lines(got).collect()) == ["5 - 2 /in 3", "6 k - /in 0"]
    s = lines.submit_stream(spark, 3, 4).collect()
    assert [(r.key, r.gateway) for r in s] == [("k-3", 13), ("k-4", 14), ("k-5", 10), ("k-6", 11)]
    assert 0 < lines.with_faults(spark.range(500), 0.3, 1).where("failed").count() < 500
    view = leases.lease_view(spark.createDataFrame([("a", "u", b"x", "k", 1, 2, 3)], "job_id string, url string, body binary, idem_key string, epoch long, lease_seq long, visibility_ms long"))
    assert view.columns == ["job_id", "url", "body", "idem_key", "epoch", "lease_seq", "visibility_ms", "attempt"]


def test_delivery_sink(spark, tmp_path):
    from oplogue.streaming.delivery import delivery_sink

    tried = str(tmp_path / "tried")

    def post(url, headers, body):
        with open(tried, "a+") as f:
            f.write(f"{url} {headers.get('Idempotency-Key', '-')}\n")
            f.seek(0)
            seen = sum(line.startswith(url + " ") for line in f)
        return (503 if seen < 3 else 200) if "/ack" in url else 500 if "bad" in url else 204

    jobs = [("a", "http://h/ok", "k1", 1, 1, 1, b"x"), ("b", "http://h/bad", "k2", 2, 1, 2, None)]
    spark.createDataFrame(jobs, "job_id string, url string, idem_key string, attempt long, epoch long, lease_seq long, body binary").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(delivery_sink(post, "http://h/ack", str(tmp_path / "out"), wait=0.0)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.job_id: (r.code, r.ok, r.ack_code, r.ack_tries) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": (204, True, 200, 3), "b": (500, False, 200, 3)}


def test_owner_queue_stream(spark, tmp_path):
    """Queue order, validation, gates, tokens with epochs, expiry, hand-over and adoption, over several batches."""
    import datetime as dt

    from oplogue.streaming.owner import EVENTS, owner_queue

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    n = iter(range(1000))

    def ev(owner, s, event, job=None, key=None, epoch=None, seq=None, most=None, visible=None, reach=None):
        return (owner, at(s), next(n), event, job, key, epoch, seq, most, visible, reach)

    batches = [
        [ev("A", 0, "submit", "j1", "k1", most=2, visible=2000), ev("A", 0, "submit", "j2", "k2", visible=2000), ev("A", 0, "submit", "j9", "k1"), ev("A", 0, "submit", "j8", "x" * 65),
         ev("A", 1, "poll", reach=False), ev("A", 1, "poll", reach=True), ev("B", 1, "poll", reach=True)],
        [ev("A", 2, "poll", reach=True), ev("A", 2, "nack", "j2", epoch=1, seq=1), ev("A", 2.5, "poll", reach=True), ev("A", 2.6, "ack", "j2", epoch=1, seq=9)],
        [ev("A", 4, "ack", "j2", epoch=1, seq=1), ev("A", 4, "poll", reach=True), ev("A", 4.5, "claim", "j1", epoch=1), ev("A", 4.6, "claim", "j1", epoch=2), ev("B", 5, "adopt", "j1", epoch=2, seq=2, most=2, visible=1000)],
        [ev("B", 5.5, "poll", reach=True), ev("B", 7, "poll", reach=True), ev("B", 8, "ack", "j1", epoch=1, seq=2), ev("B", 8, "ack", "j1", epoch=1, seq=2), ev("A", 9, "ack", "j1", epoch=1, seq=2)],
    ]
    src = tmp_path / "src"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, EVENTS).coalesce(1).write.mode("append").parquet(str(src / f"b{i}"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
        q = owner_queue(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        rows = spark.read.parquet(str(tmp_path / "o")).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted((r.owner, r.at_ms % 1_000_000, r.event, r.job_id, r.epoch, r.lease_seq) for r in rows)
    base = 1704067200000 % 1_000_000
    said = [(o, (t - base) / 1000, e, j, ep, s) for o, t, e, j, ep, s in got]
    want = {
        ("A", 0.0, "created", "j1", 1, 0), ("A", 0.0, "created", "j2", 1, 0), ("A", 0.0, "duplicate", "j1", 1, 0), ("A", 0.0, "invalid", "j8", None, None), ("A", 1.0, "no_quorum", "j1", 1, 0),
        ("A", 1.0, "granted", "j1", 1, 1), ("B", 1.0, "no_job", None, None, None), ("A", 2.0, "granted", "j2", 1, 1), ("A", 2.0, "requeued", "j2", 1, 1), ("A", 2.5, "no_job", None, None, None),
        ("A", 2.6, "not_leased", "j2", 1, 1), ("A", 3.0, "expired", "j1", 1, 1), ("A", 4.0, "done", "j2", 1, 1), ("A", 4.0, "granted", "j1", 1, 2), ("A", 4.5, "stale_epoch", "j1", 1, 2),
        ("A", 4.6, "handed_over", "j1", 2, 2), ("B", 5.0, "adopted", "j1", 2, 2), ("B", 5.5, "no_job", None, None, None), ("B", 6.0, "expired", "j1", 2, 2), ("B", 7.0, "no_job", None, None, None),
        ("B", 8.0, "done", "j1", 2, 2), ("B", 8.0, "ok", "j1", 2, 2), ("A", 9.0, "unknown", "j1", None, None),
    }
    assert set(said) == want


def test_request_outcomes(spark):
    import datetime as dt

    from oplogue.operators import requests

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    asked = spark.createDataFrame(
        [(1, "p", at(0), 10), (2, "p", at(10), 10), (3, "p", at(20), 99), (4, "q", at(0), 10), (5, "r", at(0), 10), (6, "r", at(0.1), 10), (7, "r", at(0.2), 10), (8, "p", at(30), 10)],
        "req_id long, peer string, sent timestamp, bytes long",
    )
    got = spark.createDataFrame([("p", at(0)), ("p", at(16)), ("r", at(1)), ("p", at(30.4))], "peer string, got timestamp")
    died = spark.createDataFrame([("q", at(2)), ("p", at(30.2))], "peer string, died timestamp")
    rows = requests.outcomes(asked, got, 5000, died, most_bytes=50, in_flight=2).collect()
    assert {r.req_id: r.outcome for r in rows} == {1: "ok", 2: "timeout", 3: "too_large", 4: "peer_down", 5: "ok", 6: "ok", 7: "busy", 8: "peer_down"}
    assert {r.req_id: r.got for r in rows}[1] == at(0) and {r.req_id: r.got for r in rows}[2] is None
