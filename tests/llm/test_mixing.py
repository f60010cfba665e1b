import re
from collections import Counter

from oplogue.llm import mixing

from .fixtures import awkward, table


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        share = total - sum(3 * sizes[s] for s in full)
        t = {s: share * w[s] / sum(w[x] for x in rest) for s in rest} | {s: 3.0 * sizes[s] for s in full}
        over = {s for s in rest if t[s] > 3 * sizes[s]}
        if not over:
            return t
        full |= over


def test_targets_and_taken(spark):
    rows = awkward(9)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    want = targets(total)
    for _ in range(2):
        got = mixing.taken(mixing.sizes(table(spark, rows)), block=16, shard=2000).collect()
        assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
        used = Counter()
        for r in got:
            assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == total[r.source] and 0 <= r.taken <= 3 * r.size
            used[r.source] += r.taken
        for s, n in used.items():
            assert abs(n - want[s]) <= 3 * 16
        again = sorted((str(r.doc_id), r.size, r.taken) for r in got)
        assert again == sorted((str(r.doc_id), r.size, r.taken) for r in mixing.taken(mixing.sizes(table(spark, rows)), block=16, shard=2000).collect())


def test_empty_table(spark):
    assert mixing.taken(mixing.sizes(table(spark, []))).collect() == []


def test_seats_equal_one_at_a_time_with_many_small_parties(spark):
    from pyspark.sql import functions as F

    cases = {
        "a": ([1000.0] + [0.6] * 1000, 1600), "b": ([1000.0] + [0.4] * 1000, 1400), "c": ([5.0, 0.0, 3.0, 3.0, 1.0], 7),
        "d": ([2.0, 2.0, 2.0], 1), "e": ([0.0, 0.0], 3), "f": ([7.0, 1.0], 0), "g": ([1.0 * i for i in range(300)], 90),
    }
    df = spark.createDataFrame([(g, i, v, n) for g, (votes, n) in cases.items() for i, v in enumerate(votes)], "g string, i int, v double, n long")
    got = {(r.g, r.i): r.quota for r in mixing.sainte_lague(df, ["g"], ["i"], "v", F.col("n")).collect()}
    for g, (votes, n) in cases.items():
        won = [0] * len(votes)
        for _ in range(n if any(votes) else 0):
            won[max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
        assert [got[g, i] for i in range(len(votes))] == won
    assert got["a", 0] == 833 and got["b", 0] == 1250


def quotas_one_at_a_time(votes, n):
    won = {k: 0 for k in votes}
    for _ in range(n if any(votes.values()) else 0):
        won[max(sorted(votes), key=lambda k: votes[k] / (2 * won[k] + 1))] += 1
    return won


def taken_brute(rows, block, shard, most_rows, seed=mixing.SEED):
    """Shards, quotas and blocks a word at a time."""
    import hashlib

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    want, order = targets(total), sorted(total, key=lambda s: (s is None, s or ""))
    won = quotas_one_at_a_time({i: want[s] for i, s in enumerate(order)}, int(sum(total.values()) / block + 0.5))
    out = {}
    for rank, s in enumerate(order):
        own = [i for i, r in enumerate(rows) if r[3] == s]
        n_shards = max(-(-total[s] // shard), -(-len(own) // most_rows))
        shards = {}
        for i in own:
            parts = [str(rows[i][0]) if rows[i][0] is not None else ""] + ([hashlib.md5(rows[i][1].encode()).hexdigest()] if rows[i][1] is not None else [])
            shards.setdefault(int(hashlib.md5(":".join(parts).encode()).hexdigest()[:8], 16) % n_shards, []).append(i)
        words = {k: sum(size[i] for i in v) for k, v in shards.items()}
        quota = quotas_one_at_a_time(words, won[rank])
        for k, some in shards.items():
            w, b = words[k], max(int(words[k] / block + 0.5), 1)
            q, offset = min(quota[k], 3 * b), (seed * 7919 + rank * 104729 + k * 1299709) % b
            of = [j for j in range(b) for _ in range(j * w // b, (j + 1) * w // b)]
            at = 0
            for i in sorted(some, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, size[i])):
                out[i] = sum(q // b + ((of[t] * mixing.STEP + offset) % b < q % b) for t in range(at, at + size[i]))
                at += size[i]
    return sorted((str(rows[i][0]), size[i], n) for i, n in out.items())


def test_taken_equals_a_word_at_a_time(spark):
    rows = [r for r in awkward(9) if r[0] != 309] + [(i, "word " * (i % 40), "en", f"s{i % 30}", 1) for i in range(1000, 1200)]
    got = mixing.taken(mixing.sizes(table(spark, rows)), block=16, shard=700, rows=25).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == taken_brute(rows, 16, 700, 25)


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rows = [r[:5] for r in awkward(9) if r[0] != 309] + [(2000, "word " * 300_000, "en", "long", 1)]
    df = table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((tuple(r) for r in mixing.op2_mixing(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.sql(mixing.ORACLE).fetchall(), key=str)
