import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from oplogue.llm.common import shared_folder
from oplogue.llm.exact_dedup import STATE, exact_dedup, keep_last

from .fixtures import SCHEMA, awkward, table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOW)].append(r[0])
    return sorted(
        ((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids),
        key=str,
    )


def check(found, rows):
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == sorted(((a, b, c) for a, b, c, _ in brute(rows)), key=str)
    groups = len({(r[1] or "").translate(LOW) for r in rows})
    assert sum(r.kept for r in found) == groups
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_matches_brute_force(spark):
    rows = awkward()
    found = exact_dedup(table(spark, rows)).collect()
    check(found, rows)
    assert sorted(((r.doc_id, r.digest) for r in found), key=str) == sorted(((a, d) for a, _, _, d in brute(rows)), key=str)


def test_state_carries_over_batches_and_files(spark, tmp_path):
    rows = awkward(2)
    table(spark, rows).repartition(5).write.parquet(str(tmp_path / "d"))
    check(exact_dedup(spark.read.parquet(str(tmp_path / "d")), files_per_batch=1).collect(), rows)


def test_a_second_call_meets_the_state_of_the_first(spark, tmp_path):
    first, more = awkward(2), [(i + 5000 if i is not None else None, *r) for i, *r in awkward(2)[::2]] + [(9000, "quite new", "en", "q", 1)]
    data, folder = str(tmp_path / "d"), shared_folder(spark, "lasting")
    table(spark, first).repartition(3).write.parquet(data)
    check(exact_dedup(spark.read.parquet(data), folder=folder).collect(), first)
    table(spark, more).repartition(2).write.mode("append").parquet(data)
    check(exact_dedup(spark.read.parquet(data), folder=folder).collect(), first + more)
    out = spark.read.schema(STATE).parquet(f"{folder}/digests")
    texts = lambda rows: {(r[1] or "").translate(LOW) for r in rows}
    assert out.where("batch = 0").count() == len(texts(first)) and out.where("batch > 0").count() == len(texts(more))
    again = exact_dedup(spark.read.parquet(data), folder=folder, digest=lambda t: F.substring(F.sha2(t, 256), 1, 64))
    check(again.collect(), first + more)
    assert spark.read.parquet(f"{folder}/intake").count() == len(first + more)


def test_kept_rows_stay_as_they_are(spark, tmp_path):
    rows = [r[:5] for r in awkward(5)]
    odd = table(spark, rows, "doc_id long, text string, lang string, file string, row long").withColumn("_metadata", F.lit("x")).withColumn("doc", F.lit(1))
    odd.write.parquet(str(tmp_path / "d"))
    for docs in (odd, spark.read.parquet(str(tmp_path / "d"))):
        kept = keep_last(docs)
        assert kept.columns == docs.columns
        got = kept.collect()
        assert len(got) == len({(r[1] or "").translate(LOW) for r in rows})
        best = {(t or "").translate(LOW): i for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))}
        assert all(best[(r.text or "").translate(LOW)] == r.doc_id for r in got)


def test_very_long_texts(spark):
    rows = [(i, "Long Text " * 400_000 + "x" * (i % 2), "en", "q", 1) for i in range(4)]
    check(exact_dedup(table(spark, rows)).collect(), rows)


def test_colliding_digests_are_told_apart_by_bytes(spark):
    rows = awkward(3)
    check(exact_dedup(table(spark, rows), digest=lambda t: F.substring(F.sha2(t, 256), 1, 1), files_per_batch=2).collect(), rows)


def test_empty_table(spark):
    assert exact_dedup(table(spark, [], SCHEMA)).collect() == []
