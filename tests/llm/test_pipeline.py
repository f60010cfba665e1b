"""run() on a small table against a version that holds everything in one process."""

import hashlib
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from oplogue.llm import mixing, pieces, quality_rules

from .fixtures import awkward, table
from .test_mixing import targets
from .test_quality_rules import posteriors
from .test_simhash import roots

pytest.importorskip("public_tokenizers")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def measured(text):
    t, words = text or "", words_of(text)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return dict(
        n_words=len(words), word_chars=sum(map(len, words)), n_symbols=len(re.findall(r"[#*$%&|<>]", t)), n_lines=len(lines),
        n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(again), n_upper=len(regex.findall(r"\p{Lu}", t)),
        n_marks=len(re.findall(r"[.,;:!?]", t)),
    )


def good(rows):
    m = pd.DataFrame([measured(r[1]) for r in rows])  # noqa: F841  read by DuckDB
    cases = ", ".join(f"case when {bad} then -1 when {fine} then 1 else 0 end" for bad, fine in quality_rules.RULES.values())
    got = duckdb.sql(f"select {quality_rules.FAILED} f, [{cases}] v from m").fetchall()
    post = posteriors([tuple(v) for f, v in got if not f])
    return [r for r, (f, v) in zip(rows, got, strict=True) if not f and post[tuple(v)] >= 0.5]


def last_of_equal(rows):
    lower = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    best = {}
    for r in rows:
        k = (r[1] or "").translate(lower)
        if k not in best or (r[0] is not None, r[0] or 0) > (best[k][0] is not None, best[k][0] or 0):
            best[k] = r
    return list(best.values())


def one_of_near(rows):
    group = roots([r[1] for r in rows])
    return [min((r for r, g in zip(rows, group, strict=True) if g == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in set(group)]


def mixed(spark, rows):
    size, total = {r[0]: len(words_of(r[1])) for r in rows}, Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    want, order = targets(total), sorted(total, key=lambda s: (s is None, s or ""))
    won = Counter()
    for _ in range(int(sum(total.values()) / mixing.BLOCK + 0.5)):  # a seat at a time
        won[max(order, key=lambda s: (want[s] / (2 * won[s] + 1), -order.index(s)))] += 1
    hashes = {r.doc_id: r.h for r in table(spark, rows, DOCUMENTS).select("doc_id", F.xxhash64("doc_id", F.md5("text"), F.lit(mixing.SEED)).alias("h")).collect()}
    out = []
    for rank, s in enumerate(order):
        own = [r for r in rows if r[3] == s]
        n_shards = max(-(-total[s] // mixing.SHARD), -(-len(own) // mixing.ROWS))
        assert n_shards == 1
        blocks = max(int(total[s] / mixing.BLOCK + 0.5), 1)
        quota = min(won[s], mixing.LIMIT * blocks)
        offset = (mixing.SEED * 7919 + rank * 104729) % blocks
        times = [quota // blocks + ((j * mixing.STEP + offset) % blocks < quota % blocks) for j in range(blocks)]
        of = [j for j in range(blocks) for _ in range(j * total[s] // blocks, (j + 1) * total[s] // blocks)]
        at = 0
        for r in sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)):
            n = size[r[0]]
            share = sum(times[of[k]] for k in range(at, at + n)) / max(n, 1)
            at += n
            out += [r] * (int(share) + ((hashes[r[0]] % (1 << 20)) / (1 << 20) < share - int(share)))
    return out


def digested(rows):
    lib, out = pieces.PieceCodec(pieces.model_path()).lib, []
    for r in rows:
        ids = lib.encode(r[1] or "")
        out.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((lib.decode(ids) if ids else "").encode()).hexdigest()))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in awkward(4, 100)]
    rows += [(900 + i, "#$% word | * & <x> " * (12 + i), "en", "a", 1) for i in range(6)]
    table(spark, rows, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = one_of_near(last_of_equal(good(rows)))
    assert 20 < len(kept) < len(rows) and len({r[0] for r in kept}) == len(kept)
    want = digested(mixed(spark, kept))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len({r[0] for r in want}) > 20 and sorted(got, key=str) == sorted(want, key=str)


def test_stages_keep_columns_whose_names_clash(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, file string, row long, doc string, shard long, words string, key long, root long, _metadata string"
    docs = table(spark, [r[:5] for r in awkward(4, 40)], names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_empty_table(spark, tmp_path):
    table(spark, [], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
