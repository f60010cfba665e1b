import math
import random
import re
from collections import Counter

import duckdb

from oplogue.llm import quality_rules

from .fixtures import SCHEMA, awkward, table


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(win)
    hit = {i + k for i, x in enumerate(win) if c[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures_and_base_rule(spark):
    rows = awkward() + [(400, "one two three four five six seven eight nine " * 9, "en", "q", 1), (401, "a#b *c|d\na#b\n\na#b\n" * 9, "en", "q", 1)]
    found = quality_rules.quality(table(spark, rows)).collect()
    got = sorted(((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def posteriors(votes, rounds=40):
    """Votes of each document -> chance by votes, one document at a time."""
    post = [0.95 if min(v) >= 0 else 0.05 for v in votes]
    for _ in range(rounds):
        good, odds = sum(post), []
        prior = math.log((good + 1) / (len(votes) - good + 1))
        for j in range(len(votes[0]) if votes else 0):
            g = [p for v, p in zip(votes, post, strict=True) if v[j] < 0], [p for v, p in zip(votes, post, strict=True) if v[j] > 0]
            wrong = (sum(g[0]) + 1) / (sum(g[0]) + sum(g[1]) + 100)
            right = (sum(1 - p for p in g[0]) + 3) / (sum(1 - p for p in g[0] + g[1]) + 6)
            odds.append({-1: math.log(wrong / right), 0: 0.0, 1: math.log((1 - wrong) / (1 - right))})
        post = [1 / (1 + math.exp(-(prior + sum(o[x] for o, x in zip(odds, v, strict=True))))) for v in votes]
    return dict(zip(votes, post, strict=True))


def test_posterior_equals_a_plain_loop():
    rng = random.Random(1)
    for wrong_about_bad in (0.1, 0.8):  # the second is a rule that knows nothing
        votes = []
        for _ in range(1500):
            bad = rng.random() < 0.1
            against = [0.9, 0.85, 1 - wrong_about_bad] if bad else [0.01, 0.02, 0.005 if wrong_about_bad < 0.5 else 0.2]
            votes.append(tuple(0 if rng.random() < 0.1 else -1 if rng.random() < a else 1 for a in against))
        prior, add = quality_rules.fit(sorted(Counter(votes).items()))
        want = posteriors(votes)
        assert all(abs(quality_rules.chance(prior, add, v) - p) < 1e-9 for v, p in want.items())
        assert want[1, 1, 1] > 0.7 > 0.2 > want[-1, -1, 1]
    assert abs(add[2][0]) < 0.5 < 3 < -add[0][0]  # the useless rule weighs little
    assert quality_rules.fit([]) == (0.0, [])


def test_sql_agrees_and_rows_are_kept_as_they_are(spark, tmp_path):
    rows = [r[:5] for r in awkward(3, 100)] + [(400 + i, "a#b *c|d\na#b\n\nword " * 20, "en", "q", 1) for i in range(9)] + [(500, "one two three, " * 200_000, "en", "q", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    df = table(spark, rows, names)
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in quality_rules.op6_quality_rules(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.sql(quality_rules.ORACLE).fetchall(), key=str)
    kept = Counter(r[0] for r in got if r[-1])
    clash = table(spark, rows, SCHEMA.replace("digest string", "file string").replace("fp long", "row long"))
    for docs in (clash, spark.read.parquet(str(tmp_path / "documents.parquet"))):
        out = quality_rules.keep_quality(docs)
        assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == kept


def test_empty_table(spark):
    assert quality_rules.quality(table(spark, [], SCHEMA)).collect() == []
