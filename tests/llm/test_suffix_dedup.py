import hashlib
import random
from collections import Counter

import pytest

from oplogue.llm import suffix_dedup
from oplogue.llm.common import shared_folder

from .fixtures import awkward, table


def brute(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéfghij") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(1, 80)) for _ in range(3)]
        for s in rng.sample(shared, rng.randint(0, 2)):
            cut = rng.choice([0, 5, 50, 150])
            parts.insert(rng.randint(0, 3), s[cut : len(s) - rng.choice([0, 7, 120])])
        rows.append((3000 + i, rng.choice([" ", ""]).join(parts), "en", "p", 1))
    exact = text(80)[:200]
    return rows + [(4000, "q" + exact + "r", "en", "p", 1), (4001, "s" + exact + "t", "en", "p", 1), (4002, exact[:199], "en", "p", 1), (4003, "z" * 1000, "en", "p", 1), (4004, "ab" * 150, "en", "p", 1)]


@pytest.mark.parametrize(("batches", "hot"), [(3, 20_000), (5, 1)])
def test_matches_brute_force(spark, batches, hot):
    rows = awkward(8, 30) + passages(batches)
    got = suffix_dedup.suffix_dedup(table(spark, rows), batches=batches, hot=hot).collect()
    want = sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]), strict=True)), key=str)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    assert any(w[2] for w in want)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_empty_table(spark):
    assert suffix_dedup.suffix_dedup(table(spark, [])).collect() == []


def test_no_python_task_holds_a_hot_suffix(spark, monkeypatch):
    def none_come(batches):
        for b in batches:
            assert not b.num_rows
            yield b.select([])

    monkeypatch.setattr(suffix_dedup, "_repeats", none_come)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    same, longer = text(150), text(40)
    rows = [(i, text(300) + same + (longer if i % 5 == 0 else "") + text(300), "en", "p", 1) for i in range(60)]
    got = suffix_dedup.suffix_dedup(table(spark, rows + [(None, rows[7][1][200:620], "en", "p", 1)]), hot=1).collect()
    want = brute([r[1] for r in rows] + [rows[7][1][200:620]])
    assert sorted((tuple(r)[1:5] for r in got), key=str) == sorted(want, key=str) and any(w[1] for w in want)


def removed(docs, **kw):
    return sorted((tuple(r)[:5] for r in suffix_dedup.suffix_dedup(docs, **kw).collect()), key=str)


def test_two_calls_equal_one_over_the_union(spark, tmp_path):
    first, more, data, folder = passages(1), passages(2) + passages(1)[:5] + [(None, passages(1)[7][1][50:400], "en", "p", 1)], str(tmp_path / "d"), shared_folder(spark, "index")
    table(spark, first).repartition(2).write.parquet(data)
    assert removed(spark.read.parquet(data), folder=folder) == sorted(((r[0], *b) for r, b in zip(first, brute([r[1] for r in first]), strict=True)), key=str)
    table(spark, more).repartition(2).write.mode("append").parquet(data)
    both = first + more
    want = sorted(((r[0], *b) for r, b in zip(both, brute([r[1] for r in both]), strict=True)), key=str)
    assert removed(spark.read.parquet(data), folder=folder) == want == removed(spark.read.parquet(data))
    family = suffix_dedup.IndexFamily(spark, folder)
    assert [size for size, _ in family.levels] == [1, 1] and len(family.found) == len(family.taken) == 2
    table(spark, [(9, "q" * 500, "en", "p", 1)]).write.mode("append").parquet(data)
    removed(spark.read.parquet(data), folder=folder)
    family = suffix_dedup.IndexFamily(spark, folder)
    assert [size for size, _ in family.levels] == [2, 1]
    assert removed(spark.read.parquet(data), folder=folder) == removed(spark.read.parquet(data))
    level = [bytes(r.prefix) for r in family._level(family.levels[0][1]).orderBy("prefix").collect()]
    assert level == sorted(set(level)) and all(len(x) == suffix_dedup.ANCHOR for x in level)


def test_pieces_of_long_texts_and_hashes_that_collide(spark, monkeypatch):
    import numpy as np

    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    shared = text(700)
    texts = [text(2000) + shared + text(900), shared[100:] + text(3000), text(500) + shared[:350], "xy" * 900]
    want = [suffix_dedup.suffixes([t.encode()])[:7] for t in texts]
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    for t, w in zip(texts, want, strict=True):
        windows = {(a, k) for a, f, e in zip(w[1].tolist(), w[2].tolist(), w[3].tolist(), strict=True) for k in range(f, e + 1)}
        got = set()
        for some in suffix_dedup._pieces([t]):
            d, at, f, e, *_ = suffix_dedup.suffixes([x[2] for x in some])
            got |= {(a + some[i][1], k + some[i][1]) for i, a, s, z in zip(d.tolist(), at.tolist(), f.tolist(), e.tolist(), strict=True) for k in range(s, z + 1)}
        assert got == windows
    data = np.frombuffer((shared + shared[:400] + text(400)).encode(), np.uint8)
    at = np.arange(len(data) - 199)
    classes = suffix_dedup._classes(np.zeros(len(at), np.uint64), data, at)
    by = {}
    assert all(by.setdefault(data[i : i + 200].tobytes(), c) == c for i, c in zip(at, classes.tolist(), strict=True)) and len(set(by.values())) == len(by)


def test_a_very_long_text(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(200_000)]
    long = " ".join(rng.choice(words) for _ in range(1_500_000))
    at = 5_000_000
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(spark.createDataFrame([(1, long), (2, "qqq " + long[at : at + 600] + " rrr")], "doc_id long, text string")).collect()}
    assert got[1] == got[2] and 600 <= got[1] <= 602


def test_a_piece_takes_little_memory():
    import tracemalloc

    raw = bytes(random.Random(9).choices(range(97, 123), k=suffix_dedup.PIECE))
    tracemalloc.start()
    suffix_dedup.suffixes([raw])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
