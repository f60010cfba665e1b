import random
from pathlib import Path

import numpy as np
import xxhash

from oplogue.llm import simhash
from oplogue.llm.common import located, settings
from oplogue.llm.components import components

from .fixtures import awkward, table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, distance=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_matches_brute_force(spark):
    rows = awkward()
    found = simhash.near_duplicates(table(spark, rows)).collect()
    fps = [brute_fp(r[1]) for r in rows]
    c = brute_classes(fps)
    least = {}
    for r, x in zip(rows, c, strict=True):
        if r[0] is not None:
            least[x] = min(r[0], least.get(x, r[0]))
    want = sorted(((r[0], f, least.get(x)) for r, f, x in zip(rows, fps, c, strict=True)), key=str)
    assert sorted(((r.doc_id, r.fp & 2**64 - 1, r.component_id) for r in found), key=str) == want


def planted(rng, n, bits):
    seeds = [rng.getrandbits(64) for _ in range(n)]
    out = set(seeds)
    for s in seeds:
        x = s
        for _ in range(bits):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def signed(x):
    return x - 2**64 if x >> 63 else x


def classes_of(spark, fps, **kw):
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.component for r in components(simhash.links(df, **kw)).collect()}
    return [got.get(signed(x), signed(x)) for x in fps]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_links_lose_nothing(spark):
    fps = planted(random.Random(4), 40, 8)
    assert same_partition(classes_of(spark, fps), brute_classes(fps))


def test_dense_buckets_are_cut_finer(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    weak = rng.sample(range(64), 14)
    fps = {base}
    while len(fps) < 150:
        fps.add(base ^ sum(1 << b for b in weak if rng.random() < 0.35))
    fps = sorted(fps | set(planted(rng, 5, 4)))
    assert same_partition(classes_of(spark, fps, bucket=6), brute_classes(fps))


def test_empty_and_chain(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(None, 3), (7, 7)], "a long, b long")
    assert {r.component for r in components(chain).collect()} == {0}
    assert simhash.near_duplicates(table(spark, [])).collect() == []


def five_words(text):
    w = (text or "").encode().translate(simhash.A_TO_Z).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def roots(texts, similar=0.8):
    """Least place reachable over pairs of at least that Jaccard similarity; texts without words are alike."""
    own, root = [five_words(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            n = len(own[i] & own[j])
            if n >= similar * (len(own[i]) + len(own[j]) - n) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(own))]


def near(spark, texts, **kw):
    rows = located(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    got = {r.id: r.root for r in simhash.near_copies(rows, **kw).collect()}
    return [got[i] for i in range(len(texts))]


def test_near_copies_of_awkward_rows(spark):
    texts = [r[1] for r in awkward(3)] + ["Some words of a very long text " * 150_000] * 2
    assert same_partition(near(spark, texts), roots(texts))


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(words)), edits):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def test_near_copies_that_are_planted(spark):
    rng = random.Random(6)
    texts, pairs = [], []
    for k in range(150):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        for edits in (1, 2, 4):
            pairs.append((edits, len(texts), len(texts) + 1))
            texts += [" ".join(words), edited(rng, words, edits)]
            words = [f"v{rng.randrange(3000)}" for _ in range(200)]
    got, want = near(spark, texts), roots(texts)
    by_root = {}
    for g, w in zip(got, want, strict=True):
        assert by_root.setdefault(g, w) == w  # nothing is joined that is not alike
    found = lambda e: [got[a] == got[b] for k, a, b in pairs if k == e and want[a] == want[b]]
    assert [sum(found(e)) >= share * len(found(e)) for e, share in ((1, 0.95), (2, 0.85), (4, 0.6))] == [True] * 3


def test_a_large_group_of_near_copies_is_cut_finer(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = [edited(rng, words, 1) for _ in range(200)] + [f"quite other text {i} of its own words {i * 7}" for i in range(50)]
    assert same_partition(near(spark, texts, bucket=20), roots(texts))


def test_no_link_near_the_threshold_is_lost(spark):
    rng = random.Random(8)
    line = " ".join(f"common{k}" for k in range(12))
    texts = []
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 220))]
        more = edited(rng, words, min(4 * len(words) // 200 + 1, 4))
        texts += [" ".join(words) + " " + line, more + " " + line, " ".join(words[: -len(words) // 6]), " ".join(words)]
    texts += [line + f" own{k % 7} {k % 3}" for k in range(60)]
    want = roots(texts)
    assert len(set(want)) < len(texts) - 60
    for bucket in (5, 1000):
        assert same_partition(near(spark, texts, bucket=bucket), want)


def test_sets_of_texts_without_copies_are_not_written(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(300)) for _ in range(300)]
    rows = located(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    written, write = [], simhash.table

    def weighed(df, name, under=None):
        out = write(df, name, under)
        written.append(sum(Path(x.removeprefix("file:")).stat().st_size for x in out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "table", weighed)
    assert len({r.root for r in simhash.near_copies(rows).collect()}) == 300
    assert sum(written) < sum(map(len, texts)) / 3


def test_parities_differ_no_more_than_sets():
    rng = random.Random(10)
    for _ in range(200):
        both, a, b = ({rng.randrange(-(2**63), 2**63) for _ in range(rng.randrange(k))} for k in (300, 40, 40))
        one, other = (simhash.parity(np.array(sorted(both | x), np.int64)).view(np.uint64) for x in (a, b))
        assert np.bitwise_count(one ^ other).sum() <= len((both | a) ^ (both | b))
    assert not simhash.parity(np.empty(0, np.int64)).any()


def test_few_edges_are_few_tasks(spark):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with settings(spark, conf):
        found = components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long"))
        assert found.rdd.getNumPartitions() <= 41 and {r.component for r in found.collect()} == {0}


def written_rows(monkeypatch):
    """What near_copies writes, as (name, rows)."""
    written, write = [], simhash.table

    def counted(df, name, under=None):
        out = write(df, name, under)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(simhash, "table", counted)
    return written


def test_pairs_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = [edited(rng, words, 1 + k % 8) for k in range(400)]  # up to three edits of its own away from the first few
    written = written_rows(monkeypatch)
    assert same_partition(near(spark, texts), roots(texts))
    assert sum(n for name, n in written if name in ("tried", "more")) < 10 * len(texts)
    monkeypatch.setattr(simhash, "PAIRS_EACH", 0)  # the nearest of each, and then the others
    del written[:]
    assert same_partition(near(spark, texts, bucket=5), roots(texts))
    assert len([name for name, _ in written if name == "more"]) == 2


def test_pairs_of_long_texts_that_are_not_alike_are_not_fetched(spark, monkeypatch):
    rng = random.Random(12)
    texts = []
    for k in range(12):  # a third in common, some twice as long as others
        words, own = [[f"{x}{rng.random()}" for _ in range(3000 + 300 * k)] for x in "ab"]
        texts += [" ".join(words + own[: len(own) // 2]), " ".join(words + own[len(own) // 2 :])]
    texts += [edited(rng, texts[0].split(), 20)]
    written = written_rows(monkeypatch)
    assert same_partition(near(spark, texts), roots(texts))
    assert sum(n for name, n in written if name == "likely") == 1
    short, long_ = ({rng.randrange(-(2**63), 2**63) for _ in range(k)} for k in (500, 520))
    a, b = (np.array(sorted(x), np.int64) for x in (short, short | long_))
    assert len(simhash.parity(a)) < len(simhash.parity(b)) and simhash.apart(simhash.parity(a), simhash.parity(b)) <= len(long_)
