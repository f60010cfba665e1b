import numpy as np
from pyspark.sql import functions as F

from oplogue.llm import language, quality_model

from .fixtures import awkward, table

SF = "/root/testdata/sf0.001"


def test_pair_term_equals_the_double_sum():
    rng = np.random.default_rng(1)
    m = quality_model.FactorisationMachine(0.3, rng.normal(size=9).astype(np.float32), rng.normal(size=(9, 4)).astype(np.float32))
    i, x = np.array([0, 3, 8]), np.array([1.0, 0.5, 2.0], np.float32)
    want = 0.3 + (m.w[i] * x).sum() + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert abs(m.margins(np.array([0, 3]), i, x)[0][0] - want) < 1e-4


def test_every_row_is_scored(spark):
    rows = awkward(10)
    docs = table(spark, rows)
    labels = spark.createDataFrame([(r[0], int("the" in r[1])) for r in rows[:40]] + [(None, 1)], "doc_id long, quality int")
    m = quality_model.train(docs, labels, F.lit(True))
    got = quality_model.score(docs, m).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows) and all(0 <= r.score <= 1 for r in got)
    empty = table(spark, [])
    assert quality_model.score(empty, quality_model.train(empty, labels, F.lit(True))).collect() == []


def test_languages(spark):
    rows = awkward(11)
    docs = table(spark, rows)
    got = language.identify(docs, language.train(docs, F.lit(True))).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert {r.lang_pred for r in got if r.doc_id in (300, 301, 302)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert language.identify(table(spark, []), language.train(table(spark, []), F.lit(True))).collect() == []
    real = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    pred = language.identify(real, language.train(real, ~held)).join(real.where(held), "doc_id")
    assert pred.where("lang_pred = lang").count() >= 0.97 * pred.count()


def plain_features(text, stated):
    """What a document is made of, a character and a word at a time."""
    import zlib
    from bisect import bisect_right

    t = text or ""
    raw = t.encode()
    words, size = raw.split(), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = lambda chars: sum(b in chars.encode() for b in raw)
    letters = max(sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw), 1)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    own = set(words)
    blank = sum(b == 32 or 9 <= b <= 13 for b in raw)
    stats = [
        len(words), (size - blank) / max(len(words), 1), sum(65 <= b <= 90 for b in raw) / letters, count("#*$%&|<>@^~=+{}[]_\\") / size, count("0123456789") / size,
        count(".,;:!?\"'()-") / size, 1 - len(set(lines)) / max(len(lines), 1), len(own) / max(len(words), 1), len(words) / max(len(lines), 1),
        1 - len(set(windows)) / len(windows) if len(words) > 8 else 0.0, blank / size, max(map(len, own), default=0),
        -1 if stated is None else stated, -1 if stated is None else abs(stated - len(t)) / max(stated, len(t), 1),
    ]
    dense = {quality_model.OFFSETS[k] + bisect_right(quality_model.STATS[k], v): 1.0 for k, v in zip(quality_model.STATS, stats, strict=True)}
    hashed = sorted({zlib.crc32(w) % quality_model.WORDS for w in own})
    return {h: 1 / len(hashed) ** 0.5 for h in hashed} | dense


def test_features_equal_plain_ones():
    bins = quality_model.word_bins()
    texts = [r[1] for r in awkward(2)] + ["one two three four five six seven eight nine " * 5, "A#b 12, (c)!\nA#b 12, (c)!"]
    for k, t in enumerate(texts):
        stated = [None, 0, 40, len(t or "")][k % 4]
        i, x = quality_model.features(t, stated, bins)
        want = plain_features(t, stated)
        assert dict(zip(i.tolist(), x.tolist(), strict=True)).keys() == want.keys()
        assert all(abs(float(v) - want[int(j)]) < 1e-6 for j, v in zip(i, x, strict=True))


def test_fit_lowers_the_loss_and_needs_pairs():
    """Labels that only a pair of features tells."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([a, 2 + b], np.int32), np.ones(2, np.float32)))
        y.append(float(a == b))
    m = quality_model.FactorisationMachine.fit(rows, np.array(y, np.float32), epochs=60)
    at = np.arange(0, 2 * len(rows) + 1, 2)
    p = m.predict(at, np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]))
    assert ((p > 0.5) == np.array(y)).mean() > 0.95


def test_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {i}", None) for i in range(50)] + [(2, "other", 5)], "doc_id long, text string, n_chars long")
    seen = {}
    real = quality_model.FactorisationMachine.fit
    quality_model.FactorisationMachine.fit = staticmethod(lambda rows, y: seen.update(n=len(rows)) or real(rows, y))
    try:
        quality_model.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), F.lit(True))
    finally:
        quality_model.FactorisationMachine.fit = staticmethod(real)
    assert seen["n"] == 2


def test_kernel_and_ridge_equal_plain_ones():
    """N-gram sets, the kernel by counting, and the ridge solution in the landmarks' own coordinates."""
    def grams(t):
        b = bytes(32 if c < 65 else c for c in b" " + t.encode().translate(language._LOWER) + b" ")
        return {b[i : i + n] for n in (1, 2, 3, 4) for i in range(len(b) - n + 1)}

    def bin_of(g):
        if len(g) == 1:
            return g[0]
        code = g[0]
        for c in g[1:]:
            code = (code * 257 + c) % 2**32
        return (code * 2654435761 % 2**32) >> 17 & (language.BINS - 1)

    texts = ["the cat sat on the mat", "die Katze saß auf der Matte", "the dog and the cat", "der Hund und die Katze", "a b c 12", "das ist gut", "that is good"]
    langs = ["en", "de", "en", "de", "en", "de", "en"]
    p = np.zeros((len(texts), language.BINS), np.uint8)
    for t, row in zip(texts, p, strict=True):
        language.presence(t, row)
        assert set(np.flatnonzero(row).tolist()) == {bin_of(g) for g in grams(t)}
    m = language.fit(p, langs, landmarks=4, ridge=1e-3)
    sets = [{bin_of(g) for g in grams(t)} for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    turn = [1, 0, 3, 2]  # landmarks in turn from de and en
    kzz = np.array([[kernel(sets[i], sets[j]) for j in turn] for i in turn])
    kxz = np.array([[kernel(s, sets[j]) for j in turn] for s in sets])
    y = np.array([[1.0, -1.0] if g == "de" else [-1.0, 1.0] for g in langs])
    w = np.linalg.solve(kxz.T @ kxz + 1e-3 * len(texts) * kzz, kxz.T @ y)  # the same problem without the square root
    assert m.labels == ["de", "en"]
    got = language._unit(p.astype(np.float32)) @ m.landmarks.T @ m.weights
    assert np.abs(got - kxz @ w).max() < 1e-3
    assert m.predict(["12 3", None, "the cat"])[0] == ["und", "und", "en"]


def test_long_texts_are_told_apart(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null")
    model = language.train(real, F.lit(True))
    long = real.groupBy("lang").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    long = long.select(F.monotonically_increasing_id().alias("doc_id"), "lang", F.substring(F.repeat("text", 10), 1, 400_000).alias("text"))
    got = language.identify(long, model).join(long, "doc_id")
    assert got.where("lang_pred <> lang").count() == 0
