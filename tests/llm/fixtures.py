"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeats, odd columns."""

import random

#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, n long, key long, size long, words string, rest long"


def table(spark, rows, schema=SCHEMA):
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def prose(rng, n, words=("the", "and", "thon", "erea", "Ingst", "of", "anble", "tion")):
    return " ".join(rng.choice(words) + rng.choice(["", "", "ly", "er", "."]) for _ in range(n))


def awkward(seed=1, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 2, 3, 9, 40, 200])) for _ in range(n)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "hot", "hot", None]), len(t)))
    base = prose(rng, 300)
    w = base.split()
    for i in range(12):  # near copies
        v = list(w)
        v[rng.randrange(len(v))] = f"Edit{i}"
        rows.append((100 + i, " ".join(v), "en", "hot", None))
    rows += [(200 + i, base.upper() if i % 2 else base, "en", "hot", 5) for i in range(6)]
    rows += [
        (300, None, None, None, None), (301, "", "en", "", 0), (302, " \t\n ", "en", "z", 4), (303, "Straße ÄÖ İ x", "de", "ß", 9),
        (304, "a\tb\x0bc\x0cd\re\nf", "en", "q", 11), (305, " one two three", "en", "q", 3), (None, "lonely words here", "en", "q", 3),
        (306, (prose(rng, 4000) + "\n") * 2, "en", "long", 1), (307, "x " * 3000, "en", "long", 1), (308, "中文 文本 🙂 é", "zh", "q", 4),
        (309, base, "en", "hot", 1), (309, base, "en", "hot", 1), (309, "another text", "en", "hot", 1), (-5, base, "en", "hot", 1),
    ]
    return rows
