import random
import re
import textwrap

import duckdb

from oplogue.llm import licenses

from .fixtures import awkward, prose, table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall((text or "").translate(LOW))
    places, base = [], set()
    for p, label in licenses.PHRASES.items():
        p = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if base else 0.0
    for t in licenses.templates():
        for i in range(len(w)):
            own = t.words & set(w[i : i + t.wide])
            if len(own) >= t.need and t.names <= own:
                labels.add(t.label)
                score = max(score, len(own) / len(t.words))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_matches_brute_force(spark):
    texts = [
        "Released under the MIT License.", "xx\nLicensed under CC BY-NC 4.0.\nyy", "cc by cc by CC-BY", "cc\nby", "All Rights  Reserved all rights reserved",
        "This work is licensed under the GNU General Public License, version 3.", "the mit license under", "general public license" * 3, "by cc by",
        "Permission is hereby granted, free of charge, to any human obtaining a copy of this software and associated documentation files",
        "licensed under the apache license, version 2.0", "rights reserved all", "all rights reserved", "éall rights reserved", "provided as is without warranty",
    ]
    rows = awkward(7) + [(2000 + i, t, "en", "lic", 1) for i, t in enumerate(texts)] + [(2000, texts[0], "en", "lic", 1), (2000, "other", "en", "lic", 1), (None, texts[0], "en", "lic", 1)]
    got = sorted((tuple(r) for r in licenses.scan(table(spark, rows)).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert {r[6] for r in got if r[0] == 2010} == {"apache-2.0"}
    assert any("mit" in r[6] for r in got) and any("cc-by-nc" in r[6] for r in got)


def test_empty_table(spark):
    assert licenses.scan(table(spark, [])).collect() == []


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General
# Public License as published by the Free Software Foundation"""


def labels_of(spark, texts):
    found = licenses.scan(table(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])).collect()
    return {r.doc_id: (set(r.labels.split(",")) - {""}, r.score) for r in found}


def test_hard_wrapped_notices(spark):
    texts = [
        MIT, BSD, GPL, "Released under\nthe MIT\nLicense.", "Licensed under the Apache\n\nLicense, Version 2.0", MIT.replace("\n", "\r\n"), "x y\n" * 500 + BSD + "\nz" * 500,
        "licensed\nunder\none\ntwo\nthree\nfour\nfive\nthe\nmit\nlicense", "\n".join(BSD.split()), "\n\n".join(MIT.split()), "free and software into domain\nwithout warranty",
    ]
    got = labels_of(spark, texts)
    assert [got[i][0] for i in range(3)] == [{"mit"}, {"bsd"}, {"gpl"}] and got[1][1] == 1.0
    assert {i: got[i] for i in got} == {i: (set(brute(t)[5].split(",")) - {""}, brute(t)[6]) for i, t in enumerate(texts)}
    assert got[7][0] == set() and got[9][0] == {"mit"}


def test_one_threshold_and_names(spark):
    got = labels_of(spark, ["released under the mit licence", "licensed under the apache license", "released under the bsd license", "Licensed under CC BY NC", "licensed under cc"])
    assert [got[i][0] for i in range(5)] == [{"mit"}, set(), set(), {"cc-by", "cc-by-nc"}, set()]


def test_dispersed_words_are_no_block(spark):
    words = " ".join(licenses.TEMPLATES["bsd"][0].split()).split()
    apart = " and so it went\n".join(" ".join(words[i : i + 3]) for i in range(0, len(words), 3))
    near = " so\n".join(" ".join(words[i : i + 8]) for i in range(0, len(words), 8))
    assert [labels_of(spark, [apart, near])[i][0] for i in range(2)] == [set(), {"bsd"}]


def test_wrapped_notices_of_all_templates(spark):
    """Every wording, wrapped at several widths with comment marks, with 5 words in 100 missing, among other text."""
    rng = random.Random(2)
    texts, want = [], []
    for label, some in licenses.TEMPLATES.items():
        for t in some:
            for wide in (20, 45, 72):
                said = " ".join(w for w in t.split() if len(t.split()) < 25 or rng.random() > 0.05)
                lines = textwrap.wrap(said, wide)
                texts.append("\n".join([prose(rng, 300), *(f" * {x}" for x in lines), prose(rng, 300)]))
                want.append(label)
    got = labels_of(spark, texts)
    assert all(label in got[i][0] for i, label in enumerate(want))
    assert {i: got[i][0] for i in got} == {i: set(brute(t)[5].split(",")) - {""} for i, t in enumerate(texts)}


def test_a_very_long_text(spark):
    text = "word and the " * 400_000 + MIT.replace("\n", "\n * ") + " of the word" * 400_000
    assert labels_of(spark, [text])[0][0] == {"mit"}


def test_sql_agrees(spark, tmp_path):
    rows = [r[:5] for r in awkward(12)] + [(5000 + i, t, "en", "l", 1) for i, t in enumerate([MIT, BSD, GPL, "released under the mit licence", "cc by cc by all rights reserved"])]
    df = table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/d/*.parquet'")
    rel = con.sql(licenses.ORACLE)
    want = sorted((tuple(dict(zip(rel.columns, r, strict=True)).items()) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r.asDict().items()) for r in licenses.scan(df).collect()), key=str) == want
