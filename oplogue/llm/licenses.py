"""License scans: phrases that stand in the text, and blocks of it that contain a template, in DataFrame functions only."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii, read

#: Phrase -> label of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label -> wordings of well-known public licenses and of the lines that name them.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "You may not use this file except in compliance with the License.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This work is licensed under the GNU General Public License, version",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met""",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED
        BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution International License", "Licensed under CC BY"],
    "cc-by-nc": ["Licensed under CC BY-NC"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
    "warranty": ["The software is provided as is, without warranty of any kind, express or implied"],
}
#: Words that name a license. A block without those of its template is some other license's, however alike the rest.
NAMES = {"mit", "apache", "gnu", "cc", "nc", "creative", "mozilla"}
CONTAINMENT = 0.8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A wording as a set of words: ``need`` of them in ``wide`` words that follow each other make a block that contains
    it. The window has the template's words with their repeats, and as many more as may be missing."""

    label: str
    words: frozenset[str]
    need: int
    wide: int
    names: frozenset[str]


def templates(containment: float = CONTAINMENT) -> list[Template]:
    up = lambda x: math.ceil(x - 1e-9)
    out = []
    for label, texts in TEMPLATES.items():
        for text in texts:
            said = re.findall(WORD, text.lower())
            own = frozenset(said)
            out.append(Template(label, own, up(containment * len(own)), up(len(said) / containment), own & NAMES))
    return out


def _spaces(c: Column) -> Column:
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _phrases(text: str, n_words: str) -> list[Column]:
    """Columns n_base, first_word, last_word, base_labels; ``text`` has one space before, between and after words."""
    n, first, last, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in sorted(PHRASES.items(), key=lambda x: x[1]):
        inside, size = f" {phrase} ", len(phrase.split())
        has = F.contains(F.col(text), F.lit(inside))
        twice = f" {phrase.replace(' ', '  ')} "  # so that places next to each other share no space
        wide = F.replace(F.col(text), F.lit(" "), F.lit("  "))
        count = (F.octet_length(wide) - F.octet_length(F.replace(wide, F.lit(twice), F.lit("")))) / len(twice)
        n = n + F.when(has, count.cast("long")).otherwise(0)
        first.append(F.when(has, _spaces(F.substring_index(text, inside, 1))))
        last.append(F.when(has, F.col(n_words) - size - _spaces(F.substring_index(text, inside, -1))))
        labels.append(F.when(has, F.lit(label)))
    return [
        n.alias("n_base"), F.array_min(F.array(*first)).alias("first_word"), F.array_max(F.array(*last)).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    ]


def _held_near(of: Column, names: Column, size: Column, words: Column) -> Column:
    """The most distinct words of ``of`` in ``size`` words that follow each other and hold all ``names``."""
    places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains(of, x["w"]))

    def held(own: Column) -> Column:
        return F.when(F.size(F.array_intersect(names, own)) == F.size(names), F.size(own)).otherwise(0)

    def from_here(all_places: Column) -> Column:
        return F.transform(all_places, lambda x, j: F.element_at(F.transform(F.array(F.array_distinct(F.transform(
            F.filter(F.slice(all_places, j + 1, size), lambda y: y["i"] < x["i"] + size), lambda y: y["w"]
        ))), held), 1))

    # A transform over one row binds ``places``, so that it is not made again for each start.
    return F.coalesce(F.array_max(F.flatten(F.transform(F.array(places), from_here))), F.lit(0))


def blocks_like(docs: DataFrame, frequency: dict[str, int], containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` (id, th, normal) -> (id, th, label, containment): every text with a block that holds at least
    ``containment`` of a template's distinct words, with its names among them.

    A block is any run of ``Template.wide`` words, wherever lines, paragraphs and comment marks fall. Template words are
    put in one order, rarest in the corpus first. A text with such a block shares one of the template's first
    |T| - need + 1 words (prefix filter), has ``need`` template words at all (length filter), and has enough words left
    from that place on (positional filter). In what passes, every block is counted. The index holds a row for each
    prefix word of each template, so its size is that of the list above.
    """
    all_templates = templates(containment)
    words = sorted({w for t in all_templates for w in t.words}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(words)}
    index = []
    for t in all_templates:
        order = sorted(t.words, key=rank.get)
        index += [(w, t.label, order, i, t.need, t.wide, sorted(t.names)) for i, w in enumerate(order[: len(order) - t.need + 1])]
    prefixes = sorted({row[0] for row in index})
    found = docs.sparkSession.createDataFrame(index, "word string, label string, of array<string>, at int, need int, wide int, names array<string>")
    some = " (" + "|".join(prefixes) + ") "
    held = docs.where(F.col("normal").rlike(some)).select(
        "id", "th", "normal", F.array_intersect(F.array(*map(F.lit, words)), F.split("normal", " +")).alias("own")
    ).where(F.size("own") >= min(t.need for t in all_templates))
    starts = F.filter(F.transform("own", lambda w, j: F.struct(w.alias("word"), j.alias("j"))), lambda x: x["word"].isin(prefixes))
    near = held.select("id", "th", "normal", "own", F.explode(starts).alias("s")).select("id", "th", "normal", "own", "s.*").join(
        F.broadcast(found), "word"
    ).where(
        (F.size("own") >= F.col("need")) & (1 + F.least(F.size("of") - F.col("at") - 1, F.size("own") - F.col("j") - 1) >= F.col("need"))
        & (F.size(F.array_intersect("of", "own")) >= F.col("need"))
        & (F.size(F.array_intersect(F.slice("of", F.lit(1), F.col("at")), "own")) == 0)  # else an earlier word brings the pair
        & (F.size(F.array_intersect("names", "own")) == F.size("names"))
    )
    shared = _held_near(F.col("of"), F.col("names"), F.col("wide"), F.split(F.trim("normal"), " +"))
    counted = near.withColumn("shared", shared).where("shared >= need")
    return counted.select("id", "th", "label", (F.col("shared") / F.size("of")).alias("containment"))


def _normal(text: Column) -> Column:
    """The words in lower case, one space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), NOT_WORD, " ")), F.lit(" "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A-Z is lower-cased; null texts are empty and have no words. Labels are the base labels and those of templates that
    a block contains; score is the largest containment found, 1 where a base phrase stands. Repeated rows and null ids
    keep a row each; texts of any length are scanned whole. Other columns are not read. Only the corpus counts of the
    templates' own words reach the driver.
    """
    vocabulary = sorted({w for t in templates(containment) for w in t.words})
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "id", F.xxhash64("text").alias("th"), F.explode(F.array(_normal(F.col("text")))).alias("normal")
    )
    base = rows.select("id", "th", "normal", F.when(F.col("normal") == "  ", 0).otherwise(_spaces(F.col("normal")) - 1).cast("long").alias("n_words"))
    own = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split("normal", " "))
    base = cut(base.select("id", "th", "n_words", *_phrases("normal", "n_words"), own.alias("own")))
    frequency = {r[0]: r[1] for r in base.select(F.explode("own").alias("w")).groupBy("w").count().collect()}
    found = blocks_like(rows, frequency, containment).groupBy("id", "th").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("most")
    )
    joined = base.alias("b").join(found.alias("f"), F.col("b.id").eqNullSafe(F.col("f.id")) & (F.col("b.th") == F.col("f.th")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("b.id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Every block of every text counted in SQL, without the filters."""
    text = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    rows = ", ".join(f"({k}, '{t.label}', {text(sorted(t.words))}, {t.need}, {t.wide}, {text(sorted(t.names))}::varchar[])" for k, t in enumerate(templates()))
    phrases = ", ".join(f"({text(p.split())}, '{label}')" for p, label in PHRASES.items())
    return rf"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words from documents),
w as (select r, unnest(words) word, generate_subscripts(words, 1) - 1 i from d),
p(phrase, label) as (values {phrases}),
base as (select w.r, w.i, p.label from w join p on w.word = p.phrase[1] join d on d.r = w.r where d.words[w.i + 1 : w.i + len(p.phrase)] = p.phrase),
bases as (select r, count(*) n_base, min(i) first_word, max(i) last_word, string_agg(distinct label, ',' order by label) base_labels from base group by r),
t(k, label, words, need, wide, names) as (values {rows}),
tw as (select k, unnest(words) word from t),
m as (select w.r, w.i, w.word, tw.k from w join tw on w.word = tw.word),
enough as (select r, k from m join t using (k) group by r, k having count(distinct word) >= any_value(need)),
blocks as (select a.r, a.k, a.i, list(distinct b.word) held from m a join enough e on a.r = e.r and a.k = e.k join t on t.k = a.k
    join m b on b.r = a.r and b.k = a.k and b.i >= a.i and b.i < a.i + t.wide group by 1, 2, 3),
hits as (select r, t.label, len(held) / len(t.words) containment from blocks join t using (k) where len(held) >= t.need and list_has_all(held, t.names)),
labels as (select r, string_agg(distinct label, ',' order by label) labels from (select r, label from hits union all select r, label from base) group by r),
most as (select r, max(containment) most from hits group by r)
select doc_id, cast(len(d.words) as bigint) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels,
  coalesce(labels, '') labels, case when n_base > 0 then 1.0::double else coalesce(most, 0.0::double) end score
from d left join bases using (r) left join labels using (r) left join most using (r)
"""


ORACLE = _oracle()
