"""Quality rules whose votes are weighed by weak supervision, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, located, read

WINDOW = 8
#: Rule -> (SQL for a vote against, SQL for a vote in favour); a rule abstains where neither holds. Each looks at a side
#: of the text that no other does, as expectation-maximisation takes votes to be independent given the class.
RULES = {
    "length": ("n_words < 30", "n_words >= 60"),
    "word_length": ("word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars >= 3.5 * n_words and word_chars <= 8 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols < n_words"),
    "lines": ("n_dup_lines > 0.3 * n_lines and n_dup_lines > 1", "n_dup_lines <= 0.1 * n_lines"),
    "repeats": ("n_repeat_words > 0.2 * n_words", "n_repeat_words <= 0.05 * n_words"),
    "capitals": ("n_upper > 0.4 * word_chars", "n_upper < 0.15 * word_chars"),
    "punctuation": ("n_marks > 0.5 * n_words or n_marks < 0.01 * n_words", "n_marks >= 0.03 * n_words and n_marks <= 0.3 * n_words"),
}
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]
#: Votes that the estimate starts from, as (against, in favour): a rule is seldom wrong about good documents, and
#: nothing is known about bad ones. They outweigh data only where there is hardly any.
ON_GOOD, ON_BAD = (1, 99), (3, 3)
ROUNDS = 40


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, worked out once though ``body`` names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in windows of 8 words that occur twice or more. Windows compare by 64-bit hashes of word hashes."""

    def covered(windows: Column) -> Column:
        places = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = _let(places, lambda p: F.filter(
            F.transform(p, lambda x, k: F.when(
                (x.h == F.get(p, k - 1).h) | (x.h == F.get(p, k + 1).h), x.i)),
            lambda i: i.isNotNull(),
        ))
        return _let(F.sort_array(again), lambda s: F.aggregate(
            F.transform(s, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - at, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x,
        ))

    def pairs(hashes: Column, apart: int) -> Column:
        """Hashes of twice as many words: each with the one ``apart`` places on (null past the end)."""
        return _let(hashes, lambda h: F.zip_with(h, F.slice(h, apart + 1, F.greatest(F.size(h) - apart, F.lit(0))), lambda x, y: F.xxhash64(x, y)))

    eight = pairs(pairs(pairs(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    made = F.slice(eight, 1, F.greatest(F.size(words) - WINDOW + 1, F.lit(0)))
    return _let(made, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))


def measures(docs: DataFrame, text_col: str, carry: list[Column]) -> DataFrame:
    """(carried columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks) of
    every row, all long, from its whole text, however long; null is empty."""
    split = docs.select(F.struct(*carry).alias("carried"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "carried", "text", F.explode(F.array(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))).alias("words"),
    )
    lines = _let(
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
    )
    return split.select(
        "carried", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"), _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[.,;:!?]")).cast("long").alias("n_marks"),
    ).select("carried.*", "n_words", "word_chars", "n_symbols", F.col("lines.n").cast("long").alias("n_lines"),
             F.col("lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words", "n_upper", "n_marks")


def votes(measured: DataFrame) -> DataFrame:
    """Adds a column v_<rule> for each rule: -1 against, 1 in favour, 0 abstains."""
    return measured.select("*", *(F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end").alias(f"v_{r}") for r, (bad, good) in RULES.items()))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS):
    """Expectation-maximisation over vote patterns (votes, count), at most 3^rules of them.

    Two classes. A rule's accuracies are its chances of voting against, where it votes, given each class; abstaining
    says nothing. They are estimated freely, from the prior votes ``ON_GOOD`` and ``ON_BAD``. The start, "good where
    nothing votes against", tells the classes apart, so that sides do not flip. Returns (prior log-odds, [(log-odds
    that a vote against adds to "good", that a vote in favour adds) for each rule]).
    """
    if not patterns:
        return 0.0, []
    m = len(patterns[0][0])
    post = [0.95 if min(v) >= 0 else 0.05 for v, _ in patterns]
    total, prior, add = sum(n for _, n in patterns), 0.0, []
    for _ in range(rounds):
        good = sum(n * p for (_, n), p in zip(patterns, post, strict=True))
        prior = math.log((good + 1) / (total - good + 1))
        add = []
        for j in range(m):
            cast = {(vote, side): 0.0 for vote in (-1, 0, 1) for side in (0, 1)}
            for (v, n), p in zip(patterns, post, strict=True):
                cast[v[j], 1] += n * p
                cast[v[j], 0] += n * (1 - p)
            wrong = (cast[-1, 1] + ON_GOOD[0]) / (cast[-1, 1] + cast[1, 1] + sum(ON_GOOD))
            right = (cast[-1, 0] + ON_BAD[0]) / (cast[-1, 0] + cast[1, 0] + sum(ON_BAD))
            add.append((math.log(wrong / right), math.log((1 - wrong) / (1 - right))))
        post = [chance(prior, add, v) for v, _ in patterns]
    return prior, add


def chance(prior: float, add: list[tuple[float, float]], votes_: tuple[int, ...]) -> float:
    """Posterior chance that a document with these votes is good."""
    odds = prior + sum(a[0] if v < 0 else a[1] for v, a in zip(votes_, add, strict=True) if v)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def _judged(measured: DataFrame, threshold: float) -> DataFrame:
    """Adds base_failed, posterior and kept."""
    names = [f"v_{r}" for r in RULES]
    cast = votes(measured)
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in cast.where(f"not ({FAILED})").groupBy(*names).count().collect())
    prior, add = fit(patterns)
    odds = F.lit(prior)
    for name, (against, favour) in zip(names, add, strict=bool(add)):
        odds = odds + F.when(F.col(name) < 0, F.lit(against)).when(F.col(name) > 0, F.lit(favour)).otherwise(0.0)
    return cast.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", F.expr(FAILED)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, the measures, base_failed, posterior, kept.

    ``kept`` is false where the base rule fails (under 20 words, so null and empty texts, or over 30 % of words in
    repeated windows), else whether the posterior chance of quality reaches ``threshold``. The rules' accuracies come
    from the votes on all rows that pass the base rule; only counts of vote patterns (at most 3^rules) reach the driver.
    Repeated rows and null ids get their own rows; other columns are not read.
    """
    judged = _judged(cut(measures(docs, text_col, [F.col(id_col).alias("id")])), threshold)
    return judged.select("id", *STATS, "base_failed", "posterior", "kept")


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, as they are. Texts are measured once; a row is found again by
    where it lies."""
    rows = located(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc")))
    kept = _judged(cut(measures(rows, f"doc.{text_col}", [F.col("file"), F.col("row")])), threshold).where("kept")
    return rows.join(kept.select("file", "row"), ["file", "row"], "left_semi").select("doc.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    """Measures, votes and every round of the estimate in SQL."""
    m = len(RULES)
    cast = ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end" for bad, good in RULES.values())
    wrong = f"(ag + {ON_GOOD[0]}) / (ag + fg + {sum(ON_GOOD)})"
    right = f"(ab + {ON_BAD[0]}) / (ab + fb + {sum(ON_BAD)})"
    return rf"""
with recursive d as (select row_number() over () r, doc_id, coalesce(text, '') "text", regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') words from documents),
w as (select r, unnest(words) word, generate_subscripts(words, 1) i from d),
win as (select r, i, concat_ws(' ', word, {", ".join(f"lead(word, {k}) over o" for k in range(1, 8))}) eight, lead(word, 7) over o is not null whole
  from w window o as (partition by r order by i)),
seen as (select r, i, count(*) over (partition by r, eight) times from win where whole),
again as (select r, count(distinct i + k) n_repeat_words from seen, range(8) g(k) where times > 1 group by r),
line as (select r, unnest(string_split("text", chr(10))) line from d),
lines as (select r, count(*) n_lines, count(*) - count(distinct line) n_dup_lines from line where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
ms as (select r, doc_id, len(words)::bigint n_words, length(array_to_string(words, ''))::bigint word_chars, len(regexp_extract_all("text", '[#*$%&|<>]'))::bigint n_symbols,
  coalesce(n_lines, 0) n_lines, coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, len(regexp_extract_all("text", '\p{{Lu}}')) n_upper,
  len(regexp_extract_all("text", '[.,;:!?]')) n_marks from d left join lines using (r) left join again using (r)),
voted as (select *, {FAILED} base_failed, [{cast}] v from ms),
pat as (select v, count(*) n from voted where not base_failed group by v),
em as (select 0 round_, v, n, case when list_min(v) >= 0 then 0.95::double else 0.05::double end post from pat
  union all
  select round_ + 1, v, any_value(n), 1 / (1 + exp(-greatest(-500, least(500, any_value(prior) + sum(case when vote < 0 then ln(({wrong}) / ({right}))
    when vote > 0 then ln((1 - {wrong}) / (1 - {right})) else 0 end)))))
  from (select *, ln((sum(n * post) over (partition by j) + 1) / (sum(n) over (partition by j) - sum(n * post) over (partition by j) + 1)) prior,
      sum(if(vote < 0, n * post, 0)) over (partition by j) ag, sum(if(vote > 0, n * post, 0)) over (partition by j) fg,
      sum(if(vote < 0, n * (1 - post), 0)) over (partition by j) ab, sum(if(vote > 0, n * (1 - post), 0)) over (partition by j) fb
    from (select em.*, j, v[j] vote from em, range(1, {m + 1}) g(j) where round_ < {ROUNDS}))
  group by round_, v)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(not base_failed and post >= 0.5, false) kept
from voted left join (select v, post from em where round_ = {ROUNDS}) e on e.v = voted.v
"""


ORACLE = _oracle()
