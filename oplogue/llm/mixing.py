"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK = 64
#: Words and rows of a shard, about.
SHARD, ROWS = 1 << 20, 1 << 12
SEED = 17
#: A prime above any number of blocks in a shard: stepping by it visits every block of a shard once.
STEP = 1_000_003


def targets(sizes: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size) -> the same with rank, weight and target.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; no target passes
    ``limit`` times its source's size, and the excess goes to the others by weight until none is above. Sources fill
    up in the order of limit*size/weight, so the level at which filling stops comes from running sums.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_room = Window.orderBy(F.col("room"), F.col("rank"))
    upto = by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.partitionBy()
    cap = limit * F.col("source_size")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", w).withColumn(
        "room", cap.cast("double") / F.col("weight")
    )
    filled = ranked.select(
        "*", F.sum(cap).over(upto).alias("full"), F.sum("weight").over(upto).alias("gone"),
        F.sum("weight").over(all_rows).alias("weights"), F.sum("source_size").over(all_rows).alias("total"),
    )
    # Level if exactly the sources before this one are full; it stands where it does not pass this source's room.
    level = (F.col("total") - (F.col("full") - cap)).cast("double") / (F.col("weights") - (F.col("gone") - F.col("weight")))
    stands = filled.withColumn("level", F.when(level <= F.col("room"), level))
    chosen = stands.withColumn("at", F.min(F.when(F.col("level").isNotNull(), F.struct("room", "rank", "level"))).over(all_rows))
    return chosen.select(
        "source", "source_size", "rank", "weight",
        F.when(F.struct("room", "rank") < F.struct("at.room", "at.rank"), cap.cast("double"))
        .otherwise(F.col("weight") * F.col("at.level")).alias("target"),
    )


def sainte_lague(parties: DataFrame, group: list[str], order: list[str], votes: str, seats: Column, at_most: Column | None = None) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group go to the highest quotients votes / (2 k + 1), ties by ``order``.

    A party holds round(votes / d) seats at the divisor d. With n parties of ``all`` votes together, the divisor
    all / (seats + n / 2) gives out ``seats`` at least and all / (seats - n / 2), or one that gives none, ``seats`` at
    most. Seats held at the second are sure; the quotients between the two, at most 2 n a group, are ranked.
    """
    of_group = Window.partitionBy(*group)
    with_votes = F.col(votes) > 0

    def held(seats_more: Column, slack: float) -> Column:
        return F.floor(F.col(votes) / F.col("votes_all") * F.greatest(seats_more, F.lit(0.0)) * slack + 0.5)

    counted = parties.withColumn("seats", seats).withColumn("votes_all", F.sum(votes).over(of_group)).withColumn(
        "half", F.sum(F.when(with_votes, 0.5).otherwise(0.0)).over(of_group)
    )
    # The slack of a billionth covers what doubles round.
    base = counted.withColumn("sure", F.when(with_votes, F.greatest(held(F.col("seats") - F.col("half"), 1 - 1e-9), F.lit(0))).otherwise(0))
    open_ = base.withColumn("open", F.col("seats") - F.sum("sure").over(of_group))
    ranked = open_.where(with_votes).withColumn("most", held(F.col("seats") + F.col("half"), 1 + 1e-9)).where("most > sure").withColumn(
        "k", F.explode(F.sequence(F.col("sure"), F.col("most") - 1))
    ).withColumn("quotient", F.col(votes) / (2 * F.col("k") + 1))
    best = Window.partitionBy(*group).orderBy(F.col("quotient").desc(), *order, "k")
    won = ranked.withColumn("place", F.row_number().over(best)).where("place <= open")
    quota = won.groupBy(*group, *order).agg((F.max("sure") + F.count("*")).alias("quota"))
    joined = open_.join(quota, [*group, *order], "left").select(*parties.columns, F.coalesce("quota", "sure").alias("quota"))
    return joined.withColumn("quota", F.least("quota", at_most)) if at_most is not None else joined


def taken(
    sized: DataFrame, weights=WEIGHTS, limit: int = LIMIT, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, rows: int = ROWS
) -> DataFrame:
    """``sized`` (doc_id, source, size, th, ...) -> its rows with source_size, target and taken.

    A source's documents are dealt by a hash of id and text into shards of about ``shard`` words and ``rows`` rows at
    most; in a shard they form one line by id, cut into equal blocks of about ``block`` words. Quotas of blocks go to
    sources by their targets, then to a source's shards by their words. A quota over all blocks of a shard takes each
    whole times, and the rest by a seeded step through the shard, so a word is taken ``limit`` times at most. A text of
    any length spans as many blocks as it needs. Texts of size 0, null sources and ids and repeated rows are documents
    like others; equal rows may swap places without changing the result.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    planned = targets(sources, weights, limit).join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    planned = planned.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard), F.ceil(F.col("n") / rows))).drop("n")
    seats = F.round(F.sum("source_size").over(Window.partitionBy()) / block).cast("long")
    planned = cut(sainte_lague(planned.withColumn("all", F.lit(1)), ["all"], ["rank"], "target", seats).withColumnRenamed("quota", "blocks_won").drop("all"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "th")), 1, 8), 16, 10).cast("long")
    placed = sized.join(planned, sized.source.eqNullSafe(planned.source)).drop(planned.source).withColumn("shard", F.pmod(draw, F.col("shards")))
    shards = placed.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.max("blocks_won").alias("blocks_won")).withColumn(
        "blocks", F.greatest(F.round(F.col("words") / block).cast("long"), F.lit(1))
    )
    quotas = sainte_lague(shards, ["rank"], ["shard"], "words", F.col("blocks_won"), limit * F.col("blocks")).select("rank", "shard", "words", "blocks", "quota")
    line = Window.partitionBy("rank", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "size")
    lined = placed.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    offset = F.pmod(F.lit(seed) * 7919 + F.col("rank") * 104729 + F.col("shard") * 1299709, F.col("blocks"))
    # Block j of a shard is words [j * words div blocks, (j + 1) * words div blocks) of its line.
    total = F.expr(
        f"""aggregate(sequence(((end - size + 1) * blocks - 1) div words, (end * blocks - 1) div words), 0L, (acc, j) -> acc
        + (least(end, (j + 1) * words div blocks) - greatest(end - size, j * words div blocks)) * (quota div blocks + if(pmod(j * {STEP} + offset, blocks) < quota % blocks, 1, 0)))"""
    )
    return lined.join(quotas, ["rank", "shard"]).withColumn("offset", offset).withColumn("taken", F.when(F.col("size") > 0, total).otherwise(0).cast("long"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, th) of every row: words of its text (null: none) and the text's MD5 (null: null)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.md5("text").alias("th"),
    )


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its words are taken on average, the fraction left over by a
    draw seeded with the row itself. Documents stay whole."""
    t = taken(cut(sizes(docs)), seed=seed).groupBy("doc_id", "th").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("times"))
    draw = F.pmod(F.xxhash64(t.doc_id, t.th, F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    copies = t.select(t.doc_id.alias("id"), t.th.alias("h"), (F.floor("times") + F.when(draw < F.col("times") - F.floor("times"), 1).otherwise(0)).cast("int").alias("copies")).where("copies > 0")
    joined = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc")).join(
        copies, F.col("doc.doc_id").eqNullSafe(F.col("id")) & F.md5("doc.text").eqNullSafe(F.col("h"))
    )
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(sizes(read(spark, sf_dir, "documents")))
    return taken(sized).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
with d as (select row_number() over () r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, md5(text) th from documents),
src0 as (select source, sum(size)::bigint source_size, count(*) n from d group by source),
src as (select *, row_number() over (order by source is null, encode(source)) - 1 "rank", [{', '.join(map(str, WEIGHTS))}][("rank" % {len(WEIGHTS)} + 1)::int] weight,
  {LIMIT} * source_size cap from src0),
full_ as (select a.*, (select sum(least(b.cap::double, b.weight * (a.cap::double / a.weight))) from src b) <= (select sum(source_size) from src) is_full from src a),
target as (select *, case when is_full then cap::double else weight * ((select (sum(source_size) - coalesce(sum(cap) filter (is_full), 0))::double
  / sum(weight) filter (not is_full) from full_)) end target, greatest(ceil(source_size / {SHARD}), ceil(n / {ROWS}))::bigint shards from full_),
seats as (select round(sum(source_size) / {BLOCK})::bigint seats from src),
won as (select "rank", count(*) won from (select "rank", row_number() over (order by target / (2 * k + 1) desc, "rank", k) place
  from target, (select unnest(range(seats)) k from seats) where target > 0 and k <= target / {BLOCK} + (select count(*) from src) + 2) q, seats where place <= seats group by 1),
placed as (select d.*, t."rank", source_size, target, coalesce(won, 0) won, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::varchar, ''), th)), 1, 8))::bigint % shards shard
  from d join target t on d.source is not distinct from t.source left join won w on w."rank" = t."rank"),
shards as (select "rank", shard, sum(size)::bigint words, any_value(won) won, greatest(round(sum(size) / {BLOCK}), 1)::bigint blocks from placed group by 1, 2),
quota as (select "rank", shard, count(*) quota from (select "rank", shard, won, row_number() over (partition by "rank" order by words / (2 * k + 1) desc, shard, k) place
  from shards, range((select coalesce(max(won), 0) from won)) g(k) where words > 0 and k < won) where place <= won group by 1, 2),
lined as (select p.*, words, blocks, least(coalesce(quota, 0), {LIMIT} * blocks) quota, sum(size) over (partition by p."rank", p.shard order by doc_id nulls first, size rows unbounded preceding)::bigint "end"
  from placed p join shards s on s."rank" = p."rank" and s.shard = p.shard left join quota q on q."rank" = p."rank" and q.shard = p.shard),
cut as (select r, sum((least("end", (j + 1) * words // blocks) - greatest("end" - size, j * words // blocks))
  * (quota // blocks + case when (j * {STEP} + ({SEED * 7919} + "rank" * 104729 + shard * 1299709) % blocks) % blocks < quota % blocks then 1 else 0 end)) taken
  from (select *, unnest(range((("end" - size + 1) * blocks - 1) // words, ("end" * blocks - 1) // words + 1)) j from lined where size > 0) group by r)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint taken from lined left join cut using (r)
"""
