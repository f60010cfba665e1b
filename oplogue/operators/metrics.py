"""Histograms, counter deltas, rates and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUNDS = 17
INFINITE = 1e18


def bucket_of(seconds: Column) -> Column:
    """First bound that is not below the value, else +Inf (1e18)."""
    out = F.lit(INFINITE)
    for i in reversed(range(BOUNDS)):
        out = F.when(seconds <= 0.001 * 2**i, F.lit(0.001 * 2**i)).otherwise(out)
    return out


def bounds() -> Column:
    """All bucket bounds in order, +Inf last."""
    return F.array(*(F.lit(0.001 * 2**i) for i in range(BOUNDS)), F.lit(INFINITE))


def histogram(values: DataFrame, keys: list[str], seconds: str = "seconds") -> DataFrame:
    """(keys, le, n, cum): counts by bucket, all buckets present, and their running sums. Values are read once."""
    own = values.groupBy(*keys, bucket_of(F.col(seconds)).alias("le")).agg(F.count("*").alias("n"))
    held = own.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("le", "n"))).alias("held"))  # at most 18 entries
    each = held.select(*keys, "held", F.explode(bounds()).alias("le"))
    full = each.select(*keys, "le", F.coalesce(F.try_element_at("held", F.col("le")), F.lit(0)).alias("n"))
    run = Window.partitionBy(*keys).orderBy("le").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.withColumn("cum", F.sum("n").over(run))


def totals(values: DataFrame, keys: list[str], seconds: str = "seconds") -> DataFrame:
    """(keys, count, sum) that a histogram carries beside its buckets."""
    return values.groupBy(*keys).agg(F.count("*").alias("count"), F.sum(seconds).alias("sum"))


def sum_scrapes(buckets: DataFrame, by: list[str]) -> DataFrame:
    """Scrapes of several nodes (node, code, le, cum) -> (by, le, cum) summed over the nodes that answered 200."""
    return buckets.where("code = 200").groupBy(*by, "le").agg(F.sum("cum").alias("cum"))


def unreachable(scrapes: DataFrame, by: list[str]) -> DataFrame:
    """(node, code) -> how many nodes did not answer 200."""
    return scrapes.groupBy(*by).agg(F.count_if(F.coalesce(F.col("code"), F.lit(0)) != 200).alias("unreachable"))


def delta(after: DataFrame, before: DataFrame, on: list[str], value: str) -> DataFrame:
    """after - before by key: a missing before is 0, a reset is clamped to 0 and flagged."""
    b = before.select(*on, F.col(value).alias("was"))
    now, was = F.col(value), F.coalesce("was", F.lit(0))
    return after.join(b, on, "left").select(*on, F.greatest(now - was, F.lit(0)).alias(value), (now < was).alias("clamped"))


def suspect(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Whether any counter of a row of deltas was reset."""
    return deltas.groupBy(*by).agg(F.bool_or("clamped").alias("clamped"))


def quantiles(cumulative: DataFrame, keys: list[str], qs: list[float], prometheus: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """(keys, q, value) by linear interpolation in cumulative buckets (le, cum).

    Native rule: milliseconds, -1 for an empty histogram, twice the last bound for +Inf; the total is the ``count`` of
    ``counts`` (keys, count), which may differ from the last bucket, and where it passes all buckets the value is the last
    bound. Prometheus rule: seconds, null for an empty one, the last finite bound for +Inf, the last bucket is the total.
    """
    order = Window.partitionBy(*keys).orderBy("le")
    prev = cumulative.withColumn("prev_le", F.lag("le", 1, 0.0).over(order)).withColumn("prev_cum", F.lag("cum", 1, 0).over(order))
    if counts is None:
        prev = prev.withColumn("total", F.max("cum").over(Window.partitionBy(*keys)))
    elif keys:
        prev = prev.join(counts.select(*keys, F.col("count").alias("total")), keys)
    else:
        prev = prev.join(F.broadcast(counts.agg(F.max("count").alias("total"))), F.lit(True))  # one row
    each = prev.withColumn("q", F.explode(F.array(*map(F.lit, qs)))).withColumn("target", F.col("q") * F.col("total"))
    inside = F.col("cum") - F.col("prev_cum")
    frac = F.when(inside <= 0, 1.0).otherwise((F.col("target") - F.col("prev_cum")) / F.when(inside > 0, inside))
    if prometheus:
        value = F.when(F.col("le") > 1e17, F.col("prev_le")).otherwise(F.col("prev_le") + (F.col("le") - F.col("prev_le")) * frac)
        empty, beyond = F.lit(None).cast("double"), F.lit(None).cast("double")
    else:
        hi = F.when(F.col("le") > 1e17, F.col("prev_le") * 2).otherwise(F.col("le"))
        value, empty, beyond = (F.col("prev_le") + (hi - F.col("prev_le")) * frac) * 1000.0, F.lit(-1.0), F.max("le") * 1000.0
    hit = F.min_by(value, F.when(F.col("cum") >= F.col("target"), F.col("le")))
    return each.groupBy(*keys, "q").agg(F.when(F.max("total") == 0, empty).otherwise(F.coalesce(hit, beyond)).alias("value"))


def over_range(samples: DataFrame, keys: list[str], seconds: int, step: int) -> DataFrame:
    """Counter samples (keys, at seconds, value) -> (keys, at, increase, rate) at each multiple of ``step``, over the
    ``seconds`` before it.

    The sliding range of Prometheus: growth between the samples in (at - seconds, at], a reset counting from 0, at least
    two samples; then extrapolated to the ends of the range, by half a sample distance where the range reaches more than
    1.1 of it beyond the samples, and at its start not past where the counter would be 0.

    A sample's predecessor only counts within ``seconds``, so a series is cut into blocks of that length, each with the
    last sample of the block before it: no task holds a series, however long. Blocks are dealt to all shuffle
    partitions, which adaptive execution would join to one a core.
    """
    dealt = samples.select(*keys, "at", "value", F.floor(F.col("at") / seconds).alias("range block"))
    last = dealt.groupBy(*keys, "range block").agg(F.max(F.struct("at", "value")).alias("last"))
    carried = last.select(*keys, "last.at", "last.value", (F.col("range block") + 1).alias("range block"), F.lit(False).alias("range own"))
    w = Window.partitionBy(*keys, "range block").orderBy("at", "value")
    before, since = F.lag("value").over(w), F.lag("at").over(w)
    grown = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = dealt.withColumn("range own", F.lit(True)).unionByName(carried).repartition(n, *keys, "range block")
    stepped = both.select(*keys, F.col("at").alias("ts"), "value", grown.alias("grown"), since.alias("since"), "range own").where("`range own`").drop("range own")
    first = F.ceil(F.col("ts") / step) * step
    each = stepped.select("*", F.explode(F.sequence(first, F.greatest(first, F.floor((F.col("ts") + seconds - 1) / step) * step), F.lit(step))).alias("at")).where(
        F.col("ts") > F.col("at") - seconds
    )
    inside = F.col("since") > F.col("at") - seconds
    got = each.groupBy(*keys, "at").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n"), F.min_by("value", F.struct("ts", "value")).alias("v0"),
        F.coalesce(F.sum(F.when(inside, F.col("grown"))), F.lit(0.0)).alias("grown"),
    ).where("n >= 2 and t1 > t0")
    span = (F.col("t1") - F.col("t0")).cast("double")
    gap = span / (F.col("n") - 1)
    head, tail = (F.col("t0") - F.col("at") + seconds).cast("double"), (F.col("at") - F.col("t1")).cast("double")
    head = F.when(head >= gap * 1.1, gap / 2).otherwise(head)
    to_zero = F.when((F.col("grown") > 0) & (F.col("v0") >= 0), span * F.col("v0") / F.col("grown"))
    head = F.when(to_zero < head, to_zero).otherwise(head)
    tail = F.when(tail >= gap * 1.1, gap / 2).otherwise(tail)
    increase = F.col("grown") * ((span + head + tail) / span)
    return got.select(*keys, "at", increase.alias("increase"), (increase / seconds).alias("rate"))


def sum_by(rates: DataFrame, by: list[str], value: str) -> DataFrame:
    return rates.groupBy(*by).agg(F.sum(value).alias(value))


def latest(samples: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Instant selector: the last value of each series whose labels match; of equal times the larger value."""
    some = samples if where is None else samples.where(where)
    return some.groupBy(*keys).agg(F.max_by("value", F.struct("at", "value")).alias("value"))


def publishable(bench: DataFrame) -> DataFrame:
    return bench.where("p99_ms >= 0 and errors = 0 and accepted = offered and completed >= accepted")
