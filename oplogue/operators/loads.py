"""Load runs: the plan of an open-loop generator, what came of it, and the row a run is published as."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plan(spark: SparkSession, rate: int, seconds: int, threads: int, gateways: int, prefix: str = "load") -> DataFrame:
    """(thread, n, due_ms, key, gateway): ``threads`` share the rate; each submits its n-th job when it is due, to the
    gateways in turn. As a stream the same rows come from the ``rate`` source."""
    i = F.col("id")
    n = F.floor(i / threads)
    thread = i % threads
    return spark.range(rate * seconds).select(
        thread.cast("int").alias("thread"), n.alias("n"), (n * 1000 * threads / rate).cast("bigint").alias("due_ms"),
        F.format_string(f"{prefix}-%d-%d", thread, n).alias("key"), ((thread + n) % gateways).cast("int").alias("gateway"),
    )


def tally(submits: DataFrame, by: list[str]) -> DataFrame:
    """(code) of each submit -> offered, accepted (200 or 201), errors."""
    ok = F.coalesce(F.col("code"), F.lit("0")).isin("200", "201")
    return submits.groupBy(*by).agg(F.count("*").alias("offered"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("errors"))


def bench_line(runs: DataFrame) -> DataFrame:
    """(rate, offered, accepted, errors, completed, p50_ms, p95_ms, p99_ms) -> a CSV line each, quantiles to a tenth."""
    return runs.select(F.format_string("%d,%d,%d,%d,%d,%.1f,%.1f,%.1f", "rate", "offered", "accepted", "errors", "completed", "p50_ms", "p95_ms", "p99_ms").alias("value"))


def churn(membership: DataFrame, by: list[str]) -> DataFrame:
    """Membership changes (node, at, alive): rows that differ from the node's row before count."""
    from pyspark.sql import Window

    w = Window.partitionBy("node").orderBy("at")
    was = F.lag("alive").over(w)
    return membership.withColumn("changed", was.isNotNull() & (was != F.col("alive"))).groupBy(*by).agg(F.count_if("changed").alias("churn"))


def settled(ready: Callable[[], bool], seconds: float = 30.0, poll: float = 1.0) -> bool:
    """Wait until ``ready()`` or the time is up; says which."""
    end = time.monotonic() + seconds
    while not ready():
        if time.monotonic() >= end:
            return False
        time.sleep(poll)
    return True


def line_counts(lines: DataFrame, keep) -> DataFrame:
    """Lines that pass, and distinct second comma fields among them."""
    f = F.split("value", ",")
    return lines.where(keep).agg(F.count("*").alias("lines"), F.count_distinct(F.get(f, F.lit(1))).alias("distinct_second"))
