"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

#: Edges that one task takes of a round's table; a small table is not dealt over as many tasks as the input.
EACH = 1 << 17


def _both(edges: DataFrame) -> DataFrame:
    """Each edge from either end, as (u, v), in one pass."""
    ends = F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
    return edges.select(F.inline(F.array(*ends)))


def _stars(both: DataFrame, keep_larger: bool) -> DataFrame:
    """For each node u, link its (larger or not larger) neighbours to the least node around u."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least.hint("merge"), "u")  # never broadcast, which would pass the nodes through the driver
    if keep_larger:
        return linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(own).where("a <> b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, component), component the least node reachable.

    Nodes without an edge do not appear. Only columns a and b are read; null ends are no links; an empty table gives
    an empty result. Each round halves path lengths at least, and is cut from its lineage in the shared folder.
    """
    def mark(df):
        r = df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        return tuple(r)

    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = mark(now)
    most = shuffle_partitions(edges.sparkSession)
    for _ in range(rounds):
        if not before[0]:
            break
        tasks = min(before[0] // EACH + 1, most)
        large = _stars(_both(now.coalesce(tasks)), True).distinct()
        small = _stars(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False).distinct()
        now = cut(small.coalesce(tasks))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select("b", "b").distinct()
    )
