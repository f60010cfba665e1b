"""Requests and responses, and routes by longest prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outcomes(requests: DataFrame, responses: DataFrame, timeout_ms: int, deaths: DataFrame | None = None, most_bytes: int = 1 << 16, in_flight: int | None = None) -> DataFrame:
    """(req_id, peer, sent, bytes), (peer, got) and (peer, died) -> (req_id, got, outcome): one outcome each.

    A body over ``most_bytes`` is too_large at once; else the peer's first answer within the timeout is ok, its death
    before that is peer_down, and what is left is a timeout; later answers are dropped. With ``in_flight``, a request
    beyond that many of its peer within one timeout is busy. All three are put in one line by peer and time, so that no
    request meets more than its next answer.
    """
    r = requests.select("peer", F.col("sent").alias("at"), F.lit(0).alias("kind"), "req_id", "bytes")
    none = [F.lit(None).cast("bigint").alias("req_id"), F.lit(None).cast("bigint").alias("bytes")]
    line = r.union(responses.select("peer", F.col("got").alias("at"), F.lit(1).alias("kind"), *none))
    if deaths is not None:
        line = line.union(deaths.select("peer", F.col("died").alias("at"), F.lit(2).alias("kind"), *none))
    ahead = Window.partitionBy("peer").orderBy("at", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    after = lambda kind: F.first(F.when(F.col("kind") == kind, F.col("at")), ignorenulls=True).over(ahead)
    limit = F.col("at") + F.expr(f"interval {timeout_ms} milliseconds")
    near = Window.partitionBy("peer").orderBy(F.unix_millis(F.col("at").cast("timestamp"))).rangeBetween(-timeout_ms, 0)
    ahead_of_it = F.count_if(F.col("kind") == 0).over(near) if in_flight else F.lit(0)
    found = line.select("*", after(1).alias("next_got"), after(2).alias("next_death"), ahead_of_it.alias("open")).where("kind = 0").select(
        "req_id", "bytes", "open", limit.alias("limit"), F.when(F.col("next_got") <= limit, F.col("next_got")).alias("got"), F.when(F.col("next_death") <= limit, F.col("next_death")).alias("died")
    )
    outcome = (
        F.when(F.col("bytes") > most_bytes, "too_large").when(F.lit(in_flight is not None) & (F.col("open") > (in_flight or 0)), "busy")
        .when(F.col("died").isNotNull() & (F.col("got").isNull() | (F.col("died") < F.col("got"))), "peer_down").when(F.col("got").isNotNull(), "ok").otherwise("timeout")
    )
    return found.select("req_id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("got")).alias("got"))


def route(requests: DataFrame, routes: DataFrame, path: str = "path", key: str = "page_id") -> DataFrame:
    """(key, path) -> (key, route), the longest prefix in ``routes`` (prefix); null without one.

    Every prefix of a path is looked up by equality, so any number of routes will do.
    """
    each = F.transform(F.sequence(F.lit(0), F.length(path)), lambda i: F.substring(F.col(path), F.lit(1), i))
    found = requests.select(key, F.explode_outer(each).alias("prefix")).join(routes.select("prefix", F.lit(True).alias("is_route")).distinct(), "prefix", "left")
    return found.groupBy(key).agg(F.max_by("prefix", F.when(F.col("is_route"), F.length("prefix"))).alias("route"))
