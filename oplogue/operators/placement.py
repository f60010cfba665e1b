"""Consistent-hash placement of keys on a few nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import endpoint_key, fnv1a, splitmix64, unsigned_order


def ring(nodes: list[str]) -> list[tuple[int, str]]:
    """(position, node) in ring order."""
    return sorted((splitmix64(endpoint_key(n)), n) for n in nodes)


def replicas(key: Column, nodes: list[str], copies: int = 3) -> Column:
    """The first ``copies`` nodes at or after the key's hash, around the ring; empty without nodes."""
    if not nodes:
        return F.array().cast("array<string>")
    order = ring(nodes)
    places = F.array(*(F.lit(p - 2**63).cast("long") for p, _ in order))
    names = F.array(*(F.lit(n) for _, n in order))
    start = F.size(F.filter(places, lambda p: p < unsigned_order(fnv1a(key)))) % len(order)
    return F.slice(F.concat(names, names), start + 1, F.lit(min(copies, len(order))))


def place(keys: DataFrame, nodes: list[str], key: str = "key") -> DataFrame:
    r = F.explode(F.array(replicas(F.col(key), nodes)))
    return keys.select(key, F.hex(fnv1a(F.col(key))).alias("key_hash"), r.alias("replicas")).withColumn("owner", F.get("replicas", F.lit(0)))


def first_alive(replica_list: Column, alive: Column) -> Column:
    return F.try_element_at(F.filter(replica_list, lambda r: F.array_contains(alive, r)), F.lit(1))


def fallback(self_node: Column, alive: Column) -> Column:
    """Where the ring owner cannot be reached: self, then the first two others alive."""
    return F.concat(F.array(self_node), F.slice(F.filter(alive, lambda a: a != self_node), 1, 2))
