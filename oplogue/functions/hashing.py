"""Key hashes and ring positions as Spark expressions that never overflow under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
# FNV-1a's offset basis in two halves, and the low part of its prime 2^40 + 435.
FNV_HIGH, FNV_LOW, FNV_PRIME_LOW = 0xCBF29CE4, 0x84222325, 435


def fnv1a(key: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as a signed long; worked in 32-bit halves."""
    digits = F.hex(F.encode(key, "UTF-8"))
    bytes_ = F.transform(
        F.filter(F.sequence(F.lit(0), F.octet_length(key)), lambda i: i < F.octet_length(key)),
        lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"),
    )

    def step(acc: Column, b: Column) -> Column:
        x = acc["lo"].bitwiseXOR(b)
        product = x * FNV_PRIME_LOW
        high = (acc["hi"] * FNV_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(x, 8)).bitwiseAND(F.lit(MASK32))
        return F.struct(high.alias("hi"), product.bitwiseAND(F.lit(MASK32)).alias("lo"))

    start = F.struct(F.lit(FNV_HIGH).cast("long").alias("hi"), F.lit(FNV_LOW).cast("long").alias("lo"))
    return F.aggregate(bytes_, start, step, lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"]))


def unsigned_order(x: Column) -> Column:
    """A signed long that sorts as ``x`` does unsigned."""
    return x.bitwiseXOR(F.lit(-(2**63)))


def splitmix64(x: int) -> int:
    """Finaliser that spreads endpoint keys over the ring; runs on the driver, for a handful of nodes."""
    m = 2**64 - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def endpoint_key(endpoint: str) -> int:
    """``a.b.c.d:port`` -> 48-bit key: address and port as they lie in network order, read little-endian."""
    host, port = endpoint.rsplit(":", 1)
    return int.from_bytes(bytes(map(int, host.split("."))), "little") << 16 | int.from_bytes(int(port).to_bytes(2, "big"), "little")
