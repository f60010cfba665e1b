"""Codes, names, limits and small arithmetic of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import STATE_NAMES

# Status -> HTTP code (others 503), and HTTP reasons (others "OK").
HTTP_CODES = {0: 200, 1: 200, 2: 409, 4: 400, 5: 404, 6: 409, 7: 409}
REASONS = {
    200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 400: "Bad Request", 404: "Not Found", 409: "Conflict",
    413: "Payload Too Large", 500: "Internal Server Error", 503: "Service Unavailable",
}
KEY_BYTES, URL_BYTES, BODY_BYTES = 64, 256, 640


def _case(value: Column, names: dict, default) -> Column:
    out = F.lit(default)
    for k, v in names.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def http_code(status: Column) -> Column:
    return _case(status, HTTP_CODES, 503)


def reason(code: Column) -> Column:
    return _case(code, REASONS, "OK")


def state_name(state: Column) -> Column:
    return _case(state, STATE_NAMES, "?")


def state_rank(state: Column) -> Column:
    """Done over dead letter over leased over ready."""
    return _case(state, {3: 3, 4: 2, 2: 1}, 0)


def nack_backoff_ms(attempt: Column) -> Column:
    """1, 2, 4, ... 32 s for attempts 1 to 6, then 60 s."""
    shift = F.when(attempt > 6, 6).otherwise(F.greatest(attempt - 1, F.lit(0)))
    return F.least(F.lit(1000) * F.pow(F.lit(2), shift), F.lit(60000)).cast("long")


def default_if_zero(value: Column, default: int) -> Column:
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def valid_submit(key: Column, url: Column, body: Column) -> Column:
    return (
        F.octet_length(key).between(1, KEY_BYTES) & F.octet_length(url).between(1, URL_BYTES)
        & (F.coalesce(F.octet_length(body), F.lit(0)) <= BODY_BYTES)
    )


def bucket_bound(i: Column) -> Column:
    """Upper bounds of the latency histogram in seconds: 0.001 * 2^i, i = 0..16."""
    return F.lit(0.001) * F.pow(F.lit(2.0), i)


def delta_or_zero(after: Column, before: Column) -> Column:
    return F.greatest(after - before, F.lit(0))


def is_job_id(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{32}$")


def job_id(origin: Column, nonce: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(x)), 16, "0") for x in (origin, nonce)))


def delivered(code: Column) -> Column:
    return (code >= 200) & (code < 300)


def retry_ack(code: Column) -> Column:
    return code.isin(0, 503)


def segment_name(lsn: Column) -> Column:
    return F.format_string("wal-%020d.log", lsn)


def segment_lsn(name: Column) -> Column:
    """First LSN of a segment file's name; null for other names."""
    return F.regexp_extract(name, r"^wal-([0-9]{20})\.log$", 1).try_cast("bigint")


def endpoint(address: Column, port: Column) -> Column:
    """Address as an unsigned number in network order, and port -> ``a.b.c.d:port``."""
    byte = lambda shift: F.shiftright(address, shift).bitwiseAND(F.lit(255))
    return F.format_string("%d.%d.%d.%d:%d", byte(24), byte(16), byte(8), byte(0), port)


def endpoint_parts(text: Column) -> Column:
    """``a.b.c.d:port`` -> struct(address, port); null without a port."""
    host, parts = F.substring_index(text, ":", 1), F.split(F.substring_index(text, ":", 1), r"\.")
    address = F.aggregate(F.transform(parts, lambda x: x.try_cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 8).bitwiseOR(x))
    made = F.struct(address.alias("address"), F.substring_index(text, ":", -1).try_cast("int").alias("port"))
    return F.when((F.instr(text, ":") > 0) & (F.size(parts) == 4) & (host != ""), made)


def next_port(text: Column, by: int) -> Column:
    """The endpoint ``by`` ports on: membership talks one port above the data."""
    return F.concat(F.substring_index(text, ":", 1), F.lit(":"), (F.substring_index(text, ":", -1).cast("int") + by).cast("string"))


def nonces(rows: DataFrame, boot: int, order: str) -> DataFrame:
    """Adds ``nonce``: the low half of the boot id above a running number."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("node").orderBy(order)) - 1
    return rows.withColumn("nonce", F.shiftleft(F.lit(boot & 0xFFFFFFFF).cast("bigint"), 32).bitwiseOR(n.cast("bigint")))
