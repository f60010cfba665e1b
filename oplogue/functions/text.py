"""Text of requests and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_decode(text: Column) -> Column:
    """Percent-decoding that leaves malformed escapes as they are; '+' is a space.

    Malformed escapes are quoted first, so the built-in decoder only meets sound ones.
    """
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_map(url: Column) -> Column:
    """Query string -> map of decoded names and values; without '=' the value is '', of repeated names the last wins."""
    query = F.regexp_replace(F.regexp_extract(url, r"\?([^#]*)", 1), "^&+|&+$", "")
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    entries = F.transform(pairs, lambda p: F.struct(
        url_decode(F.substring_index(p, "=", 1)).alias("k"),
        F.when(F.instr(p, "=") > 0, url_decode(F.regexp_extract(p, "=(?s)(.*)$", 1))).otherwise("").alias("v"),
    ))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def host_port_path(url: Column) -> Column:
    """http:// URL -> struct(host, port, path); port 80 and path '/' where missing, null for other schemes."""
    rest = F.regexp_extract(url, "^http://(.*)$", 1)
    authority = F.substring_index(rest, "/", 1)
    parts = F.struct(
        F.substring_index(authority, ":", 1).alias("host"),
        F.coalesce(F.regexp_extract(authority, ":([0-9]+)$", 1).try_cast("int"), F.lit(80)).alias("port"),
        F.when(F.instr(rest, "/") > 0, F.regexp_extract(rest, "(/.*)$", 1)).otherwise("/").alias("path"),
    )
    return F.when(url.startswith("http://"), parts)


def listed(text: Column) -> Column:
    """Comma list without its empty items."""
    return F.filter(F.split(text, ","), lambda x: x != "")


def number_or(text: Column, default: int) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(default))


def bound_of(label: Column) -> Column:
    return F.when(label == "+Inf", F.lit(1e18)).otherwise(label.try_cast("double"))


def bucket_line(name: str, bound: Column, cumulative: Column) -> Column:
    le = F.when(bound > 1e17, "+Inf").otherwise(F.format_string("%.3f", bound))
    return F.format_string(name + '_bucket{le="%s"} %d', le, cumulative)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def header(line: Column) -> Column:
    """``Name: value`` -> struct(name in lower case, value without leading spaces); null without a colon."""
    made = F.struct(lower_ascii(F.substring_index(line, ":", 1)).alias("name"), F.ltrim(F.regexp_extract(line, ":(?s)(.*)$", 1)).alias("value"))
    return F.when(F.instr(line, ":") > 0, made)


def header_map(lines: Column) -> Column:
    """Header lines -> map by name; of repeated names the last wins."""
    made = F.filter(F.transform(lines, header), lambda h: h.isNotNull())
    last = F.filter(made, lambda e, i: ~F.exists(F.slice(made, i + 2, F.size(made)), lambda later: later["name"] == e["name"]))
    return F.map_from_entries(last)


def captured(text: Column, name: str) -> Column:
    """The string that a one-line JSON text gives ``name``; null without it."""
    return F.nullif(F.regexp_extract(text, f'"{name}":"([^"]*)"', 1), F.lit(""))


def job_json(job_id: Column, state: Column, epoch: Column, attempts: Column, owner: Column) -> Column:
    """Status of a job as the service words it."""
    return F.format_string('{"id":"%s","state":"%s","epoch":%d,"attempts":%d,"owner":"%s"}', job_id, state, epoch, attempts, owner)


def submit_json(job_id: Column, created: Column) -> Column:
    return F.format_string('{"id":"%s","status":"%s"}', job_id, F.when(created, "created").otherwise("duplicate"))


def nodes_json(nodes: Column) -> Column:
    """Array of nodes -> JSON list of them, in the array's order."""
    return F.concat(F.lit("["), F.array_join(F.transform(nodes, lambda n: F.concat(F.lit('{"node":"'), n, F.lit('"}'))), ","), F.lit("]"))


def bounded(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def counter_line(name: str, labels: str, value: Column) -> Column:
    return F.format_string(f"{name}{labels} %d", value)


def gauge_line(name: str, labels: str, value: Column) -> Column:
    return F.format_string(f"{name}{labels} %.6f", value)


def histogram_lines(name: str, bounds: Column, cumulative: Column, total_seconds: Column, count: Column) -> Column:
    """Array of exposition lines: every bucket, then sum and count."""
    each = F.transform(F.arrays_zip(bounds.alias("le"), cumulative.alias("cum")), lambda b: F.concat(
        F.lit(f'{name}_bucket{{le="'), F.when(b["le"] > 1e17, "+Inf").otherwise(F.format_string("%.3f", b["le"])), F.lit('"} '), b["cum"].cast("string")
    ))
    return F.concat(each, F.array(F.format_string(f"{name}_sum %.6f", total_seconds), F.format_string(f"{name}_count %d", count)))
