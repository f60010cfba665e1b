"""Line files: accepted submits, receipts, metric scrapes, bench tables, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound_of
from ..schemas import BENCH, LOSS_BENCH


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value). ``line_no`` sorts as lines follow each other: by file name, then by the block of the file that a
    task reads, then by the line's place in it, whatever tasks the blocks are dealt to."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select(place.alias("line_no"), "value")


def accepted(raw: DataFrame) -> DataFrame:
    """``key,id,code`` lines -> (line_no, key, id, code); shorter lines are no submits, a fourth field is ignored."""
    f = F.split("value", ",")
    return raw.where(F.size(f) >= 3).select("line_no", f[0].alias("key"), f[1].alias("id"), f[2].alias("code"))


def receipts(raw: DataFrame) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return raw.where(F.size(f) >= 2).select(
        "line_no", F.get(f, F.lit(0)).try_cast("bigint").alias("mono_ms"), F.get(f, F.lit(1)).alias("key"), F.get(f, F.lit(2)).alias("attempt"),
        F.get(f, F.lit(3)).alias("path"), F.get(f, F.lit(4)).try_cast("bigint").alias("bytes"),
    )


def metrics(raw: DataFrame) -> DataFrame:
    """Prometheus text lines -> (name, labels, value); comments and malformed lines are left out."""
    m = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)$"
    labels = F.regexp_extract_all(F.regexp_extract("value", m, 2), F.lit(r'(\w+)="([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all(F.regexp_extract("value", m, 2), F.lit(r'(\w+)="([^"]*)"'), F.lit(2))
    return raw.where(F.col("value").rlike(m)).select(
        F.regexp_extract("value", m, 1).alias("name"), F.map_from_arrays(labels, values).alias("labels"),
        F.regexp_extract("value", m, 3).try_cast("double").alias("number"),
    ).withColumnRenamed("number", "value")


def buckets(parsed: DataFrame, name: str) -> DataFrame:
    return parsed.where(F.col("name") == f"{name}_bucket").select(bound_of(F.col("labels")["le"]).alias("le"), F.col("value").cast("bigint").alias("cum"))


def bench(spark: SparkSession, path: str, loss: bool = False) -> DataFrame:
    return spark.read.csv(path, header=True, schema=LOSS_BENCH if loss else BENCH)


def exposition(samples: DataFrame, kind: str = "gauge") -> DataFrame:
    """(name, labels, value) -> one text line each, for ``write.text``; counters are whole numbers, gauges have six
    decimals."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    number = F.format_string("%d", F.col("value").cast("bigint")) if kind == "counter" else F.format_string("%.6f", F.col("value").cast("double"))
    return samples.select(F.concat(
        "name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(""), F.lit(" "), number,
    ).alias("value"))


def receipt_lines(received: DataFrame) -> DataFrame:
    """Deliveries (mono_ms, key, attempt, path, bytes) -> the sink's lines; a missing key or attempt is ``-``."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    return received.select(F.concat_ws(" ", F.col("mono_ms").cast("string"), dash("key"), dash("attempt"), "path", F.col("bytes").cast("string")).alias("value"))


def submit_stream(spark: SparkSession, start: int, n: int, prefix: str = "k", gateways: int = 5) -> DataFrame:
    """Sequential submits dealt round-robin to gateways 10, 11, ..."""
    return spark.range(start, start + n).select(
        F.concat(F.lit(f"{prefix}-"), F.col("id").cast("string")).alias("key"), (10 + F.col("id") % gateways).cast("int").alias("gateway")
    )


def with_faults(rows: DataFrame, rate: float, seed: int) -> DataFrame:
    """Seeded failure injection: adds ``failed``."""
    return rows.withColumn("failed", F.rand(seed) < rate)
