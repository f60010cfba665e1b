"""Helpers shared by the training-data operators: shared folders, lineage cuts, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode a temporary one where it is
    unset, which would be the driver's own disk on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='oplogue-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for as long as the block runs."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A job's shuffle files go as soon as it has ended.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


#: Bytes that a Python worker is handed at a time, where texts pass through it on the way to a table.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so later stages survive lost executors without recomputing it."""
    shared_root(df.sparkSession)
    with settings(df.sparkSession, SMALL):
        return df.checkpoint(eager=True)


def table(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """Like :func:`cut`, as Parquet: smaller on disk for wide rows, and in a folder that can be removed early. The
    shuffle files behind it are not kept."""
    spark = df.sparkSession
    path = f"{under}/{name}-{uuid.uuid4().hex[:8]}" if under else shared_folder(spark, name)
    with settings(spark, TIDY | SMALL):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``file`` (a hash of the file's path) and ``row`` (the row's place in it), which tell rows apart.

    What is not read from files, or has no hidden file columns any more, is first written to the shared folder.
    """
    from pyspark.errors import AnalysisException

    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    if "_metadata" not in docs.columns:
        try:
            found = docs.select("*", *place)
            found.schema  # noqa: B018  resolves now
            return found
        except AnalysisException:
            pass
    hidden = docs.withColumnRenamed("_metadata", "metadata of the table") if "_metadata" in docs.columns else docs
    found = table(hidden, "located").select("*", *place)
    return found.withColumnRenamed("metadata of the table", "_metadata") if "_metadata" in docs.columns else found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared root whose tables nothing reads any more; one that cannot be reached from here is
    left to whoever clears the root."""
    from pyarrow import fs

    try:
        system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        system.delete_dir(at)
    except (OSError, ValueError, NotImplementedError):
        pass


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the fast path where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
