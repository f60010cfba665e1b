"""Exact deduplication with disk-backed stream state."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TIDY, located, lower_ascii, read, remove, settings, shared_folder, table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Many small state stores must not each set disk aside for their logs.
STORE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
INTAKE = "digest string, id bigint, file bigint, row bigint"
STATE = "digest string, n bigint, keep struct<id:bigint,file:bigint,row:bigint>, content struct<file:bigint,row:bigint>, batch int"
#: Digests that one micro-batch takes in, in bytes of their files.
BATCH_BYTES = 8 << 30


def track(intake: DataFrame, out: str, state: str) -> None:
    """Run the stream: ``intake`` (digest, id, file, row) into RocksDB state keyed by digest, which never expires.

    State per digest: how many rows, the largest (id, locator) and the first locator seen, where the stored content
    is. Each micro-batch appends the digests it changed to ``out``/batch=N (rewritten whole if the batch is rerun).
    """
    seen = intake.groupBy("digest").agg(
        F.count("*").alias("n"),
        F.max(F.struct("id", "file", "row")).alias("keep"),
        F.min(F.struct("file", "row")).alias("content"),
    )

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        seen.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
        .foreachBatch(write).start()
    )
    query.awaitTermination()


def _found(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one before the first row is written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _classes(rows: DataFrame, digest, files_per_batch: int | None, folder: str | None) -> DataFrame:
    """``rows`` (id, text, file, row) -> (doc_id, keep_id, group_size, kept, digest, file, row)."""
    spark = rows.sparkSession
    norm = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    keyed = rows.select(F.col("id").cast("long").alias("id"), "file", "row", norm.alias("norm"), digest(norm).alias("digest"))
    home = folder or shared_folder(spark, "exact")
    intake, out, state = f"{home}/intake", f"{home}/digests", f"{home}/state"
    fresh = keyed.select("digest", "id", "file", "row")
    if folder:
        fresh = fresh.join(_found(spark, intake, INTAKE).select("file", "row"), ["file", "row"], "left_anti")
    with settings(spark, TIDY):
        fresh.write.mode("append").parquet(intake)
    stream = spark.readStream.schema(INTAKE)
    stream = stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream.option("maxBytesPerTrigger", str(BATCH_BYTES))
    with settings(spark, STORE):
        track(stream.parquet(intake), out, state)
    if not folder:
        remove(spark, state)
    taken = spark.read.schema(INTAKE).parquet(intake)
    latest = _found(spark, out, STATE).groupBy("digest").agg(F.max_by(F.struct("n", "keep", "content"), "batch").alias("s")).select("digest", "s.*")

    # Hits: compare the full bytes under every digest seen twice. Rows are fetched by where they lie, which spreads the
    # copies of one text; copies meet again only after each task has merged its own. The text that holds the digest's
    # content locator is the stored one; any other text under that digest is a collision and forms a group of its own.
    hits = latest.where("n > 1").select("digest", F.col("content").alias("stored"))
    places = taken.join(hits, "digest").select("file", "row", "stored")
    texts = (
        keyed.join(places, ["file", "row"]).groupBy("digest", "norm")
        .agg(F.count("*").alias("same"), F.max(F.struct("id", "file", "row")).alias("keep"), F.min(F.struct("file", "row")).alias("content"), F.first("stored").alias("stored"))
    ).withColumn("whole", F.col("content") == F.col("stored"))
    checked = table(texts.select("digest", "same", "keep", "whole"), "checked")
    odd = checked.where("not whole").select("digest").distinct()
    sure = latest.where("n = 1").select("digest", F.col("n").alias("size"), "keep").union(
        checked.join(odd, "digest", "left_anti").select("digest", "same", "keep")
    )
    columns = [
        F.col("r.id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("keep.id").eqNullSafe(F.col("r.id")) & (F.col("keep.file") == F.col("r.file")) & (F.col("keep.row") == F.col("r.row"))).alias("kept"),
        F.col("r.digest").alias("digest"), F.col("r.file").alias("file"), F.col("r.row").alias("row"),
    ]
    result = taken.alias("r").join(sure, "digest").select(*columns)
    if odd.isEmpty():  # texts need to be moved again only if digests collide
        return result
    apart = texts.join(odd, "digest", "left_semi").select("digest", "norm", F.col("same").alias("size"), "keep")
    return result.union(keyed.alias("r").join(apart, ["digest", "norm"]).select(*columns))


def sha256(text):
    return F.sha2(text, 256)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int | None = None, folder: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, digest).

    Texts, of any length, are equal when identical after lower-casing A-Z only; a null text counts as empty. Of equal
    texts the row with the largest id stays (null ids lowest; of repeated rows with that id, the one with the largest
    content locator, so exactly one row of a group is kept). ``digest`` maps the normalised text column to its key
    (SHA-256); rows whose digests collide are told apart by their bytes. Other columns are not read, whatever their
    names.

    ``docs`` read from files is used where it lies; any other table is first written to the shared folder, as the
    stored content that locators (file, row) point to. With ``folder``, in the shared file system, state lasts: a later
    call over the same files and new ones takes in the new rows only, and they meet what the state holds of the old.
    """
    rows = located(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return _classes(rows, digest, files_per_batch, folder)


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, as they are."""
    rows = located(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc")))
    found = _classes(rows.select(F.col(f"doc.{id_col}").alias("id"), F.col(f"doc.{text_col}").alias("text"), "file", "row"), sha256, None, None)
    return rows.join(found.where("not kept").select("file", "row"), ["file", "row"], "left_anti").select("doc.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


ORACLE = r"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""
