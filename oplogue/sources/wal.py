"""The framed binary log as a Python data source: ``spark.read.format("oplogue_wal")``.

Options: ``dirs`` (comma list of log folders in merge order), ``mode`` (``stop_at_tear``: a bad frame ends the last segment
but fails in an earlier one; ``permissive``: it ends any segment). Reading never changes a file.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schemas import DEAD_LETTER, DONE, EXPIRE, LEASE, LOG_RECORDS, REPLICATE, SUBMIT, TAKEOVER

MAX_BODY = 1 << 16
SEGMENT_BYTES = 64 << 20
COMMITTED = "_committed.json"


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        out.append(c)
    return out


_CRC = np.array(_crc_table(), np.uint32)


def crc32c(data: bytes) -> int:
    """Castagnoli checksum; Spark's crc32 is another polynomial."""
    return int(checksums([data])[0])


def checksums(bodies: list[bytes]) -> np.ndarray:
    """Castagnoli checksums of many bodies, a byte of each at a time."""
    order = sorted(range(len(bodies)), key=lambda i: -len(bodies[i]))
    sizes = np.array([len(bodies[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(bodies[i] for i in order), np.uint8)
    at, c = np.cumsum(sizes) - sizes, np.full(len(bodies), 0xFFFFFFFF, np.uint32)
    live = len(bodies)
    for k in range(int(sizes[0]) if len(bodies) else 0):
        while sizes[live - 1] <= k:
            live -= 1
        c[:live] = c[:live] >> np.uint32(8) ^ _CRC[(c[:live] ^ data[at[:live] + k]) & np.uint32(0xFF)]
    out = np.empty(len(bodies), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def frame(body: bytes) -> bytes:
    if not 0 < len(body) <= MAX_BODY:
        raise ValueError("a record has 1 to 65536 bytes")
    return struct.pack("<II", len(body), crc32c(body)) + body


def frames(data: bytes) -> Iterator[bytes | None]:
    """Bodies in order; a last None if a bad frame ends the scan before the data does."""
    at, torn = 0, False
    while at < len(data) and not torn:
        bodies, checks = [], []
        while at < len(data) and len(bodies) < 4096:
            n, check = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
            if not 0 < n <= MAX_BODY or len(data) < at + 8 + n:
                torn = True
                break
            bodies.append(data[at + 8 : at + 8 + n])
            checks.append(check)
            at += 8 + n
        good = checksums(bodies) == np.array(checks, np.uint32)
        whole = len(bodies) if good.all() else int(np.argmin(good))
        yield from bodies[:whole]
        torn |= whole < len(bodies)
    if torn:
        yield None


def _endpoint(text: str | None) -> bytes:
    if not text:
        return bytes(6)
    host, port = text.rsplit(":", 1)
    return bytes(map(int, host.split("."))) + struct.pack(">H", int(port))


def _endpoint_text(raw: bytes) -> str | None:
    return None if raw == bytes(6) else f"{'.'.join(map(str, raw[:4]))}:{struct.unpack('>H', raw[4:])[0]}"


def encode(rec: dict, lsn: int) -> bytes:
    """A row of the log schema as the body of a frame."""
    kind = rec["rec_type"]
    job_id = struct.pack("<QQ", int(rec["job_id"][:16], 16), int(rec["job_id"][16:], 16))
    out = struct.pack("<BQ", kind, lsn) + job_id
    if kind in (SUBMIT, REPLICATE):
        j = rec["job"]
        for text in (j["idem_key"].encode(), j["url"].encode(), bytes(j["body"] or b"")):
            out += struct.pack("<H", len(text)) + text
        replicas = [*(j["replicas"] or []), None, None, None][:3]
        return (
            out + struct.pack("<II", j["visibility_ms"], j["max_attempts"]) + b"".join(map(_endpoint, replicas)) + struct.pack("<B", j["state"])
            + _endpoint(j["owner"]) + struct.pack("<III", j["epoch"], j["lease_seq"], j["attempts"])
        )
    out += struct.pack("<I", rec["epoch"])
    if kind in (LEASE, DONE, EXPIRE):
        out += struct.pack("<I", rec["lease_seq"])
    if kind == LEASE:
        out += struct.pack("<Q", int(rec["worker"] or 0))
    if kind == TAKEOVER:
        out += _endpoint(rec["new_owner"])
    return out


@dataclass
class _Cursor:
    raw: bytes
    at: int = 0
    ok: bool = field(default=True)

    def take(self, n: int) -> bytes:
        got = self.raw[self.at : self.at + n]
        if len(got) < n:
            raise ValueError("short record")
        self.at += n
        return got

    def number(self, form: str) -> int:
        return struct.unpack(f"<{form}", self.take(struct.calcsize(f"<{form}")))[0]


def decode(body: bytes) -> dict | None:
    """A frame's body as a row of the log schema, or None if it is no record; sizes are checked as bytes."""
    c = _Cursor(body)
    try:
        kind, lsn = c.number("B"), c.number("Q")
        if not SUBMIT <= kind <= TAKEOVER:
            return None
        out = dict.fromkeys(("epoch", "lease_seq", "worker", "new_owner", "job"))
        out |= {"rec_type": kind, "lsn": lsn, "job_id": f"{c.number('Q'):016x}{c.number('Q'):016x}"}
        if kind in (SUBMIT, REPLICATE):
            texts = []
            for most in (64, 256, 640):
                n = c.number("H")
                if n > most:
                    return None
                texts.append(c.take(n))
            job = {"idem_key": texts[0].decode(), "url": texts[1].decode(), "body": texts[2], "visibility_ms": c.number("I"), "max_attempts": c.number("I")}
            job["replicas"] = [_endpoint_text(c.take(6)) for _ in range(3)]
            job["state"] = c.number("B")
            if not 1 <= job["state"] <= 4:
                return None
            job["owner"] = _endpoint_text(c.take(6))
            job |= {k: c.number("I") for k in ("epoch", "lease_seq", "attempts")}
            return out | {"job": job}
        out["epoch"] = c.number("I")
        if kind in (LEASE, DONE, EXPIRE):
            out["lease_seq"] = c.number("I")
        if kind == LEASE:
            out["worker"] = Decimal(c.number("Q"))
        if kind == TAKEOVER:
            out["new_owner"] = _endpoint_text(c.take(6))
        return out
    except (ValueError, UnicodeDecodeError):
        return None


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def segments(folder: str) -> list[str]:
    """Segment files of a log folder in log order."""
    from pyarrow import fs

    system, top = _fs(folder)
    found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("wal-") and f.base_name.endswith(".log"))


def log_dirs(path: str) -> list[str]:
    """Log folders that a write to ``path`` committed, in partition order."""
    system, top = _fs(path)
    with system.open_input_file(f"{top}/{COMMITTED}") as f:
        return [f"{path}/{name}" for name in json.loads(f.read())]


@dataclass
class _Segment(InputPartition):
    order: int
    node: str
    folder: str
    path: str
    last: bool


class WalReader(DataSourceReader):
    """One partition for each segment. Its name is the LSN of its first record, which gives every record its place."""

    def __init__(self, options):
        self.dirs = [d for d in (options.get("dirs") or options.get("path") or "").split(",") if d]
        self.mode = options.get("mode", "stop_at_tear")

    def partitions(self):
        out = []
        for i, d in enumerate(self.dirs):
            files = segments(d)
            out += [_Segment(i, d.rstrip("/").rsplit("/", 1)[-1], d, path, path == files[-1]) for path in files]
        return out or [_Segment(0, "", "", "", True)]

    def read(self, partition: _Segment):
        if not partition.path:
            return
        name = partition.path.rsplit("/", 1)[-1]
        with _fs(partition.folder)[0].open_input_file(partition.path) as f:
            data = f.read()
        for pos, body in enumerate(frames(data), int(name.removeprefix("wal-").removesuffix(".log"))):
            if body is None:
                if not partition.last and self.mode == "stop_at_tear":
                    raise ValueError(f"bad frame before the last segment: {partition.path}")
                return
            rec = decode(body)
            if rec is not None:
                j = rec["job"]
                yield (
                    partition.node, partition.order, name, pos, rec["lsn"], rec["rec_type"], rec["job_id"], rec["epoch"], rec["lease_seq"],
                    rec["worker"], rec["new_owner"], tuple(j.values()) if j else None,
                )


@dataclass
class _Written(WriterCommitMessage):
    part: int
    folder: str


class WalWriter(DataSourceWriter):
    """Each task writes a log folder of segments under a name of its own attempt; rows keep their order. Only the folders
    that Spark commits are listed in ``path``/_committed.json, so what lost attempts wrote is not part of the log."""

    def __init__(self, options):
        self.path, self.limit = options["path"], int(options.get("segment_bytes", SEGMENT_BYTES))

    def write(self, rows):
        from pyspark import TaskContext

        system, top = _fs(self.path)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex[:8]}"
        folder = f"{top}/{name}"
        system.create_dir(folder, recursive=True)
        lsn, out, size = 0, None, 0
        for row in rows:
            raw = frame(encode(row.asDict(recursive=True), lsn))
            if out is None or size + len(raw) > self.limit:
                if out:
                    out.close()
                out, size = system.open_output_stream(f"{folder}/wal-{lsn:020d}.log", compression=None), 0
            out.write(raw)
            lsn, size = lsn + 1, size + len(raw)
        if out:
            out.close()
        return _Written(part, name)

    def commit(self, messages):
        system, top = _fs(self.path)
        names = [m.folder for m in sorted((m for m in messages if m), key=lambda m: m.part)]
        with system.open_output_stream(f"{top}/{COMMITTED}", compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        system, top = _fs(self.path)
        for m in messages:
            if m:
                system.delete_dir(f"{top}/{m.folder}")


def operator_rows(raw: DataFrame) -> DataFrame:
    """Rows of the source -> the columns that the log operators take: those of a submitted or replicated job, and those
    of a fence, under one name each."""
    j = lambda c: F.col(f"job.{c}")
    return raw.select(
        "node", "log_ord", "pos", "lsn", "rec_type", "job_id", F.coalesce("epoch", j("epoch")).alias("epoch"), F.coalesce("lease_seq", j("lease_seq")).alias("lease_seq"),
        j("state").cast("int").alias("copy_state"), j("idem_key").alias("idem_key"), F.coalesce(j("owner"), "new_owner").alias("owner"),
        F.decode(j("body"), "UTF-8").alias("body"), j("url").alias("url"), j("visibility_ms").alias("visibility_ms"), j("max_attempts").alias("max_attempts"), j("replicas").alias("replicas"),
    )


class WalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "oplogue_wal"

    def schema(self) -> str:
        return " ".join(LOG_RECORDS.split())

    def reader(self, schema):
        return WalReader(self.options)

    def writer(self, schema, overwrite):
        return WalWriter(self.options)


def register(spark) -> None:
    spark.dataSource.register(WalSource)
