"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A suffix is indexed where its first ``ANCHOR`` bytes have the least hash of a whole window of ``LENGTH`` bytes, so every
such window holds one indexed place, and equal windows hold it at the same distance. Two equal windows therefore always
meet under one suffix, though only about one place in seventy is indexed. A suffix array is a table of the first
``ANCHOR`` bytes of those suffixes in the order of the bytes, each with how often it stands and where it stands first. A
new batch's array is merge-scanned with every level for neighbours that match over all those bytes; equal-sized levels
merge. In the documents with such suffixes, the windows around them are then counted.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import grouped
from .common import located, read, remove, shared_folder, shuffle_partitions, table

LENGTH, ANCHOR = 200, 64
BATCHES = 4
#: Contexts of one suffix beyond which Spark counts its windows, each a row, so that no task holds the suffix.
HOT = 20_000
#: Bytes of a text that are hashed at a time; longer texts are cut into pieces that overlap by a window.
PIECE = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2^64, at least ``n`` of them."""
    p = _powers.setdefault(base, np.ones(1, np.uint64))
    while len(p) < n:
        p = _powers[base] = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    return p


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any stretch of a byte array in constant time."""

    def __init__(self, b: np.ndarray, second: bool = False):
        n, base = len(b), _BASES[second]
        forward, self.back = _power(base, n + 1), _power(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * forward[:n], out=self.sums[1:])

    def each(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.back[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    m, done = h, 1
    while 2 * done <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def suffixes(texts: list[bytes], places: bool = True) -> tuple[np.ndarray, ...]:
    """Indexed suffixes of some documents: (document, place, first window, last window, anchor, context, context2, and
    the place among all bytes).

    Windows first..last start there and have their indexed place here. ``anchor`` is the hash of the suffix's first 64
    bytes, ``context`` and ``context2`` are two hashes of all bytes of its windows.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.r_[0, np.cumsum(sizes)]
    b = np.frombuffer(b"".join(texts), np.uint8)
    if len(b) < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(8))
    roll = Rolling(b)
    hashes = roll.each(ANCHOR)
    keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    place = (_least(keyed, LENGTH - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(place) + 1, np.int64)
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if e - s >= LENGTH:
            inside[s] += 1
            inside[e - LENGTH + 1] -= 1
    windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(windows):
        return tuple(np.empty(0, np.int64) for _ in range(8))
    at = place[windows]
    new = np.r_[True, (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)]
    first = windows[new]
    last = windows[np.r_[np.flatnonzero(new)[1:] - 1, len(windows) - 1]]
    at = at[new]
    doc = np.searchsorted(offsets, at, side="right") - 1
    base = offsets[doc]
    shape = ((at - first).astype(np.uint64) << np.uint64(32)) ^ (last - first).astype(np.uint64)
    rolls = (roll, Rolling(b, second=True)) if places else ()
    context = [_mix(r.of(first, last + LENGTH) ^ shape).view(np.int64) for r in rolls] or [at, at]
    return doc, at - base, first - base, last - base, hashes[at].view(np.int64), *context, at


def _pieces(texts: list[str | None]):
    """Runs of (text number, start, bytes) of about ``PIECE`` bytes together."""
    cut = []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for s in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):
            cut.append((i, s, raw[s : s + PIECE + LENGTH - 1]))
    for s, e in grouped([len(x[2]) for x in cut], PIECE):
        if e > s:
            yield cut[s:e]


def _scan(rows: DataFrame, places: bool) -> DataFrame:
    """``rows`` (file, row, text) -> with ``places``, (anchor, context, context2, file, row, first, last) of each indexed
    suffix; else (prefix, anchor, file, row, at), the entries of a suffix array."""

    def run(batches):
        for b in batches:
            for some in _pieces(b.column(2).to_pylist()):
                doc, at, first, last, anchor, context, context2, whole = suffixes([x[2] for x in some], places)
                start = np.array([x[1] for x in some], np.int64)[doc] if len(doc) else doc
                take = pa.array(np.array([x[0] for x in some], np.int64)[doc] if len(doc) else doc)
                own = [b.column(k).take(take) for k in range(2)]
                if places:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), pa.array(context), pa.array(context2), *own, pa.array((first + start).astype(np.int32)), pa.array((last + start).astype(np.int32))],
                        names=["anchor", "context", "context2", "file", "row", "first", "last"],
                    )
                elif len(doc):
                    raw = np.frombuffer(b"".join(x[2] for x in some), np.uint8)
                    bytes_ = np.lib.stride_tricks.sliding_window_view(raw, ANCHOR)[whole].tobytes()
                    prefix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ANCHOR), len(doc), [None, pa.py_buffer(bytes_)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([prefix, pa.array(anchor), *own, pa.array((at + start).astype(np.int32))], names=["prefix", "anchor", "file", "row", "at"])

    made = "anchor long, context long, context2 long, file long, row long, first int, last int" if places else "prefix binary, anchor long, file long, row long, at int"
    return rows.select("file", "row", "text").mapInArrow(run, made)


def _matches(batches):
    """Entries of several arrays in one order -> anchors of those that match their neighbour over all ``ANCHOR`` bytes."""
    left = None
    for b in batches:
        if not b.num_rows:
            continue
        raw, anchor = b.column(0).cast(pa.binary(ANCHOR)), b.column(1).to_numpy(zero_copy_only=False)
        now = np.frombuffer(raw.buffers()[1], np.uint8)[ANCHOR * raw.offset : ANCHOR * (raw.offset + len(raw))].reshape(-1, ANCHOR)
        before = np.vstack([now[:1] if left is None else left, now[:-1]])
        match = (now == before).all(axis=1)  # the length in common is ANCHOR exactly where no byte differs
        match[0] &= left is not None
        left = now[-1:].copy()
        yield pa.RecordBatch.from_arrays([pa.array(anchor[match])], names=["anchor"])


ENTRY = "prefix binary, anchor long, n long, file long, row long, at int"


class IndexFamily:
    """Sorted suffix arrays on disk, the levels: a new batch is merge-scanned with all of them for suffixes in common and
    becomes a level itself. Before the next batch, levels of equal size merge, as a carry runs through a binary number.

    The arrays lie in ``folder`` of the shared file system, with a list of them, so that another call can add to them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        from pyarrow import fs

        self.spark, self.folder = spark, folder
        self.system, self.at = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        self.levels, self.found, self.taken = [], [], []
        if self.system.get_file_info(f"{self.at}/family.json").type == fs.FileType.File:
            with self.system.open_input_file(f"{self.at}/family.json") as f:
                held = json.loads(f.read())
            self.levels, self.found, self.taken = held["levels"], held["found"], held["taken"]

    def _save(self) -> None:
        with self.system.open_output_stream(f"{self.at}/family.json") as f:
            f.write(json.dumps({"levels": self.levels, "found": self.found, "taken": self.taken}).encode())

    def _write(self, df: DataFrame, name: str) -> str:
        return table(df, name, self.folder).inputFiles()[0].rsplit("/", 1)[0]

    def _ordered(self, df: DataFrame) -> DataFrame:
        """Ranges of the order to partitions, each in order."""
        return df.repartitionByRange(shuffle_partitions(self.spark), "prefix").sortWithinPartitions("prefix")

    @staticmethod
    def _merged(df: DataFrame) -> DataFrame:
        """One entry for equal bytes."""
        return df.groupBy("prefix").agg(F.first("anchor").alias("anchor"), F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("file", "row", "at")))

    def carry(self) -> None:
        """Merge levels of equal size until all sizes differ."""
        old = []
        while len({size for size, _ in self.levels}) < len(self.levels):
            self.levels.sort()
            k = next(i for i in range(len(self.levels) - 1) if self.levels[i][0] == self.levels[i + 1][0])
            (size, a), (_, b) = self.levels[k], self.levels[k + 1]
            # Dealt by ranges already, equal entries need no other shuffle to meet.
            line = self._level(a).union(self._level(b)).repartitionByRange(shuffle_partitions(self.spark), "prefix")
            self.levels[k : k + 2] = [[2 * size, self._write(self._merged(line).sortWithinPartitions("prefix").select("prefix", "anchor", "n", "file", "row", "at"), "level")]]
            old += [a, b]
        if old:
            self._save()
        for path in old:
            remove(self.spark, path)

    def _level(self, path: str) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(path)

    def new(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` that no batch held."""
        return rows if not self.taken else rows.join(self.spark.read.schema("file long, row long").parquet(*self.taken), ["file", "row"], "left_anti")

    def add(self, batch: DataFrame) -> None:
        """``batch`` (file, row, text) of new rows."""
        self.carry()
        entries = _scan(batch, False).withColumn("n", F.lit(1).cast("long"))
        path = self._write(self._ordered(self._merged(entries)).select("prefix", "anchor", "n", "file", "row", "at"), "level")
        array = self._level(path)
        union = array.where("n > 1").select("anchor")
        for _, other in self.levels:
            both = array.select("prefix", "anchor").union(self._level(other).select("prefix", "anchor"))
            union = union.union(self._ordered(both).mapInArrow(_matches, "anchor long"))
        self.found.append(self._write(union, "repeated"))
        self.levels.append([1, path])
        self.taken.append(self._write(batch.select("file", "row"), "taken"))
        self._save()

    def repeated(self) -> DataFrame:
        """Anchors of all suffixes found twice or more, in a batch or across."""
        return self.spark.read.schema("anchor long").parquet(*self.found).distinct()


def _contexts(batches):
    """Documents with the suffixes to compare -> the bytes of their windows."""
    for b in batches:
        out = []
        files, numbers, texts, lists = (b.column(k).to_pylist() for k in range(4))
        for file, row, text, some in zip(files, numbers, texts, lists, strict=True):
            raw = (text or "").encode()
            out += [(x["anchor"], file, row, x["first"], x["n"], raw[x["first"] : x["last"] + LENGTH]) for x in some]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "file", "row", "first", "n", "raw"])


def _windows(batches):
    """Documents with hot suffixes -> a row for each window: the place of its context, its own start and two hashes."""
    for b in batches:
        files, numbers, texts, lists = (b.column(k).to_pylist() for k in range(4))
        for file, row, text, some in zip(files, numbers, texts, lists, strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            for s, e in grouped([x["last"] - x["first"] + 1 for x in some], 100_000):
                starts = [np.arange(x["first"], x["last"] + 1) for x in some[s:e]]
                if not starts:
                    continue
                hashes = [np.concatenate([Rolling(raw[x["first"] : x["last"] + LENGTH], k).each(LENGTH) for x in some[s:e]]).view(np.int64) for k in (False, True)]
                sizes = [len(x) for x in starts]
                anchor, first, n = (np.repeat(np.array([x[c] for x in some[s:e]], np.int64), sizes) for c in ("anchor", "first", "n"))
                k = len(anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), *map(pa.array, hashes), pa.array([file] * k, pa.int64()), pa.array([row] * k, pa.int64()), pa.array(first.astype(np.int32)), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(n)],
                    names=["anchor", "window", "window2", "file", "row", "first", "start", "n"],
                )


def _hot_repeats(windows: DataFrame) -> DataFrame:
    """Rows of :func:`_windows` -> stretches (file, row, start, end) whose windows occur twice or more.

    All windows of a context hold its indexed place, so those that repeat make one stretch.
    """
    key = ["anchor", "window", "window2"]
    often = windows.groupBy(*key).agg(F.sum("n").alias("times")).where("times > 1").select(*key)
    return windows.join(often, key, "left_semi").groupBy("file", "row", "first").agg(
        F.min("start").alias("start"), (F.max("start") + LENGTH).alias("end")
    ).select("file", "row", "start", "end")


def _classes(keys: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of each window's class: windows are alike when their bytes are. ``keys`` are their hashes, ``at`` their
    places in ``data``; every window is compared with the first of its hash, byte by byte."""
    _, first, where = np.unique(keys, return_index=True, return_inverse=True)
    same, one = np.ones(len(at), bool), at[first][where]
    for k in range(LENGTH):
        same &= data[at + k] == data[one + k]
    for i in np.flatnonzero(~same):  # hashes that collide
        where[i] = -1
    if not same.all():
        classes: dict[bytes, int] = {}
        odd = set(keys[~same].tolist())
        for i in np.flatnonzero([k in odd for k in keys.tolist()]):
            raw = data[at[i] : at[i] + LENGTH].tobytes()
            where[i] = classes.setdefault(raw, len(first) + len(classes))
    return where


def _repeats(batches):
    """Contexts sorted by anchor -> stretches [start, end) whose windows occur twice or more."""
    left: list = []

    def settle(rows):
        raws = [np.frombuffer(r[5], np.uint8) for r in rows]
        sizes = np.array([len(r) - LENGTH + 1 for r in raws])
        base = np.cumsum([0, *(len(r) for r in raws[:-1])])
        keys = np.concatenate([Rolling(x).each(LENGTH) ^ _mix(np.array([r[0]], np.int64).view(np.uint64)) for r, x in zip(rows, raws, strict=True)])
        owner = np.repeat(np.arange(len(rows)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        where = _classes(keys, np.concatenate(raws), base[owner] + place)
        hit = np.bincount(where, weights=np.array([r[4] for r in rows])[owner])[where] > 1
        s, o = (place + np.array([r[3] for r in rows])[owner])[hit], owner[hit]
        if not len(s):
            return
        order = np.lexsort((s, o))
        s, o = s[order], o[order]
        new = np.r_[True, (o[1:] != o[:-1]) | (s[1:] > s[:-1] + LENGTH)]
        ends = np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]
        who = o[new]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([rows[r][k] for r in who], pa.int64()) for k in (1, 2)), pa.array(s[new].astype(np.int32)), pa.array((s[ends] + LENGTH).astype(np.int32))],
            names=["file", "row", "start", "end"],
        )

    for b in batches:
        left += list(zip(*(b.column(k).to_pylist() for k in range(6)), strict=True))
        if left:
            last = left[-1][0]
            cut = len(left)
            while cut and left[cut - 1][0] == last:
                cut -= 1
            if cut:
                yield from settle(left[:cut])
                left = left[cut:]
    if left:
        yield from settle(left)


def _apply(batches):
    for b in batches:
        rows = []
        ids, texts, spans = (b.column(k).to_pylist() for k in range(3))
        for text, some in zip(texts, spans, strict=True):
            raw = (text or "").encode()
            runs: list[list[int]] = []
            for x in sorted(some or [], key=lambda x: (x["start"], x["end"])):
                if runs and x["start"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], x["end"])
                else:
                    runs.append([x["start"], x["end"]])
            kept, at = [], 0
            for s, e in runs:
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            rows.append((len(raw), sum(e - s for s, e in runs), len(runs), b"".join(kept)))
        n, gone, spans, kept = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, b.schema.field(0).type), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def spans(rows: DataFrame, repeated: DataFrame, scratch: str, hot: int = HOT) -> DataFrame:
    """``rows`` (file, row, text) -> (file, row, start, end): stretches of bytes in windows that occur twice or more.

    Stretches of a document may touch or overlap. ``repeated`` (anchor) are the suffixes that the family found twice or
    more; others cannot stand in such a window. A suffix whose whole context occurs twice or more is a hit at once; for
    the rest, the windows are counted, one context of each kind and suffix standing for its copies; those of suffixes
    with more than ``hot`` kinds by Spark, a row each. Tables on the way lie in the folder ``scratch``; the result does not.
    """
    n = shuffle_partitions(rows.sparkSession)
    often = table(repeated, "often", scratch)  # a table of its own, so that the join can split a hot suffix
    hits = table(_scan(rows, True).join(often, "anchor", "left_semi"), "hits", scratch)
    key = ["anchor", "context", "context2"]
    kinds = table(hits.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("file", "row", "first", "last")).alias("one")), "kinds", scratch)
    # A table of its own, so that the join deals both sides anew and can split a suffix of very many kinds.
    groups = table(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1"), "groups", scratch)
    sure = hits.join(kinds.where("n > 1").select(*key), key, "left_semi").select("file", "row", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))

    def held(some_groups: DataFrame, run, made: str) -> DataFrame:
        unsure = kinds.join(some_groups, "anchor").select("one.file", "one.row", F.struct("anchor", "one.first", "one.last", "n").alias("s"))
        wanted = unsure.groupBy("file", "row").agg(F.collect_list("s").alias("some"))
        return rows.join(wanted, ["file", "row"]).select("file", "row", "text", "some").mapInArrow(run, made)

    is_hot = F.col("kinds") > hot
    contexts = held(groups.where(~is_hot), _contexts, "anchor long, file long, row long, first int, n long, raw binary")
    counted = contexts.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_repeats, "file long, row long, start int, end int")
    counted = table(counted, "counted", scratch)
    if not groups.where(is_hot).isEmpty():
        windows = table(held(groups.where(is_hot), _windows, "anchor long, window long, window2 long, file long, row long, first int, start int, n long"), "windows", scratch)
        counted = counted.union(table(_hot_repeats(windows), "hot", scratch))
    return table(sure.union(counted).groupBy("file", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, hot: int = HOT, folder: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; ``kept`` holds the bytes that stay.

    Texts, of any length, are UTF-8 bytes, null ones empty; matches never cross documents. Every byte in a 200-byte
    string that also starts anywhere else goes. Rows are told apart by where they lie, so repeated rows (each other's
    copies) and rows with null ids are documents like others. Other columns are not read.

    With ``folder``, in the shared file system, the index lasts: a later call over the same files and new ones adds the
    new rows as a batch of their own, which is scanned against what the index holds of the old. Otherwise the rows are
    taken in ``batches``, and the index goes when its matches are known.
    """
    spark = docs.sparkSession
    rows = located(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    scratch = shared_folder(spark, "suffixes")
    family = IndexFamily(spark, folder or f"{scratch}/family")
    new = family.new(rows)
    if folder:
        if not family.taken or not new.isEmpty():
            family.add(new)
    else:
        for k in range(batches):
            family.add(new.where(F.pmod(F.xxhash64("file", "row"), F.lit(batches)) == k))
    repeated = table(family.repeated(), "repeated", scratch)
    if not folder:
        remove(spark, family.folder)
    found = spans(rows, repeated, scratch, hot)
    remove(spark, scratch)
    kind = dict(docs.dtypes)[id_col]
    return rows.join(found, ["file", "row"], "left").select("id", "text", "spans").mapInArrow(
        _apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).drop("kept")
