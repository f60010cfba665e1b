"""Near-duplicate classes: SimHash fingerprints by deletion-variant signatures; sets of shingles by prefix filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, TIDY, cut, located, read, remove, settings, shared_folder, shuffle_partitions, table
from .components import components

BITS, DISTANCE = 64, 3
#: A bucket of more fingerprints than this is cut finer before anything is compared.
BUCKET = 4096
A_TO_Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 for a text without words (null too)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(A_TO_Z).split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [words]
    else:
        shingles = zip(*(words[i:] for i in range(size)), strict=False)
    hashes = np.fromiter((xxh64_intdigest(b" ".join(s), seed) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * ones > len(hashes)).astype(object)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, th, fp long) of every whole text; ``fp`` holds the 64 bits as a signed long, ``th`` is the text's hash."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], names=["doc_id", "th", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th")).mapInArrow(
        run, f"doc_id {kind}, th long, fp long"
    )


def _variants(segment: str, width: int, base: int) -> str:
    """SQL: the segment's one-wildcard variants, each tagged with the place of its wildcard."""
    return f"transform(sequence(0, {width - 1}), i -> ({segment} & ~shiftleft(1L, i)) | shiftleft(cast({base} + i as bigint), 32))"


LOW, HIGH = "(fp & 4294967295L)", "shiftrightunsigned(fp, 32)"
#: Two halves of 32 bits: three differing bits leave one half with at most one. The variant's number says which half.
FIRST = f"concat({_variants(LOW, 32, 0)}, {_variants(HIGH, 32, 32)})"


def _finer(rest: str, width: int) -> str:
    """SQL: variants of the two halves of ``width`` low bits of ``rest``, the part that a bucket leaves open."""
    h = width // 2
    return f"concat({_variants(f'({rest} & {2**h - 1}L)', h, 0)}, {_variants(f'(shiftrightunsigned({rest}, {h}) & {2**h - 1}L)', h, 32)})"


def _linked(a: np.ndarray, distance: int):
    """Forest edges that join what is connected by links of at most ``distance`` bits.

    Searches outward from a start; only fingerprints not reached yet are compared, so a dense bucket costs little.
    """
    left = a
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                yield from ((x, y) for y in found)
                todo += list(found)


def _compare(distance: int):
    def run(batches):
        carry_k, carry_v = np.empty(0, np.int64), np.empty(0, np.uint64)

        def edges(k, v):
            cuts = np.flatnonzero(np.diff(k)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(k)]
            sizes = ends - starts
            two = starts[sizes == 2]
            close = two[np.bitwise_count(v[two] ^ v[two + 1]) <= distance]
            a, b = [v[close]], [v[close + 1]]
            for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
                if got := list(_linked(v[s:e], distance)):
                    got = np.array(got, np.uint64)
                    a.append(got[:, 0])
                    b.append(got[:, 1])
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            k = np.r_[carry_k, batch.column(0).to_numpy(zero_copy_only=False)]
            v = np.r_[carry_v, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(k):
                continue
            last = np.searchsorted(k, k[-1]) if k[0] <= k[-1] else 0
            last = len(k) - int(np.argmax(k[::-1] != k[-1])) if (k != k[-1]).any() else 0
            carry_k, carry_v = k[last:], v[last:]
            if last:
                yield edges(k[:last], v[:last])
        if len(carry_k):
            yield edges(carry_k, carry_v)

    return run


def _counted(rows: DataFrame) -> DataFrame:
    """Rows whose ``key`` occurs twice or more, with ``n``, how often."""
    often = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return cut(rows.join(often.hint("merge"), "key"))


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp long) -> forest edges (a, b) that connect all those at ``distance`` <= 3 bits.

    Every fingerprint is indexed under 64 keys: each half with one bit left out. Two at three or fewer bits share a
    key. Keys seen once go; buckets over ``bucket`` are cut by the variants of what their key leaves open, twice at
    most, after which a bucket cannot hold more than 2^11 fingerprints. No pair is lost at any step.
    """
    if distance > DISTANCE:
        raise ValueError("two halves find up to three differing bits")
    n = shuffle_partitions(fps.sparkSession)
    # A row becomes 64: they are made in as many tasks as will take them. (By fp itself, the planner would leave it out.)
    rows = fps.select("fp").repartition(n, F.xxhash64("fp")).select("fp", F.explode(F.expr(FIRST)).alias("key"))
    rows = _counted(rows.withColumn("rest", F.expr(f"if(shiftrightunsigned(key, 37) = 0, {HIGH}, {LOW})")))
    out = None
    for width in (32, 16, 0):
        ready = rows if not width else rows.where(F.col("n") <= bucket)
        edges = ready.select("key", "fp").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(distance), "a long, b long")
        out = edges if out is None else out.union(edges)
        hot = rows.where(F.col("n") > bucket)
        if not width or hot.isEmpty():
            break
        fine = hot.select("fp", "key", "rest", F.explode(F.expr(_finer("rest", width))).alias("sub"))
        half = width // 2
        rows = _counted(fine.select(
            "fp", F.xxhash64("key", "sub").alias("key"),
            F.expr(f"if(shiftrightunsigned(sub, 37) = 0, shiftrightunsigned(rest, {half}) & {2**half - 1}L, rest & {2**half - 1}L)").alias("rest"),
        ))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, size: int = 3) -> DataFrame:
    """(doc_id, th, fp, root, component_id) for every row; component_id is the least id reachable over links, root a
    fingerprint that names the component.

    Texts without words, null ones too, have fingerprint 0 and link like any other. Repeated rows get a row each; null
    ids stay and only matter to component_id if a whole component has none. Other columns are not read.
    """
    own = cut(fingerprints(docs, id_col, text_col, size))
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(cut(links(fps.select("fp"), distance)))
    roots = fps.join(joined.hint("merge"), fps.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    found = roots.join(least.hint("merge"), "root").select("fp", "root", "component_id")
    return own.join(found.hint("merge"), "fp").select("doc_id", "th", "fp", "root", "component_id")


#: Near copies: Jaccard similarity of the sets of five-word shingles.
WORDS, SIMILAR = 5, 0.8
#: Shingles met more often than this, as batches count them, come last in the order of shingles; at most ``COMMON`` do.
OFTEN, COMMON = 32, 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int = WORDS) -> list[np.ndarray]:
    """Of each text the distinct 64-bit hashes of its word shingles, A-Z in lower case, in order; of no words, none. A
    text under ``size`` words has one shingle, all its words."""
    from xxhash import xxh64_intdigest

    said = [(t or "").encode().translate(A_TO_Z).split() for t in texts]
    coded = pa.array([w for words in said for w in words], pa.binary()).dictionary_encode()
    own = np.fromiter((xxh64_intdigest(w, 42) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = own[coded.indices.to_numpy()]
    runs = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for k in range(size):
        runs = runs * _ODD + h[k : k + len(runs)]
    runs, out, at = _mix(runs + np.uint64(size)), [], 0
    for words in said:
        n = len(words)
        if n >= size:
            out.append(np.unique(runs[at : at + n - size + 1].view(np.int64)))
        else:
            one = np.zeros(min(n, 1), np.uint64)
            for k in range(n):
                one = one * _ODD + h[at + k]
            out.append(_mix(one + np.uint64(n)).view(np.int64))
        at += n
    return out


#: Least bits of a set's parity; two sets differ in at least as many shingles as their parities differ in bits.
PARITY = 1024


def parity(own: np.ndarray) -> np.ndarray:
    """Bit k is set if an odd number of the set's hashes is k modulo the bits: two a shingle, rounded up to a power of two."""
    bits = max(PARITY, 1 << (2 * len(own) - 1).bit_length()) if len(own) else PARITY
    odd = np.bincount(own & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded(sign: np.ndarray, words: int) -> np.ndarray:
    """The parity of the same set in ``words`` longs, as many or fewer; unsigned, as bits are counted of absolute values."""
    return np.bitwise_xor.reduce(sign.view(np.uint64).reshape(-1, words), axis=0)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two parities differ, in the length of the shorter."""
    n = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def _sets(batches):
    """Rows (..., text) -> (..., hi, lo, own): the set of shingles, and a 128-bit hash that names it."""
    from xxhash import xxh3_128_digest

    for b in batches:
        own = shingle_sets(b.column(b.num_columns - 1).to_pylist())
        made = np.frombuffer(b"".join(xxh3_128_digest(x.tobytes()) for x in own), "<i8").reshape(-1, 2)
        columns = [*b.columns[:-1], pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy()), _lists(own)]
        yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "hi", "lo", "own"])


MEASURED = ["id", "file", "row", "hi", "lo", "m", "sign", "key", "n"]


def _measured(batches):
    """Rows (id, file, row, text) -> (id, file, row, hi, lo, m, sign), sizes and parities of their sets, without the sets; and
    (key, n), shingles that stand in two sets of a batch or more, and in how many."""
    for b in _sets(batches):
        own = b.column(5)
        v, sizes = own.flatten().to_numpy(), own.value_lengths().to_numpy().astype(np.int64)
        sign = _lists([parity(x) for x in np.split(v, np.cumsum(sizes)[:-1])] if len(b) else [])
        none = pa.nulls(len(b), pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sizes), sign, none, none], names=MEASURED)
        h, n = np.unique(v, return_counts=True)
        h, n = h[n > 1], n[n > 1]
        nulls = [pa.nulls(len(h), c.type) for c in (*b.columns[:5], none, sign)]
        yield pa.RecordBatch.from_arrays([*nulls, pa.array(h), pa.array(n)], names=MEASURED)


def _prefixes(common, similar: float):
    """Texts -> the first shingles of their sets (key, hi, lo, m, pos) in the order of all shingles: two sets that are
    alike have one of those in common."""

    def run(batches):
        late = common.value
        for b in _sets(batches):
            names = np.stack([b.column(k).to_numpy() for k in (0, 1)], axis=1)
            some = b.take(pa.array(np.sort(np.unique(names, axis=0, return_index=True)[1])))  # of equal sets one
            v, sizes = some.column(2).flatten().to_numpy(), some.column(2).value_lengths().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            last = late[np.minimum(np.searchsorted(late, v), len(late) - 1)] == v if len(late) else np.zeros(len(v), bool)
            order = np.argsort(doc * 2 + last, kind="stable")
            pos = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = pos < np.repeat(sizes - np.ceil(similar * sizes - 1e-9).astype(np.int64) + 1, sizes)
            take, pos = order[first], pos[first]
            hi, lo = (some.column(k).to_numpy()[doc[take]] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v[take], hi, lo, sizes[doc[take]], pos)], names=["key", "hi", "lo", "m", "pos"])

    return run


def _buckets(batches):
    """Rows sorted by their first column -> arrays of whole buckets."""
    left = None
    for b in batches:
        rows = np.stack([c.to_numpy() for c in b.columns], axis=1)
        rows = rows if left is None else np.concatenate([left, rows])
        if not len(rows):
            continue
        other = np.flatnonzero(rows[:, 0] != rows[-1, 0])
        last = other[-1] + 1 if len(other) else 0
        left = rows[last:]
        if last:
            yield rows[:last]
    if left is not None and len(left):
        yield left


MET = ["key", "hi", "lo", "m", "pos", "ahi", "alo", "am", "apos", "n"]


def _met(batches):
    """Rows (key, hi, lo, m, pos) sorted by key, equal ones together -> those of keys that two sets have, each with the
    bucket's first and how many there are."""
    for rows in _buckets(batches):
        rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]]
        starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        sizes = np.diff(np.r_[starts, len(rows)])
        held = np.repeat(sizes > 1, sizes)
        made = np.hstack([rows, rows[np.repeat(starts, sizes), 1:], np.repeat(sizes, sizes)[:, None]])[held]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(made[:, k])) for k in range(10)], names=MET)


def _across(similar: float):
    """Rows (key, class, hi, lo, m, pos) sorted by key and class -> pairs of different classes that may be alike."""
    share = similar / (1 + similar)

    def run(batches):
        names = ["ahi", "alo", "bhi", "blo"]
        for rows in _buckets(batches):
            starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            ends = np.r_[starts[1:], len(rows)]
            mixed = rows[starts, 1] != rows[ends - 1, 1]
            out, n = [], 0
            for s, e in zip(starts[mixed], ends[mixed], strict=True):
                own = rows[s:e]
                m, rest = own[:, 4], own[:, 4] - own[:, 5]
                upto = np.searchsorted(own[:, 1], own[:, 1], side="right")
                for i in range(len(own)):
                    j = upto[i]
                    if j == len(own):
                        break
                    ok = np.flatnonzero(np.minimum(rest[j:], rest[i]) >= np.ceil(share * (m[j:] + m[i]) - 1e-9)) + j
                    if len(ok):
                        out.append(np.hstack([np.broadcast_to(own[i, 2:4], (len(ok), 2)), own[ok, 2:4]]))
                        n += len(ok)
                    if n > 200_000:
                        got, out, n = np.concatenate(out), [], 0
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, k])) for k in range(4)], names=names)
            got = np.concatenate(out) if out else np.empty((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, k])) for k in range(4)], names=names)

    return run


def _open(batches):
    """Like :func:`_buckets` of rows (key, class, hi, lo, m, pos, sign), with the signs beside them."""
    left, signs = None, []
    for b in batches:
        if not len(b):
            continue
        rows = np.stack([c.to_numpy() for c in b.columns[:6]], axis=1)
        signs += np.split(b.column(6).flatten().to_numpy(), np.cumsum(b.column(6).value_lengths().to_numpy())[:-1])
        rows = rows if left is None else np.concatenate([left, rows])
        ends = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
        for s, e in zip(np.r_[0, ends[:-1]], ends, strict=False):
            yield rows[s:e], signs[s:e]
        last = ends[-1] if len(ends) else 0
        left, signs = rows[last:], signs[last:]
    if left is not None:
        yield left, signs


#: Pairs of a bucket for each of its rows, above which the nearest are tried first.
PAIRS_EACH = 8


def _close(similar: float, each: float):
    """Rows (key, class, hi, lo, m, pos, sign) sorted by key and class -> pairs of different classes that may be alike by
    their parities too. A bucket of more than ``each`` of them a row gives only each row's nearest, with ``cut`` 1."""
    share, differ = similar / (1 + similar), (1 - similar) / (1 + similar)

    def made(pairs: list[np.ndarray], cut_: int) -> pa.RecordBatch:
        got = np.concatenate([*pairs, np.empty((0, 4), np.int64)])
        columns = [pa.array(np.ascontiguousarray(got[:, k])) for k in range(4)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(got), cut_))], names=["ahi", "alo", "bhi", "blo", "cut"])

    def run(batches):
        for own, signs in _open(batches):
            m, rest, words = own[:, 4], own[:, 4] - own[:, 5], np.array([len(x) for x in signs])
            upto = np.searchsorted(own[:, 1], own[:, 1], side="right")
            tables = {}  # parities in so many words, of the rows that have them
            for w in np.unique(words):
                held = np.flatnonzero(words >= w)
                at = np.full(len(own), -1)
                at[held] = np.arange(len(held))
                tables[w] = at, np.stack([folded(signs[k], w) for k in held])
            best, of = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), -1)
            out, n, total = [], 0, 0
            for i in np.flatnonzero(upto < len(own)):
                j = upto[i] + np.flatnonzero(np.minimum(rest[upto[i] :], rest[i]) >= np.ceil(share * (m[upto[i] :] + m[i]) - 1e-9))
                d, common = np.zeros(len(j), np.int64), np.minimum(words[j], words[i])
                for w in np.unique(common):
                    at, parities = tables[w]
                    d[common == w] = np.bitwise_count(parities[at[j[common == w]]] ^ parities[at[i]]).sum(axis=1, dtype=np.int64)
                ok = d <= differ * (m[j] + m[i]) + 1e-9
                j, d = j[ok], d[ok]
                if not len(j):
                    continue
                total += len(j)
                k = np.argmin(d)
                if d[k] < best[i]:
                    best[i], of[i] = d[k], j[k]
                nearer = d < best[j]
                best[j[nearer]], of[j[nearer]] = d[nearer], i
                if total <= each * len(own):
                    out.append(np.hstack([np.broadcast_to(own[i, 2:4], (len(j), 2)), own[j, 2:4]]))
                    n += len(j)
                if each == np.inf and n > 200_000:
                    yield made(out, 0)
                    out, n = [], 0
            if total <= each * len(own):
                yield made(out, 0)
            else:
                yield made([np.hstack([own[of >= 0, 2:4], own[of[of >= 0], 2:4]])], 1)

    return run


def _near_enough(similar: float):
    """Rows (..., m_a, m_b, sign_a, sign_b) -> (...) of those whose parities leave it open that they are alike."""

    def run(batches):
        for b in batches:
            most = (1 - similar) / (1 + similar) * (b.column("m_a").to_numpy() + b.column("m_b").to_numpy()) + 1e-9
            signs = [[x.values.to_numpy() for x in b.column(k)] for k in ("sign_a", "sign_b")]
            open_ = [apart(x, y) <= z for x, y, z in zip(*signs, most, strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:-4], names=b.schema.names[:-4]).filter(pa.array(open_, pa.bool_()))

    return run


def _alike(similar: float):
    """Rows (a, b, text_a, text_b) -> (a, b) of those whose sets are alike."""

    def run(batches):
        for b in batches:
            both = [shingle_sets(b.column(k).to_pylist()) for k in ("text_a", "text_b")]
            keep = []
            for x, y in zip(*both, strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similar * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Bits of a filter for each row it is made of, and at most.
BITS_EACH, BITS_MOST = 32, 1 << 27


def _filtered(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` (file, row, ...) of ``wanted`` (file, row), and few others: a filter of bits goes to all tasks, so that
    the others need not be shuffled."""
    bits = min(max(1 << 16, 1 << (wanted.count() * BITS_EACH).bit_length()), BITS_MOST)
    place = F.pmod(F.xxhash64("file", "row"), F.lit(bits))
    words = wanted.select(F.shiftrightunsigned(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(file, row), {bits}) & 63 as int))").alias("bit"))
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    mask = np.zeros(bits >> 6, np.int64)
    mask[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(mask)

    def run(batches):
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy()
            hit = sent.value[at >> 6] >> (at & 63) & 1
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(hit == 1))

    return rows.withColumn("place", place).mapInArrow(run, rows.schema)


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of (hi, lo), the lesser first, of rows (ahi, alo, bhi, blo)."""
    a, b = F.struct(F.col("ahi").alias("hi"), F.col("alo").alias("lo")), F.struct(F.col("bhi").alias("hi"), F.col("blo").alias("lo"))
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def _name(hi: str, lo: str):
    return F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (hi, lo)))


def near_copies(rows: DataFrame, similar: float = SIMILAR, bucket: int = OFTEN) -> DataFrame:
    """``rows`` (id, text, file, row) -> (id, file, row, root): rows with one root are joined by pairs of texts whose
    sets of five-word shingles have a Jaccard similarity of ``similar`` or more. No such link is lost, and none is false.

    Prefix filtering: in any one order of all shingles, alike sets share one of their first few. The order is that of
    the hashes, but shingles met more than ``bucket`` times come last, so that few sets meet under one. Each set is first
    compared with one set of each bucket, the one with the least part of its shingles before the bucket's, which joins
    large groups; then all pairs of a bucket of at most ``bucket`` sets that are not joined yet and whose sizes and places
    leave the similarity open. In larger buckets pairs first have to be near by their parities, each set's nearest before
    all others. Before their texts are fetched, pairs go whose parities differ in more bits than alike sets differ in
    shingles. Texts without words are copies of each other. Repeated rows and null ids are rows like others.
    """
    spark = rows.sparkSession
    n, kind = shuffle_partitions(spark), dict(rows.dtypes)["id"]
    scratch = shared_folder(spark, "near")
    # Sets are larger than their texts: none is written, and those to compare are made again.
    names = f"id {kind}, file long, row long, hi long, lo long, m long, sign array<long>"
    held = table(rows.select("id", "file", "row", "text").mapInArrow(_measured, f"{names}, key long, n long"), "measured", scratch)
    named = held.where("m is not null")
    with settings(spark, TIDY):
        often = held.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > bucket)
        late = np.sort(often.orderBy(F.desc("n"), "key").limit(COMMON).select("key").toArrow().column("key").to_numpy())
    first = rows.select("text").mapInArrow(_prefixes(spark.sparkContext.broadcast(late), similar), "key long, hi long, lo long, m long, pos long")
    dealt = first.repartition(n, "key").sortWithinPartitions("key", F.col("pos") / F.col("m"), F.xxhash64("key", "hi", "lo"), "hi", "lo")
    met = table(dealt.mapInArrow(_met, ", ".join(f"{c} long" for c in MET)), "met", scratch)

    one = table(named.groupBy("hi", "lo").agg(F.min(F.struct("file", "row", "m", "sign")).alias("one")), "one", scratch)

    def side(k: str) -> DataFrame:
        return one.select(F.struct("hi", "lo").alias(k), F.struct("one.file", "one.row").alias(f"at_{k}"), F.col("one.m").alias(f"m_{k}"), F.col("one.sign").alias(f"sign_{k}"))

    def edges(pairs: DataFrame) -> DataFrame:
        own_scratch = shared_folder(spark, "compared")
        both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
        both = both.select(_name("a.hi", "a.lo").alias("a"), _name("b.hi", "b.lo").alias("b"), "at_a", "at_b", "m_a", "m_b", "sign_a", "sign_b")
        kept = both.drop("m_a", "m_b", "sign_a", "sign_b").schema
        likely = table(both.mapInArrow(_near_enough(similar), kept), "likely", own_scratch)
        wanted = likely.select(F.inline(F.array("at_a", "at_b"))).distinct()
        texts = table(_filtered(rows.select("file", "row", "text"), wanted).join(wanted.hint("merge"), ["file", "row"]), "texts", own_scratch)
        left, right = (texts.select(F.struct("file", "row").alias(f"at_{k}"), F.col("text").alias(f"text_{k}")) for k in "ab")
        found = likely.join(left.hint("merge"), "at_a").join(right.hint("merge"), "at_b").select("a", "b", "text_a", "text_b")
        out = table(found.mapInArrow(_alike(similar), "a string, b string"), "edges", scratch)
        remove(spark, own_scratch)
        return out

    may = F.least(F.col("m") - F.col("pos"), F.col("am") - F.col("apos")) >= F.ceil(similar / (1 + similar) * (F.col("m") + F.col("am")) - 1e-9)
    tried = table(_pairs(met.where(may).select("ahi", "alo", F.col("hi").alias("bhi"), F.col("lo").alias("blo"))), "tried", scratch)
    joined = components(edges(tried))

    def placed(rows: DataFrame) -> DataFrame:
        class_ = joined.select("node", F.xxhash64("component").alias("of"))
        return rows.withColumn("node", _name("hi", "lo")).join(class_, "node", "left").select("key", F.coalesce("of", F.xxhash64("node")).alias("class"), "hi", "lo", "m", "pos")

    def compared(rows: DataFrame, compare, names: str = "ahi long, alo long, bhi long, blo long") -> DataFrame:
        return rows.repartition(n, "key").sortWithinPartitions("key", "class").mapInArrow(compare, names)

    def close(each: float) -> DataFrame:
        many = placed(met.where(F.col("n") > bucket))
        mixed = many.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("key")
        signs = one.select("hi", "lo", F.col("one.sign").alias("sign"))
        left = many.join(mixed.hint("merge"), "key").join(signs.hint("merge"), ["hi", "lo"]).select("key", "class", "hi", "lo", "m", "pos", "sign")
        return table(compared(left, _close(similar, each), "ahi long, alo long, bhi long, blo long, cut long"), "close", scratch)

    few, each = compared(placed(met.where(F.col("n") <= bucket)), _across(similar)), PAIRS_EACH
    while True:
        found = close(each)
        some = found.drop("cut") if few is None else few.union(found.drop("cut"))
        more = table(_pairs(some).join(tried, ["a", "b"], "left_anti"), "more", scratch)
        if not more.isEmpty():
            joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(edges(more)))
            tried = tried.union(more)
        if found.where("cut = 1").isEmpty():
            break
        few, each = None, np.inf
    named = cut(named.select("id", "file", "row", "hi", "lo"))
    remove(spark, scratch)
    named = named.select("id", "file", "row", _name("hi", "lo").alias("fp"))
    return named.join(joined, named.fp == joined.node, "left").select("id", "file", "row", F.coalesce("component", "fp").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, one of each group of :func:`near_copies`: that of the least id (null last)."""
    rows = located(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc")))
    found = near_copies(rows.select(F.col(f"doc.{id_col}").alias("id"), F.col(f"doc.{text_col}").alias("text"), "file", "row"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "file", "row"))
    chosen = found.groupBy("root").agg(first.alias("s"), F.count("*").alias("n")).where("n > 1").select("root", "s.file", "s.row")
    c = chosen.select("root", F.col("file").alias("cf"), F.col("row").alias("cr"))
    dropped = found.join(c, "root").where("file <> cf or row <> cr").select("file", "row")
    return rows.join(dropped, ["file", "row"], "left_anti").select("doc.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
