"""Token ids in seekable zstandard files: one frame a document, a seek table with checksums at the end."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkTable, grouped, kept
from .common import cut, read, shared_folder, shuffle_partitions

END_ID = 2
# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEKABLE, HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Skippable frame that holds the document ids: null flag and id for each frame.
IDS_FRAME = 0x184D2A50
#: Letters of one byte or Latin-1, then marks that are one pre-token whatever follows; the apostrophe is left out.
SIMPLE = r"^(?P<w>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<m>[!-&(-/:-@\[-`{-~]*)$"
#: Words that a loaded model is probed with.
PROBES = ["a", "The", "Straße", "ÄÖÜ", "don't", "x1y", "word", "Étude", "end.", "UPPER", "(b)", "zz"]
#: Characters of texts whose chunks are looked up together.
GROUP = 6_000_000


class WordCodec:
    """Ids of a whole text from the ids of its chunks between white space, each encoded once.

    Models that drop white space and cut there have no ids across chunks; texts of others are encoded whole. If the model
    also lower-cases and ends words with a piece of their own, a chunk of plain letters and marks is cut once more, into
    what the model cuts as well. Each property is probed with the loaded model, not taken for granted. Chunks are looked
    up once a batch; the parts of them are kept for the next batches.
    """

    def __init__(self, path: str, size: int = 400_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.parts = ChunkTable(self._part, size)
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        ids = lambda text: self.lib.encode(text, add_special_tokens=False).ids
        one = [ids(w) for w in PROBES]
        self.by_chunk = all(ids(gap.join(PROBES)) == sum(one, []) for gap in (" ", "\n", "\t", "  ", "\r\n", "\x0b", "\x0c")) and all(
            ids(f"{gap}{w}{gap}") == x for w, x in zip(PROBES, one, strict=True) for gap in " \n\t\r\x0b\x0c"
        )
        self.by_part = self.by_chunk and all(
            ids(w + m) == ids(w.lower()) + ids(m) for w in PROBES if w.isalpha() for m in ("", ".", "?!", '"),', "...", ")", "-", "_", "#$%")
        )

    def _part(self, part: str) -> bytes:
        return np.array(self.lib.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode new words together, a space between two: their ids part after each end-of-word piece."""
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.lib.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                continue  # then each is encoded alone when asked for
            raw, last = ids.tobytes(), 0
            for w, c in zip(some, cuts.tolist(), strict=True):
                self.parts.put(w, raw[4 * last : 4 * c])
                last = c

    def _cut(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct chunks -> distinct parts, and the places of each chunk's one or two among them; an empty part last."""
        found = pc.extract_regex(chunks, SIMPLE) if self.by_part else pa.nulls(len(chunks), pa.struct([("w", pa.string()), ("m", pa.string())]))
        plain = found.is_valid()
        word = pc.if_else(plain, pc.utf8_lower(pc.struct_field(found, "w")), chunks)
        both = pa.concat_arrays([word, pc.fill_null(pc.struct_field(found, "m"), ""), pa.array([""])]).dictionary_encode()
        code = both.indices.to_numpy()
        return both.dictionary, code[: len(chunks)], code[len(chunks) : -1]

    def encode(self, texts: pa.Array) -> Iterator[memoryview]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            yield from (memoryview(self._part(t.as_py())) for t in texts)
            return
        for s, e in grouped(pc.binary_length(texts).to_pylist(), GROUP):
            split = pc.ascii_split_whitespace(texts.slice(s, e - s))
            ends = split.offsets.to_numpy() - split.offsets[0].as_py()
            words = split.flatten().dictionary_encode()
            parts, first, second = self._cut(words.dictionary)
            parts = parts.to_pylist()
            if self.by_part:
                self._learn(self.parts.unknown(w for w in parts if w.isalpha() and max(w) <= "ÿ"))
            raw = [self.parts[w] if w else b"" for w in parts]
            size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            ids, start = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(size) - size
            code = words.indices.to_numpy()
            each = np.empty(2 * len(code), np.int64)
            each[0::2], each[1::2] = first[code], second[code]
            n = size[each]
            upto = np.r_[0, np.cumsum(n)]
            made = memoryview(ids[np.repeat(start[each] - upto[:-1], n) + np.arange(upto[-1])].tobytes())
            cuts = (4 * upto[2 * ends]).tolist()
            yield from (made[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def codec(path: str) -> WordCodec:
    return kept(("words", path), lambda: WordCodec(path))


class FrameWriter:
    """Writes one independent frame for each document, then the ids and the seek table."""

    def __init__(self, out, level: int = 3):
        from zstandard import ZstdCompressor

        self.out, self.zstd, self.ids, self.entries = out, ZstdCompressor(level=level, write_checksum=False), [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        from xxhash import xxh64_intdigest

        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.ids.append(struct.pack("<?q", doc_id is None, doc_id or 0))
        self.entries.append(struct.pack("<III", len(frame), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))

    def finish(self) -> None:
        ids = b"".join(self.ids)
        self.out.write(struct.pack("<II", IDS_FRAME, len(ids)) + ids)
        table = b"".join(self.entries)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEKABLE))


class FrameReader:
    """Opens such a file at its seek table; ``document(i)`` reads and decompresses frame i alone."""

    def __init__(self, source):
        from zstandard import ZstdDecompressor

        self.source, self.zstd = source, ZstdDecompressor()
        end = source.seek(0, 2)
        count, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        size = 12 * count + 17
        raw = self._at(end - size, size)
        if struct.unpack_from("<II", raw) != (SKIPPABLE, size - 8):
            raise ValueError("damaged seek table")
        self.entries = np.frombuffer(raw, "<u4", 3 * count, 8).reshape(-1, 3).astype(np.int64)
        self.offsets = np.r_[0, np.cumsum(self.entries[:, 0])]
        at = int(self.offsets[-1])
        head = struct.unpack("<II", self._at(at, 8))
        if head != (IDS_FRAME, 9 * count):
            raise ValueError("damaged id frame")
        self.ids = [None if null else i for null, i in struct.iter_unpack("<?q", self._at(at + 8, 9 * count))]

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.entries)

    def document(self, i: int) -> bytes:
        from xxhash import xxh64_intdigest

        n, size, check = self.entries[i].tolist()
        raw = self.zstd.decompress(self._at(int(self.offsets[i]), n), max_output_size=size) if size else b""
        if len(raw) != size or xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return raw


def _filesystem(uri: str):
    """The file system behind a shared folder's address, for tasks: local mounts, HDFS and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode every whole text and write ``folder``/*.zst in ascending id order (null ids first, equal ids by text).

    Returns the manifest (part, path, n_docs, n_ids): one row for each file, parts ascending. A task writes under a
    name of its own attempt, and only the attempt whose row Spark keeps is in the manifest, so lost or repeated tasks
    leave no trace in what readers see. Null texts are empty and hold the end id alone. Other columns are not read.
    """
    spark = docs.sparkSession

    def run(batches):
        import uuid

        from pyspark import TaskContext

        c, part = codec(tokenizer), TaskContext.get().partitionId()
        fs, top = _filesystem(folder)
        fs.create_dir(top, recursive=True)
        name = f"tokens-{part:06d}-{uuid.uuid4().hex[:8]}.zst"
        end, n_docs, n_ids = struct.pack("<I", end_id), 0, 0
        with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
            writer = FrameWriter(out)
            for b in batches:
                for doc_id, raw in zip(b.column(0).to_pylist(), c.encode(b.column(1)), strict=True):
                    writer.add(doc_id, b"".join((raw, end)))
                    n_docs, n_ids = n_docs + 1, n_ids + len(raw) // 4 + 1
            writer.finish()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": pa.array([n_docs]), "n_ids": pa.array([n_ids])})
        else:
            fs.delete_file(f"{top}/{name}")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The start of the text, which sorts as the text does, parts rows of one id or none.
    parts = rows.repartitionByRange(
        shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64)
    ).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return cut(parts.mapInArrow(run, "part int, path string, n_docs long, n_ids long"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Manifest of :func:`write_tokens` -> (doc_id, start, n_tokens, ids_crc32) from the files, checksums verified."""
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("start"))

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, inside = _filesystem(path)
                with fs.open_input_file(inside) as source:
                    file, rows = FrameReader(source), []
                    for i in range(len(file)):
                        raw = file.document(i)
                        rows.append((start, len(raw) // 4, zlib.crc32(raw)))
                        start += len(raw) // 4
                    made = np.array(rows, np.int64).reshape(-1, 3)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.ids, pa.int64()), *(pa.array(made[:, k]) for k in range(3))], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    return files.repartition(shuffle_partitions(manifest.sparkSession)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(read(spark, sf_dir, "documents"), tokenizer_path(), shared_folder(spark, "tokens")))
