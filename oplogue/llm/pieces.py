"""SentencePiece encoding and decoding by distinct marked words.

No piece of such a model has a marker after another character, so no merge crosses into the next marked word. Each
distinct word of the corpus is segmented once, and its ids are joined back by position: the most frequent words, at most
``FREQUENT`` of at most ``SHORT`` bytes that stand twice or more, form a table that is broadcast, and a text becomes the numbers of its words in it;
the other words go with their places to the task that their word falls to, which segments each once and sends its ids to
those places.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import grouped, kept, latest, tidy
from .common import TIDY, located, read, settings, shuffle_partitions

MARK = "▁"
#: Words of the broadcast table, and bytes of each: 150 MB at the very most, some 20 MB in practice.
FREQUENT, SHORT = 1 << 20, 128
#: Tasks that a longer word may fall to, each of which segments it, so that copies of a hot one spread.
SPREAD = 64
#: Bytes of texts that are cut into words together.
GROUP = 4_000_000
_marked = re.compile(f"{MARK}+[^{MARK}]*")


class PieceCodec:
    """Encodes word by word what the library would encode whole.

    Right only if no piece has a marker after another character, so that no merge crosses into the next marked word,
    and if the model neither drops nor maps characters; both are tested when the model is loaded.
    """

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.lib = SentencePieceProcessor(model_file=model)
        if any(MARK in self.lib.id_to_piece(i).lstrip(MARK) for i in range(self.lib.get_piece_size())):
            raise ValueError("pieces of this model cross whitespace markers")
        for probe in ("a  b", " a", "a ", "ﬁ ①"):
            if self.lib.decode(self.lib.encode(probe)) != probe:
                raise ValueError("this model normalises its text")
        if self.lib.get_piece_size() > 1 << 16:
            raise ValueError("ids of this model take more than two bytes")
        self.mark = self.lib.piece_to_id(MARK)

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words, each given without its first marker. '' is a lone marker."""
        made = iter(self.lib.encode([w for w in words if w], num_threads=1))
        return [next(made) if w else [self.mark] for w in words]


def split(text: str | None) -> list[str]:
    """Marked words in order, each without its first marker. Null is empty."""
    if not text:
        return []
    return [w[1:].replace(MARK, " ") for w in _marked.findall(MARK + text.replace(" ", MARK))]


def split_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What :func:`split` makes of each text, end to end, and how many words each text has.

    Spaces are markers, one more stands before each text, and a word begins at a marker that follows none.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not pc.any(pc.greater(pc.binary_length(texts), 0)).as_py():
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    _, at, raw = texts.buffers()
    at = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw, at = np.frombuffer(raw, np.uint8)[at[0] : at[-1]], at - at[0]
    full = at[1:] > at[:-1]
    space = raw == ord(" ")
    follows = np.empty_like(space)
    follows[1:] = space[:-1]
    follows[at[:-1][full]] = True
    space &= ~follows
    cuts = np.flatnonzero(space).astype(np.int32)
    before = np.searchsorted(cuts, at).astype(np.int32)
    starts = np.sort(np.concatenate([(at - before)[:-1][full], cuts - np.arange(len(cuts), dtype=np.int32)]), kind="stable")
    starts = np.append(starts, np.int32(len(raw) - len(cuts)))
    words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(raw[~space]))
    return words, np.diff(before) + full


def splits(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """:func:`split_all` of texts of about ``GROUP`` bytes at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    return (split_all(texts[s:e]) for s, e in grouped(sizes, GROUP))


class Frequent:
    """The broadcast table, as Arrow arrays: words, and their ids end to end."""

    def __init__(self, raw: bytes):
        got = pa.ipc.open_stream(raw).read_all()
        self.words = pa.concat_arrays([pa.array([], pa.string()), *got.column("word").cast(pa.string()).chunks])
        size = got.column("size").to_numpy()
        ids = pa.concat_arrays([pa.array([], pa.binary()), *got.column("ids").cast(pa.binary()).chunks])
        self.ids = np.frombuffer(ids.buffers()[2] or b"", "<u2")[: size.sum()].astype(np.int32)
        self.size = np.r_[size, 0].astype(np.int32)
        self.at = np.r_[0, np.cumsum(size)].astype(np.int32)

    def numbered(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, pa.Array]:
        """For each text the numbers of its words; and the distinct words of each text that have none here: text, place
        among the text's own in order of appearance, word. Those are numbered on from the last.

        Words are looked up once for all texts, for which the table is hashed once.
        """
        coded, seen, many = [], [pa.array([], pa.string())], [np.empty(0, np.int64)]
        total = 0
        for words, n in splits(texts):
            d = words.dictionary_encode()
            coded.append(d.indices.to_numpy() + np.int32(total))
            seen.append(d.dictionary)
            many.append(n)
            total += len(d.dictionary)
            del words, d
        seen, many = pa.concat_arrays(seen), np.concatenate(many)
        known = pc.fill_null(pc.index_in(seen, value_set=self.words), -1).to_numpy()
        code = np.concatenate([np.empty(0, np.int32), *coded])
        del coded
        number = known[code]
        ends = np.cumsum(many)
        late = np.flatnonzero(number < 0)
        text = np.searchsorted(ends, late, side="right")
        _, first, which = np.unique(text << 32 | code[late], return_index=True, return_inverse=True)
        order = np.argsort(first)  # distinct ones by text, then by appearance
        text = text[first[order]]
        k = np.arange(len(text)) - np.searchsorted(text, text)
        place = np.empty(len(k), np.int32)
        place[order] = k
        number[late] = len(self.words) + place[which]
        return [number[e - n : e] for e, n in zip(ends.tolist(), many.tolist(), strict=True)], text, k.astype(np.int32), seen.take(pa.array(code[late[first[order]]]))


def frequent(broadcast, tag: str) -> Frequent:
    """The worker's table of the call ``tag``; an earlier call's makes way for it."""
    return latest("frequent", tag, lambda: Frequent(broadcast.value))


def codec(model: str) -> PieceCodec:
    return kept(("pieces", model), lambda: PieceCodec(model))


def word_counts(texts: DataFrame) -> DataFrame:
    """``texts`` (text) -> (word, n): every distinct marked word, and how often it stands. A batch counts its own."""

    def count(batches):
        for b in batches:
            word, n = pc.value_counts(pa.chunked_array([words for words, _ in splits(b.column(0))], pa.string())).flatten()
            yield pa.RecordBatch.from_arrays([word, n], names=["word", "n"])

    return texts.select("text").mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def packed(ids: list[list[int]]) -> pa.Array:
    """Each list as the bytes of its ids, two an id."""
    at = np.cumsum([0, *map(len, ids)]) * 2
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.fromiter(chain.from_iterable(ids), "<u2"))])


def segmented(words: DataFrame, model: str) -> DataFrame:
    """``words`` (word, ...) -> the other columns and ``ids``, little-endian. A batch segments its distinct words; equal
    words that follow each other over batches are segmented once."""
    kept_columns = [c for c in words.columns if c != "word"]
    kinds = dict(words.dtypes)

    def run(batches):
        c, last = codec(model), {}
        for b in batches:
            coded = b.column(0).dictionary_encode()
            said = coded.dictionary.to_pylist()
            learn = [w for w in said if w not in last]
            made = dict(zip(learn, c.segment(learn), strict=True))
            ids = [last[w] if w in last else made[w] for w in said]
            if said:
                w = b.column(0)[-1].as_py()
                last = {w: last[w] if w in last else made[w]}
            yield pa.RecordBatch.from_arrays([*b.columns[1:], packed(ids).take(coded.indices)], names=[*kept_columns, "ids"])

    made = ", ".join(f"{x} {kinds[x]}" for x in kept_columns)
    return words.select("word", *kept_columns).mapInArrow(tidy(run), f"{made}, ids binary")


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """(doc_id, ids array<int>, decoded) of every whole text: a null text is empty and has no ids. Rows stay as they
    are, repeated ones and null ids too; texts of any length are one row; other columns are not read.

    Rows are told apart by where they lie, so ``docs`` that is not read from files is written to the shared folder first.
    """
    from zstandard import ZstdCompressor, ZstdDecompressor

    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = located(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    often = word_counts(rows).where((F.octet_length("word") <= SHORT) & (F.col("n") > 1)).orderBy(F.desc("n"), "word").limit(most)
    with settings(spark, TIDY):  # at most ``most`` short words, whatever the corpus
        got = segmented(often.select("word", F.col("word").alias("own")), model).select(F.col("own").alias("word"), "ids").toArrow()
    got = got.append_column("size", pc.cast(pc.divide(pc.binary_length(got.column("ids")), 2), pa.int64()))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, got.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(got)
    common, tag = spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex
    del got, sink
    pa.default_memory_pool().release_unused()  # else the driver keeps as much until it ends

    def rare(batches):
        """The words of each text that were not broadcast, numbered in order of appearance."""
        f = frequent(common, tag)
        for b in batches:
            _, text, k, word = f.numbered(b.column(2))
            text = pa.array(text)
            yield pa.RecordBatch.from_arrays([b.column(0).take(text), b.column(1).take(text), pa.array(k), word], names=["file", "row", "k", "word"])

    def code(batches):
        """Each text as the numbers of its words, in planes of bytes that compress well; rare words follow the others."""
        f, zstd = frequent(common, tag), ZstdCompressor(level=1)
        for b in batches:
            made = [zstd.compress(number.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for number in f.numbered(b.column(2))[0]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(made, pa.binary())], names=["file", "row", "doc_id", "raw"])

    def assemble(batches):
        """Rows of one text follow each other: its numbers first, then the ids of its rare words in order."""
        c, f = codec(model), frequent(common, tag)
        zstd = ZstdDecompressor()

        def ids_of(raw: bytes, own: list[bytes]) -> np.ndarray:
            number = np.ascontiguousarray(np.frombuffer(zstd.decompress(raw), np.uint8).reshape(4, -1).T).view("<i4").ravel()
            known = np.minimum(number, len(f.words))
            start, size = f.at[known], f.size[known]
            if own:  # rare words lie behind the frequent ones
                rare = number >= len(f.words)
                n = np.array([len(x) // 2 for x in own], np.int32)
                size[rare] = n[number[rare] - len(f.words)]
                start[rare] = (f.at[-1] + np.cumsum(n, dtype=np.int32) - n)[number[rare] - len(f.words)]
            upto = np.cumsum(size, dtype=np.int32)
            place = np.repeat(start - upto + size, size)
            place += np.arange(len(place), dtype=np.int32)
            if not own:
                return f.ids[place]
            late = place >= f.at[-1]
            made = np.empty(len(place), np.int32)
            made[~late] = f.ids[place[~late]]
            made[late] = np.frombuffer(b"".join(own), "<u2")[place[late] - f.at[-1]]
            return made

        def batch(texts):
            ids = [ids_of(raw, own) for _, raw, own in texts]
            decoded = [c.lib.decode(x.tolist()) if len(x) else "" for x in ids]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in texts], id_type), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

        texts: list = []
        id_type = None
        for b in batches:
            id_type = b.schema.field("doc_id").type
            for k, doc_id, raw in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if k >= 0:
                    texts[-1][2].append(raw)
                else:
                    if len(texts) >= 500:
                        yield batch(texts)
                        texts = []
                    texts.append((doc_id, raw, []))
        if texts:
            yield batch(texts)

    n = shuffle_partitions(spark)
    places = rows.select("file", "row", "text").mapInArrow(tidy(rare), "file long, row long, k int, word string")
    deal = F.when(F.octet_length("word") > SHORT, F.pmod("row", F.lit(SPREAD))).otherwise(0)
    found = segmented(places.repartition(n, "word", deal).sortWithinPartitions("word"), model)
    found = found.select("file", "row", "k", F.lit(None).cast(kind).alias("doc_id"), F.col("ids").alias("raw"))
    coded = rows.select("file", "row", "text", "doc_id").mapInArrow(tidy(code), f"file long, row long, doc_id {kind}, raw binary")
    both = coded.select("file", "row", F.lit(-1).alias("k"), "doc_id", "raw").union(found)
    whole = both.repartition(n, "file", "row").sortWithinPartitions("file", "row", "k")
    return whole.mapInArrow(tidy(assemble), f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Adds n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 to what :func:`encode_decode` gives."""
    return encoded.select(
        "*", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(read(spark, sf_dir, "documents"), model_path())).drop("ids", "decoded")
