import io
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from oplogue.llm import pieces, token_files
from oplogue.llm.chunks import ChunkTable
from oplogue.llm.common import shared_folder

from .fixtures import awkward, table

pytest.importorskip("public_tokenizers")
ODD = [
    "", " ", "  a  b ", "a ", "a\tb\nc", "▁x▁", "a ▁ b", "　x\xa0y", "a\x00b", "<s> </s> <unk> <0x0A>", "don't I'll x'd",
    "foo<|endoftext|>bar <|startoftext|>", "é É İI ΑΣ ΣΑΣ.", "a1b22 c-d_e (f) [g]!?", "ﬁ ① 中文 🙂🙂 ÄÖÜß", "x\x85y z\x1c\x1dw", "Don't STOP!! the...end", "a'b 'tis", "word,word", "ª º ×÷",
]


def odd_rows():
    return [*awkward(6), *((1000 + i, t, "en", "odd", 1) for i, t in enumerate(ODD))]


@pytest.mark.parametrize("most", [0, 7, 100_000])
def test_pieces_equal_the_library(spark, most):
    import hashlib

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = odd_rows()
    full = pieces.encode_decode(table(spark, rows), pieces.model_path(), most=most)
    got = sorted((tuple(r) for r in pieces.digests(full).drop("ids", "decoded").collect()), key=str)
    want = []
    for r in rows:
        ids = lib.encode(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((lib.decode(ids) if ids else "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in full.collect()) == sorted((str(r[0]), lib.encode(r[1] or ""), lib.decode(lib.encode(r[1] or "")) or "") for r in rows)


def test_each_distinct_word_is_segmented_once(spark, monkeypatch):
    rows = odd_rows() * 3
    words = pieces.word_counts(table(spark, rows).repartition(5)).collect()
    assert len({r.word for r in words}) == len(words)
    count = Counter(w for r in rows for w in pieces.split(r[1]))
    assert {r.word: r.n for r in words} == count

    class Once:
        def __init__(self):
            self.said = []

        def segment(self, some):
            self.said += some
            return [[len(w)] for w in some]

    once = Once()
    monkeypatch.setattr(pieces, "codec", lambda model: once)
    captured = {}

    class Frame:
        columns, dtypes = ["word", "k"], [("word", "string"), ("k", "int")]
        select = lambda self, *c: self
        mapInArrow = lambda self, run, made: captured.update(run=run, made=made)

    pieces.segmented(Frame(), "m")
    batches = [pa.RecordBatch.from_pydict({"word": w, "k": pa.array([0] * len(w), pa.int32())}) for w in (["a", "a", "b"], ["b", "b"], ["b", "cc"], [])]
    made = [x for b in captured["run"](iter(batches)) for x in b.column(1).to_pylist()]
    assert once.said == ["a", "b", "cc"] and made == [np.array([n], "<u2").tobytes() for n in (1, 1, 1, 1, 1, 1, 2)]


def test_pieces_of_a_very_long_text_and_a_long_word(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = ["the quick  brown foxes " * 100_000, "y" * 20_000 + " end"]
    got = pieces.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces.model_path(), most=2).collect()
    assert {r.doc_id: r.ids for r in got} == {i: lib.encode(t) for i, t in enumerate(texts)}
    assert all(r.decoded == texts[r.doc_id] for r in got)


def test_chunk_table_forgets_and_stays_right():
    t = ChunkTable(str.upper, 3)
    assert [t[c] for c in "abcabdefgaab"] == list("ABCABDEFGAAB") and len(t) <= 3


def test_files_equal_the_library_and_round_trip(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.tokenizer_path())
    rows = odd_rows()
    folder = shared_folder(spark, "t")
    manifest = token_files.write_tokens(table(spark, rows), token_files.tokenizer_path(), folder)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(manifest).collect())
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((at, r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_one_document_is_read_alone_and_damage_is_seen():
    out = io.BytesIO()
    w = token_files.FrameWriter(out)
    for i in range(50):
        w.add(i or None, np.arange(i, dtype="<u4").tobytes())
    w.finish()

    class Counting(io.BytesIO):
        n = 0

        def read(self, k=-1):
            Counting.n += k
            return super().read(k)

    f = token_files.FrameReader(Counting(out.getvalue()))
    assert f.ids[:3] == [None, 1, 2] and len(f) == 50
    Counting.n = 0
    assert f.document(30) == np.arange(30, dtype="<u4").tobytes()
    assert Counting.n == f.entries[30][0]
    import zstandard

    d = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert d == b"".join(np.arange(i, dtype="<u4").tobytes() for i in range(50))
    bad = bytearray(out.getvalue())
    bad[int(f.offsets[30]) + 9] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        token_files.FrameReader(io.BytesIO(bad)).document(30)


def test_empty_table(spark):
    e = table(spark, [])
    assert token_files.read_tokens(token_files.write_tokens(e, token_files.tokenizer_path(), shared_folder(spark, "e"))).collect() == []
    assert pieces.encode_decode(e, pieces.model_path()).collect() == []


def test_control_characters_of_ascii_texts_are_tokens():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.tokenizer_path())
    texts = ["ab\x1ccd", "\x1d", " a\x1e b\x1f\n", "\x1c\x1d x\ty\x0bz\x0c\r\x1f", "plain words", "é ab\x1ccd"]
    got = token_files.WordCodec(token_files.tokenizer_path()).encode(pa.array(texts))
    assert [np.frombuffer(raw, "<u4").tolist() for raw in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_models_with_other_rules_are_encoded_whole(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    words = {w: i for i, w in enumerate(["<u>", "a", "b", " ", "A", "ab", "B"])}
    cases = {
        "case": Tokenizer(models.WordPiece(words, unk_token="<u>", continuing_subword_prefix="")), "spaces": Tokenizer(models.BPE(words, [], unk_token="<u>")),
    }
    cases["case"].pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    texts = ["a b", "A ab", "ab  B\n", "", "a"]
    for name, lib in cases.items():
        lib.save(str(tmp_path / name))
        c = token_files.WordCodec(str(tmp_path / name))
        assert not c.by_part and c.by_chunk == (name == "case")
        assert [np.frombuffer(r, "<u4").tolist() for r in c.encode(pa.array(texts))] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_text_and_shared_ids(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.tokenizer_path())
    rows = [(7, "one Long, long text. " * 60_000), (None, "b"), (None, "a"), (7, "x"), (7, "x")]
    manifest = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), token_files.tokenizer_path(), shared_folder(spark, "l"))
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_tokens(manifest).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(g[1], g[2]) for g in got] == [(i, len(lib.encode(t, add_special_tokens=False).ids) + 1) for i, t in order]


def _table(words):
    made = pa.table({"word": pa.array(words, pa.string()), "ids": pa.array([b"\1\0"] * len(words), pa.binary()), "size": pa.array([1] * len(words), pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, made.schema) as out:
        out.write_table(made)
    return pieces.Frequent(sink.getvalue().to_pybytes())


def test_words_of_a_batch_are_looked_up_at_once_in_arrow(monkeypatch):
    rnd, real, times = random.Random(4), pieces.pc.index_in, []
    monkeypatch.setattr(pieces.pc, "index_in", lambda *a, **b: times.append(1) or real(*a, **b))
    for i in range(300):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choices(["a", "bé", " ", " ", "▁", "\n", "中"], k=rnd.randrange(9))) for _ in range(rnd.randrange(9))]
        words = ["a", "bé", " a"][: rnd.randrange(4)]
        f, begin = _table(words), rnd.randrange(len(texts) + 1)
        batch, texts = pa.array(texts, pa.string())[begin:], texts[begin:]
        monkeypatch.setattr(pieces, "GROUP", rnd.choice([1, 5, 100]))
        said, n = pieces.split_all(batch)
        assert (said.to_pylist(), n.tolist()) == ([w for t in texts for w in pieces.split(t)], [len(pieces.split(t)) for t in texts])
        numbers, text, k, word = f.numbered(batch)
        assert len(times) == i + 1  # the table is hashed once a batch, not once a group of texts
        own = [{} for _ in texts]
        want = [[words.index(w) if w in words else len(words) + o.setdefault(w, len(o)) for w in pieces.split(t)] for t, o in zip(texts, own, strict=True)]
        assert [x.tolist() for x in numbers] == want
        assert list(zip(text.tolist(), k.tolist(), word.to_pylist(), strict=True)) == [(i, k, w) for i, o in enumerate(own) for w, k in o.items()]


def test_workers_give_memory_back_after_a_task(monkeypatch):
    given, captured = [], {}

    class Pool:
        release_unused = lambda self: given.append(1)

    class Frame:
        select = lambda self, *c: self
        groupBy = lambda self, *c: self
        agg = lambda self, *c: self
        mapInArrow = lambda self, run, made: captured.update(run=run) or self

    monkeypatch.setattr(pieces.F, "sum", lambda x: pieces.F)
    monkeypatch.setattr(pieces.F, "alias", lambda x: x, raising=False)
    pieces.word_counts(Frame())
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    made = list(captured["run"](iter([pa.RecordBatch.from_pydict({"text": ["a b a", None, ""]}), pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})])))
    assert [sorted(zip(*b.to_pydict().values(), strict=True)) for b in made] == [[("a", 2), ("b", 1)], []] and given == [1]
