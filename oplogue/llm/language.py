"""Language identification with a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Bins of n-grams: a text of 120 kB sets under a third of them.
BINS = 1 << 15
#: At most so many labelled documents are learned from, and so many of them are landmarks.
SAMPLE, LANDMARKS = 1500, 160
UNKNOWN = "und"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def presence(text: str, out: np.ndarray) -> None:
    """Set ``out`` to 1 at the bins of the byte n-grams (n = 1 to 4) that the whole text holds."""
    b = np.frombuffer(b" " + text.encode().translate(_LOWER) + b" ", np.uint8)
    b = np.where(b < 65, np.uint8(32), b)  # digits, punctuation and spaces are alike
    out[b] = 1
    code = b.astype(np.uint32)
    for n in (2, 3, 4):
        code = code[:-1] * np.uint32(257) + b[n - 1 :]
        out[((code * np.uint32(2654435761)) >> np.uint32(17)) & np.uint32(BINS - 1)] = 1


def _letters(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _unit(p: np.ndarray) -> np.ndarray:
    return p / np.maximum(np.sqrt(p.sum(axis=1, keepdims=True)), 1)


class Model:
    """scores = K(x, landmarks) @ weights, with K the share of n-grams in common (cosine of presence)."""

    def __init__(self, labels: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.labels, self.landmarks, self.weights = labels, landmarks, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        p = np.zeros((len(texts), BINS), np.float32)
        known = np.array([_letters(t) for t in texts], bool)
        for i in np.flatnonzero(known):
            presence(texts[i], p[i])
        s = _unit(p) @ self.landmarks.T @ self.weights
        e = np.exp(8.0 * (s - s.max(axis=1, keepdims=True)))
        e /= e.sum(axis=1, keepdims=True)
        best = s.argmax(axis=1)
        return (
            [self.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
            [float(e[i, b]) if known[i] else 0.0 for i, b in enumerate(best)],
        )

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, labels=np.array(self.labels), landmarks=self.landmarks, weights=self.weights)
        return out.getvalue()

    @staticmethod
    def loads(raw: bytes) -> Model:
        z = np.load(io.BytesIO(raw))
        return Model(z["labels"].tolist(), z["landmarks"], z["weights"])


def fit(p: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Model:
    """One-versus-rest kernel ridge regression on Nyström features of unit presence rows ``p``."""
    labels = sorted(set(langs))
    x = _unit(p.astype(np.float32))
    turn, seen = [], {}
    for i, g in enumerate(langs):  # landmarks in turn from each language
        seen[g] = seen.get(g, 0) + 1
        turn.append((seen[g], g, i))
    chosen = [i for *_, i in sorted(turn)[:landmarks]]
    z = x[chosen]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])
    phi = (x @ z.T).astype(np.float64) @ half
    y = np.where(np.array(langs)[:, None] == np.array(labels)[None, :], 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + ridge * len(x) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(labels, z, (half @ w).astype(np.float32))


def train(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learn from at most ``sample`` of the rows that satisfy ``where``, chosen by a hash of their ids.

    Executors turn their texts into packed presence bits, so the driver gets a fixed number of small rows. None if no
    row can be learned from.
    """
    spark = docs.sparkSession
    rows = docs.where(where).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("text is not null and lang is not null").withColumn("h", F.xxhash64("id"))
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return None

    def pack(batches):
        for b in batches:
            bits = []
            for t in b.column(1).to_pylist():
                p = np.zeros(BINS, np.uint8)
                presence(t, p)
                bits.append(np.packbits(p).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(bits, pa.binary())], names=["id", "lang", "h", "bits"])

    packed = rows.where(F.col("h") <= last).mapInArrow(pack, "id string, lang string, h long, bits binary")
    got = packed.orderBy("h", "id", "lang", "bits").limit(sample).collect()
    got = [r for r in got if np.frombuffer(r.bits, np.uint8).any()]
    return fit(np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in got]), [r.lang for r in got]) if got else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from its whole text: ``und`` with score 0 where the text is null or has
    no letter, and everywhere without a model. Score is the chance that the margins give to the language."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(model.dumps() if model else b"")  # a fixed size, whatever the corpus

    def run(batches):
        m = Model.loads(raw.value) if raw.value else None
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = part.column(1).to_pylist()
                langs, scores = m.predict(texts) if m else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = train(docs, ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
