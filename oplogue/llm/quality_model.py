"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkTable
from .common import read

WORDS = 1 << 14
FACTORS = 8
#: At most so many labelled documents are learned from.
SAMPLE = 4000
THRESHOLD = 0.7
#: Structure statistics, each cut into bins of its own; a document has one bin of each.
STATS = {
    "words": [1, 10, 20, 35, 50, 100, 300, 1000, 5000], "chars_a_word": [2, 3, 4, 5, 6, 7, 9, 12],
    "upper": [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7], "symbols": [0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1],
    "digits": [0.001, 0.01, 0.03, 0.1, 0.3], "marks": [0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3],
    "lines_again": [0.001, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8], "words_once": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "words_a_line": [1, 3, 6, 12, 25, 60], "windows_again": [0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.5], "spaces": [0.05, 0.1, 0.14, 0.18, 0.25, 0.4],
    "longest": [5, 10, 15, 20, 30, 60],
    # Metadata: the length that the row states, by itself and against the text's; -1 where it states none.
    "stated": [0, 1, 100, 300, 1000, 3000, 10000, 30000], "stated_off": [0, 0.01, 0.1, 0.5, 1.0],
}
OFFSETS = dict(zip(STATS, np.cumsum([WORDS, *(len(b) + 1 for b in STATS.values())])[:-1].tolist(), strict=True))
SIZE = WORDS + sum(len(b) + 1 for b in STATS.values())
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])
_SYMBOL = np.array([chr(i) in "#*$%&|<>@^~=+{}[]_\\" for i in range(256)])
_MARK = np.array([chr(i) in ".,;:!?\"'()-" for i in range(256)])
_DIGIT = np.array([48 <= i <= 57 for i in range(256)])
_SPACE = np.array([i == 32 or 9 <= i <= 13 for i in range(256)])


def features(text: str | None, stated: int | None, bins: ChunkTable) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed distinct words share a unit length, each statistic's bin has 1. Whole text; null is
    empty."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    own = set(words)
    hashes = np.fromiter(map(hash, words), np.int64, n)  # only compared within this text
    again = 0.0
    if n > 8:
        w = hashes[:-7].astype(np.uint64)
        for k in range(1, 8):
            w = w * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - 7 + k].astype(np.uint64)
        again = 1 - len(np.unique(w)) / len(w)
    letters = max(int(c[_LETTER].sum()), 1)
    stats = {
        "words": n, "chars_a_word": (size - int(c[_SPACE].sum())) / max(n, 1), "upper": int(c[_UPPER].sum()) / letters, "symbols": int(c[_SYMBOL].sum()) / size,
        "digits": int(c[_DIGIT].sum()) / size, "marks": int(c[_MARK].sum()) / size, "lines_again": 1 - len(set(lines)) / max(len(lines), 1),
        "words_once": len(own) / max(n, 1), "words_a_line": n / max(len(lines), 1), "windows_again": again, "spaces": int(c[_SPACE].sum()) / size,
        "longest": max(map(len, own), default=0),
        "stated": -1 if stated is None else stated, "stated_off": -1 if stated is None else abs(stated - len(text or "")) / max(stated, len(text or ""), 1),
    }
    word = np.unique(np.fromiter(map(bins.__getitem__, own), np.int64, len(own)))
    dense = [OFFSETS[k] + int(np.searchsorted(STATS[k], v, side="right")) for k, v in stats.items()]
    return np.r_[word, dense].astype(np.int32), np.r_[np.full(len(word), 1 / np.sqrt(max(len(word), 1))), np.ones(len(dense))].astype(np.float32)


def word_bins() -> ChunkTable:
    return ChunkTable(lambda w: zlib.crc32(w) % WORDS)


class FactorisationMachine:
    """p = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairs cost linear time, as half of
    sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2."""

    def __init__(self, b: float, w: np.ndarray, v: np.ndarray):
        self.b, self.w, self.v = b, w, v

    @staticmethod
    def _sums(at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Rows of x summed between the places in ``at``; each document has some."""
        return np.add.reduceat(x, at[:-1], axis=0)

    def margins(self, at: np.ndarray, i: np.ndarray, x: np.ndarray):
        vx = self.v[i] * x[:, None]
        s = self._sums(at, vx)
        return self.b + self._sums(at, self.w[i] * x) + 0.5 * (s**2 - self._sums(at, vx**2)).sum(axis=1), vx, s

    def predict(self, at, i, x) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(at, i, x)[0].astype(np.float64), -40, 40)))

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 2e-4, seed: int = 7):
        """AdaGrad on the log loss, with weight decay on what a batch touches. Reruns agree."""
        rng = np.random.default_rng(seed)
        m = FactorisationMachine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32))
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        m.b = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, FACTORS), 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                i = np.concatenate([rows[j][0] for j in some])
                x = np.concatenate([rows[j][1] for j in some])
                at = np.r_[0, np.cumsum([len(rows[j][0]) for j in some])]
                z, vx, s = m.margins(at, i, x)
                g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[some]) / len(some)).astype(np.float32)
                each = np.repeat(g, np.diff(at))
                dw = each * x
                dv = each[:, None] * x[:, None] * (np.repeat(s, np.diff(at), axis=0) - vx)
                u, where = np.unique(i, return_inverse=True)
                sw, sv = np.zeros(len(u), np.float32), np.zeros((len(u), FACTORS), np.float32)
                np.add.at(sw, where, dw)
                np.add.at(sv, where, dv)
                sw += decay * m.w[u]
                sv += decay * m.v[u]
                gw[u] += sw**2
                gv[u] += sv**2
                gb += float(g.sum()) ** 2
                m.w[u] -= rate * sw / np.sqrt(gw[u])
                m.v[u] -= 0.3 * rate * sv / np.sqrt(gv[u])
                m.b -= rate * float(g.sum()) / np.sqrt(gb)
        return m

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, b=self.b, w=self.w, v=self.v)
        return out.getvalue()

    @staticmethod
    def loads(raw: bytes) -> FactorisationMachine:
        z = np.load(io.BytesIO(raw))
        return FactorisationMachine(float(z["b"]), z["w"], z["v"])


def stated(docs: DataFrame) -> Column:
    """The length that a row states for its text, if the table has such a column."""
    return F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def train(docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> FactorisationMachine:
    """Learn from at most ``sample`` labelled rows that satisfy ``where``, chosen by a hash of their ids; executors make
    the features. Without labelled rows the machine scores 0.5 throughout."""
    spark = docs.sparkSession
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    chosen = marked.where(where).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(sample)
    # One row an id, so that no more than ``sample`` rows come back however often ids are repeated.
    rows = docs.select(F.col(id_col), F.struct(F.col(text_col).alias("text"), stated(docs).alias("stated")).alias("d")).join(F.broadcast(chosen), id_col)
    rows = rows.groupBy(id_col).agg(F.min("d").alias("d"), F.first("y").alias("y")).select("d.text", "y", F.col(id_col).cast("string").alias("id"), "d.stated")

    def make(batches):
        bins = word_bins()
        for b in batches:
            made = [features(t, n, bins) for t, n in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(2), b.column(1), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary())],
                names=["id", "y", "i", "x"],
            )

    got = sorted(rows.mapInArrow(make, "id string, y int, i binary, x binary").collect())
    if not got:
        return FactorisationMachine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, FACTORS), np.float32))
    return FactorisationMachine.fit([(np.frombuffer(r.i, np.int32), np.frombuffer(r.x, np.float32)) for r in got], np.array([r.y for r in got], np.float32))


def score(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row from its whole text, however long; null and empty texts score by their structure alone. Repeated
    rows and null ids keep a row each; other columns are not read."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(machine.dumps())  # a fixed size, whatever the corpus

    def run(batches):
        m, bins = FactorisationMachine.loads(raw.value), word_bins()
        for b in batches:
            made = [features(t, n, bins) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            if not made:
                continue
            at = np.r_[0, np.cumsum([len(i) for i, _ in made])]
            p = m.predict(at, np.concatenate([i for i, _ in made]), np.concatenate([x for _, x in made]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), stated(docs).alias("stated")).mapInArrow(run, f"doc_id {kind}, score double")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    machine = train(docs, labels, ~held_out)
    return score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
