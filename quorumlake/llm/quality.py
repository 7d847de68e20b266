"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

Features of a text, each group averaged over its occurrences so that length doesn't count:

* words (lower case) and pairs of neighbouring words, hashed;
* pairs of neighbouring word shapes, hashed: runs of capitals, small letters and digits
  shrink to ``A``, ``a`` and ``9``, repeated marks to one and ``+``;
* pairs of equal neighbouring words.

Training makes follow-the-regularised-leader updates, one labelled text at a time; a score is a
sparse dot product with the learned weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix64

BITS = 18
#: Labelled texts are sampled by hash to about this many; the only bound of the fit.
SAMPLE = 4000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
#: Scale of the groups: words, pairs of words, pairs of shapes, repetition.
SCALE = (3.0, 3.0, 12.0, 12.0)
THRESHOLD = 0.3

_SHAPES = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([^\W\d_]+)|(\d+)|((.)\5+)|.", re.DOTALL)


def shape(word: str) -> str:
    return "".join("A" if m[1] else "a" if m[2] else "9" if m[3] else m[5] + "+" if m[4] else m[0] for m in _SHAPES.finditer(word))[:12]


class WordTable(dict):
    """Number of a word; arrays by number hold the hashes of the word and its shape."""

    LIMIT = 100_000

    def __init__(self):
        super().__init__()
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.hashes, self.shapes = np.empty(1 << 12, np.uint64), np.empty(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i == len(self.hashes):
            self.hashes, self.shapes = (np.concatenate([x, np.empty_like(x)]) for x in (self.hashes, self.shapes))
        self.hashes[i] = xxhash.xxh3_64_intdigest(word.lower())
        self.shapes[i] = xxhash.xxh3_64_intdigest(shape(word.decode("utf-8", "replace")))
        self[word] = i
        return i

    def features(self, text: str | None) -> list[np.ndarray]:
        """Indices of the occurrences in each group; the last is repetition's, one for each pair of equal words."""
        if len(self) > self.LIMIT:
            self._empty()
        words = (text or "").encode("utf-8", "replace").split()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        h, s = self.hashes[at], self.shapes[at]
        cut, one = np.uint64(64 - BITS), np.uint64(1)
        index = lambda x, group: (mix64(x * np.uint64(4) + np.uint64(group)) >> cut).astype(np.int64)
        pairs = mix64(h[:-1]) + h[1:] * np.uint64(3) if len(h) else h
        shapes = mix64(np.r_[one, s]) + np.r_[s, one] * np.uint64(3)
        return [index(h, 0), index(pairs, 1), index(shapes, 2), np.zeros(int((h[:-1] == h[1:]).sum()), np.int64)]


@dataclass
class QualityModel:
    weights: np.ndarray  # hashed groups
    repeated: float
    bias: float

    def raw(self, groups: list[np.ndarray]) -> float:
        z = self.bias
        for x, scale in zip(groups[:3], SCALE, strict=False):
            if len(x):
                z += scale * float(self.weights[x].mean())
        return z + SCALE[3] * self.repeated * len(groups[3]) / max(1, len(groups[1]))

    def score(self, groups: list[np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(groups), -30, 30))))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> QualityModel:
    """FTRL-proximal over sparse examples (indices, values, label), in the order given.

    Index ``1 << BITS`` is repetition, the next one the bias.  Without examples every score is 1/2.
    """
    size = (1 << BITS) + 2
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, label in examples:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size))
    return QualityModel(w[: 1 << BITS].astype(np.float32), float(w[-2]), float(w[-1]))


def sparse(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text's features; indices are distinct."""
    at = np.concatenate([*groups[:3], [1 << BITS, (1 << BITS) + 1]])
    x = np.concatenate([*(np.full(len(g), s / max(1, len(g))) for g, s in zip(groups[:3], SCALE, strict=False)), [SCALE[3] * len(groups[3]) / max(1, len(groups[1])), 1.0]])
    at, place = np.unique(at, return_inverse=True)
    return at, np.bincount(place, x)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = WordTable()
    for batch in batches:
        made = [sparse(table.features(t.as_py())) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a.astype("<u4").tobytes() for a, _ in made], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary())],
            ["k", "label", "at", "x"],
        )


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Learns from ``labels`` (id, label 0 or 1) and the texts they name.

    About ``sample`` labels, chosen by a hash of the id, are used; the driver gets the sparse
    features of so many texts and trains on them in hash order.  Labels that are null or have a null id teach
    nothing; of several labels of one id the least counts, several texts of one
    id are several examples.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    k = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 40))
    n = known.count()
    rows = known.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("k", k).where(F.col("k") < int(min(1.0, sample / max(1, n)) * (1 << 40))).limit(2 * sample).collect()
    if not rows:
        return train([])
    chosen = F.broadcast(spark.createDataFrame(rows, "doc_id long, label int, k long"))  # at most 2 * sample rows
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id").select("k", "label", "text")
    found = sorted(texts.mapInArrow(_examples, "k long, label int, at binary, x binary").collect(), key=lambda r: (r["k"], bytes(r["at"]), bytes(r["x"])))
    return train([(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(np.float64), r["label"]) for r in found])


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``.

    Null and empty texts are scored by the bias alone.  Whole texts count; repeated ids
    stay separate rows; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value, WordTable()
        for batch in batches:
            s = np.array([model.score(table.features(t.as_py())) for t in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text scores at least the threshold; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value, WordTable()
        for batch in batches:
            yield batch.filter(pa.array([model.score(table.features(t.as_py())) >= threshold for t in batch.column(at)], pa.bool_()))
        del table
        give_back()

    return docs.mapInArrow(run, docs.schema)
