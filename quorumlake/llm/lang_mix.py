"""Language identification as inference in a mixture of languages.

Model.  For each language, smoothed frequencies of hashed character n-grams (pairs and triples, with
word ends) of its training texts.  A word's likelihood under a language is the
product of its n-grams' likelihoods, tempered by their number.

Inference.  A document is a mixture: each of its words is drawn from one of the
languages.  Expectation-maximisation estimates the proportions over the distinct words with
their counts.  Languages are then taken away one by one, least proportion first, as long as the
penalised likelihood (BIC, one parameter for each language beyond the first) improves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix64

BUCKETS = 1 << 15
#: Training texts of each language are sampled by hash to about this many; the only bound of the fit.
SAMPLE = 600
SMOOTHING = 0.5
ROUNDS = 12
UNDETERMINED = "und"


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of pairs, buckets of triples, where triples lie in one word) by place in
    the words (letters only) joined by spaces; a place belongs to the word its first letter or the space before it is in."""
    text = " " + " ".join(words) + "  "
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    two = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two * np.uint64(0x165667B19E3779F9) + c[2:] * np.uint64(0x27D4EB2F165667C5)
    cut = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (mix64(two) >> cut).astype(np.int64)[:-1], (mix64(three) >> cut).astype(np.int64)[:-1], (c[1:-1] != 32)[:-1]


def split_words(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # (BUCKETS, languages), float32


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            into = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            if words := [w for w in map(letters_of, split_words(text.as_py() or "")) if w]:
                two, three, inside = gram_buckets(words)
                into += np.bincount(two, minlength=BUCKETS) + np.bincount(three[inside], minlength=BUCKETS)
    for lang, into in counts.items():
        at = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(into[at])], ["lang", "bucket", "n"])


def fit(training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Learns from rows with a language; about ``sample`` of each, chosen by a hash of the id.

    What comes to the driver is one table of ``BUCKETS`` counts for each language.  Null
    languages and texts teach nothing.  Without any training row the model knows
    no language, and every prediction is ``und``.
    """
    t = training.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    rate = F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")) * float(1 << 30)
    rates = t.groupBy("lang").agg(rate.cast("long").alias("rate"))  # one row for each language
    t = t.join(F.broadcast(rates), "lang")
    chosen = F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1 << 30)) < F.col("rate")
    counts = t.where("text is not null").where(chosen).select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).orderBy("lang").collect()
    logp = np.full((len(rows), BUCKETS), SMOOTHING)
    for i, r in enumerate(rows):
        at = np.array([(x["bucket"], x["n"]) for x in r["c"]])
        logp[i, at[:, 0]] += at[:, 1]
    logp = np.log(logp / logp.sum(1, keepdims=True)) if len(rows) else logp
    return LanguageModel([r.lang for r in rows], np.ascontiguousarray(logp.T, np.float32))


class WordLikelihoods(dict):
    """Row of a word in a table of log-likelihoods by language; -1 for words without letters."""

    LIMIT = 100_000

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.rows = np.empty((1 << 12, len(model.languages)), np.float32)
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        letters = [letters_of(w) for w in new]
        self.update((w, -1) for w, x in zip(new, letters, strict=True) if not x)
        known = [(w, x) for w, x in zip(new, letters, strict=True) if x]
        if not known:
            return
        two, three, inside = gram_buckets([x for _, x in known])
        lengths = np.array([len(x) for _, x in known])
        starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
        logp = self.model.logp
        rows = np.add.reduceat(logp[two] + logp[three] * inside[:, None], starts, axis=0)
        rows *= (1 / (2 * lengths + 1) * lengths)[:, None]  # neighbouring n-grams aren't independent
        n = len(known)
        if self.used + n > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty((n + len(self.rows) // 2, self.rows.shape[1]), np.float32)])
        self.rows[self.used : self.used + n] = rows
        self.update((w, self.used + i) for i, (w, _) in enumerate(known))
        self.used += n

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods of the distinct words, their counts)."""
        if len(self) > self.LIMIT:
            self.clear()
            self.used = 0
        words = split_words(text)
        if new := [w for w in set(words) if w not in self]:
            self._learn(sorted(new))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        at, n = np.unique(at[at >= 0], return_counts=True)
        return self.rows[at].astype(np.float64), n.astype(np.float64)


def mixture(loglik: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) by expectation-maximisation."""
    top = loglik.max(1, keepdims=True)
    p = np.exp(loglik - top)
    share, total = np.full(p.shape[1], 1 / p.shape[1]), counts.sum()
    for _ in range(rounds if p.shape[1] > 1 else 0):
        weight = p * share
        weight *= (counts / weight.sum(1))[:, None]
        new = weight.sum(0) / total
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float(counts @ (np.log(p @ share) + top[:, 0]))


def languages_of(loglik: np.ndarray, counts: np.ndarray) -> list[tuple[int, float]]:
    """(language, proportion) of the set that backward elimination from all languages leaves by penalised likelihood, greatest proportion first."""
    kept = np.arange(loglik.shape[1])
    penalty = np.log(counts.sum() + 1)
    share, fit_ = mixture(loglik, counts)
    while len(kept) > 1:
        less = np.delete(kept, share.argmin())
        share2, fit2 = mixture(loglik[:, less], counts)
        if -2 * fit2 + penalty * (len(less) - 1) > -2 * fit_ + penalty * (len(kept) - 1):
            break
        kept, share, fit_ = less, share2, fit2
    order = np.argsort(-share, kind="stable")
    return [(int(kept[i]), float(share[i])) for i in order]


PREDICTIONS = "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>"


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, languages`` for every row of ``docs``.

    ``lang_pred`` is the language of the greatest proportion (of equal ones the first by name), ``score``
    that proportion in the chosen set.
    A text that is null or has no letter, or any text if no language was
    learned, is ``und`` with score 0 and no languages.  Whole texts count; repeated ids stay
    separate rows; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = WordLikelihoods(model)
        names = model.languages
        for batch in batches:
            pred, score, sets = [], [], []
            for t in batch.column(1):
                loglik, counts = words.table(t.as_py() or "") if names else (np.empty((0, 0)), np.empty(0))
                if not len(counts):
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    sets.append([])
                    continue
                found = languages_of(loglik, counts)
                pred.append(names[found[0][0]])
                score.append(min(1.0, found[0][1]))
                sets.append([{"lang": names[i], "share": s} for i, s in found])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)], ["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PREDICTIONS)


def keep_determined(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, in which one language has at least the share ``least``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordLikelihoods(shared.value)
        for batch in batches:
            keep = []
            for t in batch.column(at):
                loglik, counts = words.table(t.as_py() or "") if words.model.languages else (None, ())
                keep.append(bool(len(counts)) and languages_of(loglik, counts)[0][1] >= least)
            yield batch.filter(pa.array(keep, pa.bool_()))
        del words
        give_back()

    return docs.mapInArrow(run, docs.schema)
