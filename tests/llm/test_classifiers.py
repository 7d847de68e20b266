import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import lang_mix, quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_held_out(spark, docs):
    got = queries.op6_quality(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([rows[i].predicted == q for i, q in labels]) > 0.93


def test_ftrl_learns_and_equals_plain_updates():
    rng = np.random.default_rng(1)
    examples = [(np.array([k, 5, (1 << quality.BITS) + 1]), np.array([1.0, 0.5, 1.0]), int(k % 2)) for k in rng.integers(0, 4, 200)]
    model = quality.train(examples, epochs=2)
    z, n = {}, {}
    for _ in range(2):
        for at, x, y in examples:
            w = {}
            for i in at:
                zi = z.get(i, 0.0)
                w[i] = 0.0 if abs(zi) <= quality.L1 else -(zi - np.sign(zi) * quality.L1) / ((quality.BETA + np.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at, x, strict=True))))
            for i, v in zip(at, x, strict=True):
                g = (p - y) * v
                s = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    for i in range(4):
        want = -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + np.sqrt(n[i])) / quality.ALPHA + quality.L2)
        assert abs(model.weights[i] - want) < 1e-6
    assert model.weights[1] > 0 > model.weights[0]


def test_score_is_the_sparse_product():
    table = quality.WordTable()
    model = quality.train([(*quality.sparse(table.features(t)), y) for t, y in [("good plain words here", 1), ("BAD!! BAD!! BAD!!", 0)] * 5])
    w = np.r_[model.weights, model.repeated, model.bias]
    for text in ["good words", "BAD!! BAD!!", "", "x", None]:
        at, x = quality.sparse(table.features(text))
        assert abs(model.raw(table.features(text)) - float(w[at] @ x)) < 1e-5
    assert quality.shape("ABc12!!x") == "Aa9!+a"


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (2, "fine words", 0.0), (None, "x " * 60_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == 4
    assert quality.score(docs.limit(0), model).collect() == []
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).columns == docs.columns


def test_language_held_out(spark, docs):
    got = queries.op8_language_mixture(spark, SF)
    rows = got.join(docs, "doc_id").select("doc_id", "held_out", "lang_pred", "lang", "score").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.97


def test_mixture_finds_languages(spark):
    words = {"en": "the quick brown fox jumps over lazy dogs again", "de": "schnelle braune füchse springen über träge hunde", "fr": "les renards bruns sautent sur des chiens paresseux", "es": "rápidos zorros marrones saltan sobre perros"}
    train = spark.createDataFrame([(i, t * 20, k, "x") for i, (k, t) in enumerate(words.items())] + [(9, None, "en", "x"), (10, "x", None, "x")], "doc_id long, text string, lang string, score string")
    model = lang_mix.fit(train)
    assert model.languages == ["de", "en", "es", "fr"]
    texts = [(1, (words["en"] + " ") * 6 + (words["de"] + " ") * 3), (2, words["fr"] + "."), (3, None), (4, "12 -- !"), (5, ""), (5, words["es"]), (6, (words["en"] + " ") * 5000)]
    got = lang_mix.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert len(got) == len(texts)
    by = {(r.doc_id, r.lang_pred): r for r in got}
    mixed = {x.lang: x.share for x in by[1, "en"].languages}
    assert mixed.keys() == {"en", "de"} and abs(mixed["en"] - 18 / 25) < 0.08
    assert [x.lang for x in by[2, "fr"].languages] == ["fr"]
    assert by[3, "und"].score == by[4, "und"].score == by[5, "und"].score == 0.0
    assert (5, "es") in by and (6, "en") in by
    empty = lang_mix.fit(train.limit(0))
    assert {r.lang_pred for r in lang_mix.predict(train, empty).collect()} == {"und"}
    assert lang_mix.keep_determined(train, model).count() == 5
    assert lang_mix.predict(train.limit(0), model).collect() == []


def test_mixture_equals_plain_em():
    rng = np.random.default_rng(0)
    loglik, counts = rng.normal(-5, 2, (40, 3)), rng.integers(1, 5, 40).astype(float)
    share, fit = lang_mix.mixture(loglik, counts, rounds=500)
    p = np.full(3, 1 / 3)
    for _ in range(500):
        z = np.exp(loglik) * p
        z /= z.sum(1, keepdims=True)
        p = (z * counts[:, None]).sum(0) / counts.sum()
    assert np.allclose(share, p, atol=0.01)
    assert abs(fit - (counts @ np.log(np.exp(loglik) @ p))) < 0.05


def test_null_lang_column_is_no_input(spark, docs):
    model = queries.language_model(spark, SF)
    blank = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    a, b = (sorted((r.doc_id, r.lang_pred) for r in lang_mix.predict(d, model).collect()) for d in (docs, blank))
    assert a == b


def test_short_passage_of_a_long_text_is_kept():
    # words are 15 nats likelier in their own language; 60 of 20,000 are of the second
    loglik = np.array([[-5.0, -20, -20, -20], [-20, -5, -20, -20]])
    found = dict(lang_mix.languages_of(loglik, np.array([19_940.0, 60])))
    assert found.keys() == {0, 1} and found[1] < 0.01
    assert [i for i, _ in lang_mix.languages_of(loglik, np.array([20_000.0, 0]))] == [0]


def test_whole_score_equals_plain_counting(spark, docs):
    """A text's score from its words, pairs and shapes, counted one by one."""
    model = queries.quality_model(spark, SF)
    cut = lambda x: int(quality.mix64(np.array([x & (1 << 64) - 1], np.uint64))[0]) >> (64 - quality.BITS)
    mix = lambda x: int(quality.mix64(np.array([x & (1 << 64) - 1], np.uint64))[0])
    texts = [r.text for r in docs.limit(60).collect()] + ["", None, "one", "a a a b"]
    table = quality.WordTable()
    for text in texts:
        words = (text or "").encode("utf-8", "replace").split()
        h = [quality.xxhash.xxh3_64_intdigest(w.lower()) for w in words]
        f = [quality.xxhash.xxh3_64_intdigest(quality.shape(w.decode("utf-8", "replace"))) for w in words]
        single = [cut(x * 4) for x in h]
        pair = [cut((mix(x) + y * 3) * 4 + 1) for x, y in zip(h, h[1:], strict=False)]
        shapes = [cut((mix(x) + y * 3) * 4 + 2) for x, y in zip([1, *f], [*f, 1], strict=True)]
        z = model.bias
        for group, scale in zip((single, pair, shapes), quality.SCALE, strict=False):
            z += scale * sum(float(model.weights[i]) for i in group) / len(group) if group else 0.0
        z += quality.SCALE[3] * model.repeated * sum(x == y for x, y in zip(h, h[1:], strict=False)) / max(1, len(pair))
        want = 1 / (1 + np.exp(-max(-30, min(30, z))))
        assert abs(model.score(table.features(text)) - want) < 1e-4, text


def test_sets_of_languages_against_all_sets(spark, docs):
    """The set that elimination leaves, next to the best of all sets by the same penalised likelihood."""
    from itertools import combinations

    model = queries.language_model(spark, SF)
    words, rng = lang_mix.WordLikelihoods(model), np.random.default_rng(2)
    by_lang = {}
    for r in docs.where("lang is not null and length(text) > 300").limit(400).collect():
        by_lang.setdefault(r.lang, []).append(r.text[:400])
    every = range(len(model.languages))

    def cost(some, loglik, counts):
        return -2 * lang_mix.mixture(loglik[:, list(some)], counts, rounds=200)[1] + np.log(counts.sum() + 1) * (len(some) - 1)

    equal = tried = 0
    for _ in range(60):
        chosen = rng.choice(sorted(by_lang), rng.integers(1, 4), replace=False)
        text = " ".join(by_lang[x][rng.integers(len(by_lang[x]))] for x in chosen)
        loglik, counts = words.table(text)
        sets = [s for n in range(1, len(every) + 1) for s in combinations(every, n)]
        best = min(sets, key=lambda s: cost(s, loglik, counts))
        found = tuple(sorted(i for i, _ in lang_mix.languages_of(loglik, counts)))
        equal += found == best
        tried += 1
        assert cost(found, loglik, counts) <= cost(best, loglik, counts) + 6
    assert equal >= 0.9 * tried
