import random
from itertools import combinations

import numpy as np
import pytest

from quorumlake.llm import jaccard_join
from quorumlake.llm.jaccard_join import InvertedIndex, jaccard_components


def words_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    w = min(k, len(words))
    return {tuple(words[i : i + w]) for i in range(len(words) - w + 1)}


def brute(rows, k, percent):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {i: words_set(t, k) for i, t in rows}
    for a, b in combinations(sets, 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both and 100 * both >= percent * either:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, n=150, vocab=400):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows, i = [], 0
    while len(rows) < n:
        base = [f"w{rng.randrange(vocab)}" for _ in range(rng.choice([1, 2, 4, 9, 10, 11, 40, 120, 400]))]
        if rng.random() < 0.3:
            at = rng.randrange(len(base) + 1)
            base[at:at] = passage
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(vocab)}"
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(copy)))
            i += 1
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("least", [3, 50])
def test_equals_brute_force(spark, k, percent, least, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", least)
    rows = [*corpus(k, 150), (9001, None), (9002, ""), (9003, " \n"), (9004, "One two"), (9005, "one  TWO")]
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent).collect()}
    assert got == brute(rows, k, percent)


def test_large_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 600)
    rows = corpus(9, 120)
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90).collect()}
    assert got == brute(rows, 3, 90)


def test_near_copies_of_a_large_block_are_few_queries_and_links(spark, monkeypatch):
    """Edited copies of one text, of which the least one links with few others."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 6000)
    rng, found, asked = random.Random(3), [], []
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(240):
        words = list(base)
        for _ in range(rng.randint(1, 3) if i else 4):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    large, save = jaccard_join._large_blocks, jaccard_join.Scratch.save

    def counted(*args):
        links = large(*args)
        found.append(links.count())
        return links

    def saved(self, df, name):
        if name == "rest":
            asked.append(df.count())
        return save(self, df, name)

    monkeypatch.setattr(jaccard_join, "_large_blocks", counted)
    monkeypatch.setattr(jaccard_join.Scratch, "save", saved)
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 5, 80)
    assert found and sum(found) < 4 * len(rows)
    assert asked and sum(asked) < len(rows)


def test_search_equals_counting():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(150, 300)], rng.integers(0, 2**63, 8, dtype=np.uint64)]) for _ in range(80)]
    index = InvertedIndex(sets)
    for percent in (50, 80, 90):
        for q in sets:
            want = [j for j, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))]
            assert index.search(q, percent).tolist() == want


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, "a b c d e f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(jaccard_components(df).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert jaccard_components(df.limit(0)).collect() == []
    long = " ".join(f"w{i}" for i in range(30_000))
    got = jaccard_components(spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}


def test_linked_sets_share_a_signature():
    rng, schemes = np.random.default_rng(8), {}
    for percent in (50, 80, 90):
        for n in [*range(1, 40), 60, 100, 170, 400, 1500]:
            base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            hot = np.sort(rng.permutation(base)[: rng.integers(0, len(base) + 1)])
            for _ in range(4):
                gone = rng.integers(0, n * (100 - percent) // 100 + 1)
                other = np.sort(rng.permutation(base)[gone:])
                other = np.unique(np.r_[other, rng.integers(0, 2**63, rng.integers(0, max(1, n * (100 - percent) // 100 - gone + 1)), dtype=np.uint64)])
                both = len(np.intersect1d(base, other))
                if both and 100 * both >= percent * len(np.union1d(base, other)):
                    for bands in (jaccard_join.WIDE, jaccard_join.NARROW):
                        a, b = (jaccard_join.signatures(x, percent, schemes.setdefault((percent, bands), {}), hot, bands) for x in (base, other))
                        assert len(np.intersect1d(a, b)), (percent, n)


def test_survey_keeps_whatever_has_a_partner():
    rng = np.random.default_rng(12)
    for percent in (10, 50, 80, 90, 100):
        for n in [*range(1, 60), 200, 999]:
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            for _ in range(6):
                gone = rng.integers(0, n * (100 - percent) // 100 + 1)
                b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**63, rng.integers(0, max(1, n * 100 // percent - n + 1)), dtype=np.uint64)])
                both = len(np.intersect1d(a, b))
                if both and 100 * both >= percent * len(np.union1d(a, b)):
                    sent = [x[: jaccard_join.sent_and_slack(len(x), percent)[0]] for x in (a, b)]
                    shared = len(np.intersect1d(*sent))
                    assert shared >= jaccard_join.least_shared(len(a), percent), (percent, len(a), len(b))
                    assert shared >= jaccard_join.least_shared(len(b), percent), (percent, len(a), len(b))


@pytest.mark.parametrize("buckets", [1, 1_000_000])
def test_groups_across_batches_and_buckets(spark, buckets, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", buckets)
    rows = [(i, t) for i, t in corpus(21, 120)]
    rows += [(7000 + i, rows[0][1]) for i in range(200)] + [(7500 + i, rows[1][1] + " ." * (i % 2)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    for k, percent in ((3, 90), (5, 80)):
        got = {r[0]: (r[1], r[2]) for r in jaccard_components(df, k=k, percent=percent).collect()}
        assert got == brute(rows, k, percent)


def test_an_id_with_several_texts_joins_their_groups(spark):
    a, b, c = ("a b c d e f g h", "p q r s t u v w", "x y z o l m n k")
    rows = [(9, a), (9, b), (9, c), (4, a), (5, b), (12, c), (20, "alone in here with itself"), (None, a), (9, None)]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None and r.n_shingles)
    assert got == [(4, 4), (5, 4), (9, 4), (9, 4), (9, 4), (12, 4), (20, 20)]


def test_texts_of_megabytes(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(500_000)]
    near = list(long)
    near[1000] = "edited"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(reversed(long))), (4, None)]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
