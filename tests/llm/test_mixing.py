import random
import re

import pytest

from quorumlake.llm import mixing


def water(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (budget - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        target |= {s: 2 * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " \t".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 3, 10, 40]))), rng.choice(["a", "a", "a", "b", "Z", "é", None, "𝒳"])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "empty"), (None, "x y", "a"), (7, "x y z", "b"), (7, "x y z", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([(i, 0.25) for i in range(0, 1500, 3)] + [(3, 9.0), (None, 1.0), (4, None), (5, -1.0)], "doc_id long, w double")
    got = mixing.mix_sources(df, weights).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df, weights).collect()))
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    assert sorted(r.size for r in got) == sorted(size(t) for _, t, _ in rows)
    sums, largest = {}, {}
    for _, t, s in rows:
        sums[s] = sums.get(s, 0) + size(t)
        largest[s] = max(largest.get(s, 0), size(t))
    want = water(sums)
    taken, by_size = {}, {}
    for r in got:
        assert r.taken == r.copies * r["size"] and r.copies <= 2
        key = (r.source_size, round(r.target, 6))
        taken[key] = taken.get(key, 0) + r.taken
    for s in sums:
        key = (sums[s], round(want[s], 6))
        assert key in taken
        if list((sums[x], round(want[x], 6)) for x in sums).count(key) == 1:
            assert abs(taken[key] - want[s]) <= largest[s]


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", 3, 4.0, 1)], "doc_id long, text string, source string, size int, key double, bucket int")
    assert mixing.mix_sources(df.limit(0)).collect() == []
    r = mixing.mix_sources(df).first()
    assert (r.doc_id, r["size"], r.source_size, r.target, r.taken) == (1, 2, 2, 3.0, 4)  # half a document rounds up


def test_weights_matter(spark):
    df = spark.createDataFrame([(i, "w", "big") for i in range(4000)] + [(10_000 + i, "w", "small") for i in range(1000)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([(i, 0.25) for i in range(0, 4000, 2)], "doc_id long, w double")
    got = {r.doc_id: r.copies for r in mixing.mix_sources(df, weights).collect()}
    light, heavy = (sum(got[i] for i in range(k, 4000, 2)) for k in (0, 1))
    assert heavy > light * 1.1


def test_mixed_rows_decide_each_row(spark):
    rows = [(7, f"{c} " * 10, "a", c) for c in "pqrs"] + [(None, f"{c} " * 10, "a", c) for c in "tuvw"] + [(None, None, None, "x"), (8, "", "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row string")
    weights = spark.createDataFrame([(7, 0.25), (0, 0.1)], "doc_id long, w double")
    out = mixing.mixed_rows(df, weights)
    assert out.columns == df.columns
    got = sorted(map(str, out.collect()))
    assert got == sorted(map(str, mixing.mixed_rows(df, weights).collect()))
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in mixing.mix_sources(df, weights).collect()) == 120
    assert set(got) <= set(map(str, df.collect()))
    assert mixing.mixed_rows(df.limit(0), weights).collect() == []
