import random

import numpy as np
import pytest

from quorumlake.llm import license_scan as s
from quorumlake.llm.common import WordHashes, shingle_hashes


def test_bands_guarantee():
    worst = s.CONTAINED / (2.25 - s.CONTAINED)
    assert s.collision_probability(worst) > 0.999


def brute(index, text, wide):
    """Templates with enough shingles in some window, or in one with a step on either side."""
    words = s.license_words(text)
    if len(words) < s.K:
        return set()
    shingles = shingle_hashes(WordHashes().of(words), s.K)
    found = set()
    for t, wanted in enumerate(index.sets):
        step = -(-len(wanted) // 4)
        for start in range(0, len(shingles), step):
            around = shingles[max(0, start - step * wide) : start + len(wanted) + step * (1 + wide)]
            if len(np.intersect1d(around, wanted)) / len(wanted) >= s.CONTAINED:
                found.add(t)
    return found


def test_equals_brute_force(spark):
    rng, rows = random.Random(1), []
    for i in range(250):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 3, 30, 300]))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(s.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                notice[rng.randrange(len(notice))] = "edited"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        text = rng.choice([" ", "\n"]).join(words)
        rows.append((i, rng.choice([text, text.upper()]), "c"))
    rows += [(1000, None, "c"), (1001, "", "c"), (1002, "Licensed under", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    index = s.TemplateIndex(s.TEMPLATES)
    got = {}
    for r in s.scan_licenses(df).collect():
        got.setdefault(r.doc_id, set()).add(r.template)
        assert r.containment >= s.CONTAINED and r.first_word < r.end_word
    for i, text, _ in rows:
        assert brute(index, text, 0) <= got.get(i, set()) <= brute(index, text, 1)
    assert sum(map(len, got.values())) > 100


def test_spans_and_odd_rows(spark):
    line = "Licensed under the Apache License, Version 2.0."
    rows = [(1, "some words before " + line + " and after"), (1, line), (None, line), (2, "x " * 50_000 + line)]
    got = s.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license, r.first_word, r.end_word) for r in got) == [("1", "Apache-2.0", 0, 7), ("1", "Apache-2.0", 3, 10), ("2", "Apache-2.0", 50_000, 50_007), ("None", "Apache-2.0", 0, 7)]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert s.scan_licenses(df).collect() == []
    assert s.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), []).collect() == []
    with pytest.raises(ValueError):
        s.TemplateIndex([("short", "MIT License")])


def test_every_occurrence(spark):
    line, long = "Licensed under the Apache License, Version 2.0.", s.TEMPLATES[2][1]
    n = len(s.license_words(long))
    rows = [(1, " ".join([line, "a b c", line, line])), (2, "x " * 1000 + f"{long} {long} " + "y " * 500 + long)]
    got = sorted((r.doc_id, r.template, r.first_word, r.end_word) for r in s.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, a, a + 7) for a in (0, 10, 17)] + [(2, 2, a, a + n) for a in (1000, 1000 + n, 1500 + 2 * n)]


def test_bands_alone_retrieve_edited_licences():
    """Recall of the bands, without any exact look-up: whole licences of which a little over ``CONTAINED`` is left."""
    rng, index = random.Random(5), s.TemplateIndex(s.TEMPLATES)
    long = [t for t in range(len(s.TEMPLATES)) if len(index.sets[t]) > 100]
    assert len(long) >= 3
    met = tried = 0
    for _ in range(120):
        t = rng.choice(long)
        words = s.license_words(s.TEMPLATES[t][1])
        while True:  # each edit takes up to five shingles
            edited = list(words)
            edited[rng.randrange(len(edited))] = f"x{rng.random()}"
            shingles = shingle_hashes(WordHashes().of(edited), s.K)
            if len(np.intersect1d(shingles, index.sets[t])) < s.CONTAINED * len(index.sets[t]):
                break
            words = edited
        noise = [f"n{rng.randrange(10**6)}" for _ in range(600)]
        at = rng.randrange(200)
        shingles = shingle_hashes(WordHashes().of(noise[:at] + words + noise[at:]), s.K)
        size = len(index.sets[t])
        step = -(-size // 4)
        bands = index.sizes[size]
        met += any(t in bands.get(key, ()) for start in range(0, len(shingles), step) for key in s.band_keys(shingles[start : start + size + step]))
        tried += 1
        assert t in {x[0] for x in index.scan(shingles)}
    assert met == tried
