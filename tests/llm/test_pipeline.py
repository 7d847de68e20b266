import random
from collections import Counter
from itertools import combinations

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quorumlake.llm import bpe_fst, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, root = random.Random(11), tmp_path_factory.mktemp("sf")
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(250).collect()
    rows = [tuple(r) for r in source]
    for i in range(60):
        words = rng.choice(source).text.split(" ")
        words[rng.randrange(len(words))] = "edited"
        rows.append((5000 + i, " ".join(words), "en", "copies", 1))
    rows += [(6000, None, "en", "s", 0), (6001, "", None, None, 0), (6002, "123 456", "en", None, None), (6003, rows[0][1], None, None, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{root}/labels.parquet")
    return str(root)


def shingles(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def test_each_stage_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near duplicates", "mix", "encode"]

    good = steps["quality"](spark, docs, folder)
    assert good.columns == docs.columns
    scored = {r.doc_id: r.predicted for r in queries.op6_quality(spark, folder).collect()}
    kept = {r.doc_id for r in good.collect()}
    assert kept == {i for i in rows if scored[i]}

    spoken = steps["language"](spark, good, folder)
    kept2 = {r.doc_id for r in spoken.collect()}
    assert kept2 <= {i for i in kept if any(c.isalpha() for c in rows[i].text or "")}
    assert len(kept2) >= len(kept) - 4

    single = steps["near duplicates"](spark, spoken, folder)
    sets = {i: shingles(rows[i].text) for i in kept2}
    up = {i: i for i in kept2}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    kept3 = {r.doc_id for r in single.collect()}
    assert kept3 == {i for i in kept2 if root(i) == i} and len(kept3) < len(kept2)

    mixed = steps["mix"](spark, single, folder)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= kept3 and max(copies.values()) <= 2
    words = lambda i: len((rows[i].text or "").split())
    total = sum(map(words, kept3))
    assert abs(sum(words(i) * n for i, n in copies.items()) - 1.5 * total) < 0.2 * total

    ranks = bpe_fst.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in final) == copies
    assert all(r.n_tokens == len(library.encode_ordinary(rows[r.doc_id].text)) for r in final)
