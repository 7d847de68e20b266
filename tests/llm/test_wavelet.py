import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quorumlake.llm import wavelet as w
from quorumlake.llm.common import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_shard_queries_equal_counting(monkeypatch):
    monkeypatch.setattr(w, "CHUNK_BITS", 128)
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 127, 128, 129, 1500):
        ids = rng.choice([0, 1, 7, 500, 49407], n, p=[0.5, 0.2, 0.1, 0.1, 0.1]).astype(np.uint16)
        starts = sorted({0, n // 3, n})
        shard = w.WaveletShard(w.build(ids, range(len(starts) - 1), starts))
        assert shard.decode().tolist() == ids.tolist()
        assert [shard.access(i) for i in range(n)] == ids.tolist()
        for token in (0, 1, 7, 500, 49407, 3, 70_000, -1):
            at = np.flatnonzero(ids == token)
            assert shard.count(token) == len(at)
            assert shard.occurrences(token) == at.tolist()
            assert shard.select(token, len(at)) == -1
            for i in (0, n // 2, n):
                assert shard.rank(token, i) == (ids[:i] == token).sum()
                assert shard.count(token, i // 2, i) == (ids[i // 2 : i] == token).sum()
        for k in range(len(starts) - 1):
            assert shard.document(k).tolist() == ids[starts[k] : starts[k + 1]].tolist()


def test_encoder_equals_library():
    library, ours = Tokenizer.from_file(PATH), w.WordEncoder(PATH)
    rng = random.Random(2)
    pool = [*map(chr, range(1, 400)), *map(chr, range(0x300, 0x340)), "Σ", "ς", "İ", "K", "中", "😀", " ", "　", "<|endoftext|>", "<|ENDOFTEXT|>", "..", ". ", ", ", ",.", "'s", "'T"]
    for i in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(30))) if i % 2 else "".join(rng.choice("abcdefgh sEt'nàÉé  \n.,!\"") for _ in range(rng.randrange(90)))
        assert ours.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_shards_hold_all_documents(spark, monkeypatch):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "Cat", "sat.", '"', "xyzzy"]) for _ in range(rng.randrange(200))), 5) for i in rng.sample(range(10_000), 300)]
    rows += [(20_000, None, 1), (20_001, "", 2), (None, "lost id", 3), (20_002, "long " * 40_000, 4), (20_003, "twice", 0), (20_003, "twice", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    scratch = Scratch(spark)
    shards = w.write_shards(df, PATH, scratch)
    got = sorted(w.shard_documents(shards).collect(), key=lambda r: r.start)
    start, want = 0, []
    for i, text, _ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert w.shard_documents(w.write_shards(df.limit(0), PATH, scratch, name="none")).collect() == []


def test_files_stay_in_their_folder(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words here " * i) for i in range(40)], "doc_id long, text string")
    listed = w.write_shards(df, PATH, Scratch(spark), folder=f"file://{tmp_path}/corpus")
    files = sorted(p.name for p in (tmp_path / "corpus" / "files").iterdir() if not p.name.endswith(".crc"))
    assert files == sorted(r.file.rsplit("/", 1)[1] for r in listed.collect()) and all(x.endswith(".qwm") for x in files)
    library = Tokenizer.from_file(PATH)
    for r in listed.collect():
        shard = w.open_shard(r.file)
        assert (shard.n, shard.n_docs) == (r.n_tokens, r.n_docs) and shard.count(w.END_ID) == r.n_docs
        for k, i in enumerate(shard.doc_ids.tolist()):
            assert shard.document(k).tolist() == [*library.encode("some words here " * i, add_special_tokens=False).ids, 1]


def test_other_tokenizers_get_whole_texts(tmp_path):
    plain = Tokenizer.from_file(PATH)
    plain.normalizer = None
    plain.save(f"{tmp_path}/cased.json")
    ours = w.WordEncoder(f"{tmp_path}/cased.json")
    assert not ours.by_runs and w.WordEncoder(PATH).by_runs
    for text in ("Some Words, here", "x  y", "", None):
        assert ours.encode(text).tolist() == plain.encode(text or "", add_special_tokens=False).ids
