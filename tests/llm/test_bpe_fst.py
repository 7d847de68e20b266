import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from quorumlake.llm import bpe_fst as b

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts(n=3000):
    rng = random.Random(4)
    pool = [*map(chr, range(1, 256)), *map(chr, range(0x300, 0x320)), "Σ", "中", "文", "😀", "\u200b", "\u2028", "\u3000", "\x85", "٣", "\x1c"]
    for i in range(n):
        yield "".join(rng.choice(pool) for _ in range(rng.randrange(50))) if i % 2 else "".join(rng.choice("abcdefghij eat'sntING  \n.,!*09") for _ in range(rng.randrange(150)))


def test_equals_library():
    ranks = b.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours, decoder = b.PieceEncoder(PATH, public_tokenizers.PATTERN), b.ByteDecoder({i: t for t, i in ranks.items()})
    for text in [*texts(), "a" * 5000, "ab" * 3000, "<|endoftext|>", " " * 1000 + "x", "é" * 700]:
        ids = np.frombuffer(ours.encode(text), "<u4")
        assert ids.tolist() == library.encode_ordinary(text), repr(text[:80])
        assert decoder.decode(ids) == (text.encode(), True)


def test_states_are_dropped_and_built_anew(monkeypatch):
    monkeypatch.setattr(b.BpeTransducer, "MAX_STATES", 50)
    machine = b.BpeTransducer(b.load_ranks(PATH))
    rng = random.Random(6)
    for _ in range(300):
        piece = "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 25))).encode()
        assert machine.encode(piece) == machine.merge(piece)
    assert len(machine.states) < 100
    long = "".join(rng.choice("etaoinshr") for _ in range(3000)).encode()  # dropped inside a piece as well
    assert machine.encode(long) == machine.merge(long) and len(machine.states) < 50 + machine.WINDOW


def test_small_vocabulary_with_token_that_merges_cannot_make():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 258, b"bc": 257, b"xyz": 259}
    machine = b.BpeTransducer(ranks)
    rng = random.Random(7)
    assert machine.encode(b"xyz") == [259]  # a whole piece is looked up first
    for _ in range(500):
        piece = bytes(rng.choice(b"abcxyz") for _ in range(rng.randrange(2, 14)))
        if piece not in ranks:
            assert machine.encode(piece) == machine.merge(piece), piece


def test_stream_decoder():
    ranks = b.load_ranks(PATH)
    spelling = {i: t for t, i in ranks.items()}
    rng = random.Random(8)
    for _ in range(2000):
        raw = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xC3, 0xE0, 0xA0, 0xED, 0x9F, 0xEF, 0xF0, 0x90, 0xF4, 0x8F, 0xF5, 0xC0]) for _ in range(rng.randrange(12)))
        stream, out = b.StreamDecoder(spelling), []
        for byte in raw:
            out.append(stream.feed([ranks[bytes([byte])]]))
            assert all(len(x) <= 3 for x in out)
        assert "".join(out) + stream.finish() == raw.decode("utf-8", "replace"), raw


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "naïve 😀 text"), (3, "again"), (None, "x"), (5, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    encoded = b.encode_documents(df, PATH, public_tokenizers.PATTERN)
    got = b.decode_digest(encoded, PATH, with_ids=True).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert all(r.n_tokens * 4 == len(r.ids) and r.valid_utf8 for r in got)
    fused = b.round_trip(df, PATH, public_tokenizers.PATTERN, with_ids=True)
    assert sorted(map(str, fused.collect())) == sorted(map(str, got))
    back = b.decode_documents(encoded, PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert b.encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_what_waits_is_bounded():
    ranks = b.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    longest, rng = max(map(len, ranks)), random.Random(9)
    pieces = ["a", "ab", "é", "aaab", "中", "thethe", "ing"]
    pieces = [(x * 20_000)[:20_000].encode() for x in pieces] + ["".join(rng.choice("abcdefghij") for _ in range(n)).encode() for n in (10_000, 20_000)]
    for piece in pieces:
        machine, runs = b.BpeTransducer(ranks), 0
        ids = []
        for run in machine.stream(piece):
            ids += run
            runs += 1
        assert ids == library.encode_ordinary(piece.decode("utf-8", "ignore")), piece[:10]
        assert machine.held <= machine.WINDOW + 2 * longest and runs > len(piece) // 512, (piece[:10], machine.held)


def test_neighbours_equal_merging():
    ranks = b.load_ranks(PATH)
    machine, rng = b.BpeTransducer(ranks), random.Random(10)
    every = list(ranks.values())
    common = [ranks[x] for x in ranks if len(x) < 4 and x.isalpha()]
    for i in range(20_000):
        x, y = (rng.choice(common if i % 2 else every) for _ in range(2))
        if machine.merge(machine.spelling[x]) == [x]:
            assert machine.compatible(x, y) == (machine.merge(machine.spelling[x] + machine.spelling[y]) == [x, y]), (x, y)


def test_blocks_hold_back_unfinished_characters(monkeypatch):
    monkeypatch.setattr(b.ByteDecoder, "BLOCK", 3)
    ranks = b.load_ranks(PATH)
    decoder, rng = b.ByteDecoder({i: t for t, i in ranks.items()}), random.Random(11)
    for _ in range(500):
        text = "".join(rng.choice("aé中😀 ") for _ in range(rng.randrange(20)))
        ids = np.array([ranks[bytes([x])] for x in text.encode()], "<u4")
        found = list(decoder.blocks(ids))
        assert "".join(data.decode() for data, _ in found) == text and all(ok for _, ok in found)
        cut = ids[:-1]
        whole = decoder.decode(cut)
        assert whole[0] == text.encode()[:-1] and whole[1] == (not text or text[-1] in "a ")
    assert decoder.decode(np.array([ranks[b"\x80"], ranks[b"a"]], "<u4")) == (b"\x80a", False)


def test_both_splitters_agree():
    import regex

    assert public_tokenizers.PATTERN == b._USUAL
    ours, theirs, rng = b.PieceEncoder(PATH, public_tokenizers.PATTERN).pieces, regex.compile(public_tokenizers.PATTERN).findall, random.Random(13)
    every = [chr(i) for i in range(1, 0x260)]
    for c in every:
        for text in (c, c + c, f"a{c}b", f" {c}1", f"{c} {c}x", f"1{c}  "):
            assert ours(text) == theirs(text), repr(text)
    for _ in range(5000):
        text = "".join(rng.choice(every) if rng.random() < 0.3 else rng.choice("ab 1'.s\n") for _ in range(rng.randrange(40)))
        assert ours(text) == theirs(text), repr(text)
