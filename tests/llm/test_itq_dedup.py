import math

import numpy as np
import pytest

from quorumlake.llm import itq_dedup as q


def brute(rows, cosine=0.98):
    ok = []
    for i, v, label in rows:
        x = None if v is None or label is None or None in v or len(v) != 64 else np.array(v, float)
        ok.append(x if x is not None and np.isfinite(x).all() and (x != 0).any() else None)
    up, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] is not None and ok[b] is not None and rows[a][2] == rows[b][2]:
                x, y = ok[a] / np.abs(ok[a]).max(), ok[b] / np.abs(ok[b]).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine - 1e-12:
                    links[rows[a][0]] += 1
                    links[rows[b][0]] += 1
                    s, t = root(rows[a][0]), root(rows[b][0])
                    up[max(s, t)] = min(s, t)
    return {i: (links[i], root(i)) for i in links}


def vectors(seed):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(60):
        base = rng.normal(size=64)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (base + rng.normal(size=64) * rng.choice([0, 0.02, 0.1])).astype(np.float32).astype(float).tolist(), int(rng.integers(0, 2))))
    odd = [None, [0.0] * 64, [math.nan] + [1.0] * 63, [math.inf] * 64, [None] + [1.0] * 63, [1.0] * 3, []]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(2000, rows[0][1], None), (2001, rows[0][1], rows[0][2]), (2002, [x * 3 for x in rows[0][1]], rows[0][2]), (2003, [x * 1e30 for x in rows[0][1]], rows[0][2])]
    return rows


@pytest.mark.parametrize("block", [2048, 5])
def test_links_are_right_and_recall_is_high(spark, monkeypatch, block):
    monkeypatch.setattr(q, "BLOCK", block)
    rows = vectors(block)
    df = spark.createDataFrame([(*r, True) for r in rows], "vec_id long, embedding array<double>, label int, kept boolean")
    got = {r.vec_id: r for r in q.near_duplicates(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(got[i].n_links <= want[i][0] and got[i].kept == (got[i].component_id == i) for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert sum(got[i].component_id == want[i][1] for i in want) >= 0.95 * len(want)
    assert got[2001].component_id == 0 and got[2000].n_links == 0


def test_tables_meet(monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2, (200, 64)).astype(np.uint8)
    b = a.copy()
    for row in b:
        row[rng.permutation(64)[:7]] ^= 1
    for n in (10, 10**7, 10**9):
        parts, chosen = q.tables_for(n)
        assert (q.table_keys(a, parts, chosen) == q.table_keys(b, parts, chosen)).any(1).all()


@pytest.mark.parametrize("scheme", [(8, 1), (9, 2), (10, 3)])
@pytest.mark.parametrize("cosine", [0.98, 0.985])
def test_recall_of_pairs_at_the_threshold(spark, monkeypatch, scheme, cosine):
    monkeypatch.setattr(q, "tables_for", lambda n: scheme)
    rng, rows = np.random.default_rng(17), []
    for i in range(1500):  # isolated pairs a little above the cosine
        x, y = rng.normal(size=64), rng.normal(size=64)
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = cosine + 1e-9
        rows += [(2 * i, x.tolist(), i % 3), (2 * i + 1, (c * x + (1 - c * c) ** 0.5 * y).tolist(), i % 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in q.near_duplicates(df).collect()}
    assert all(n <= 1 for n in got.values())
    assert sum(got.values()) >= 0.98 * len(rows)


def test_lengths_are_groups_of_their_own(spark):
    rng = np.random.default_rng(4)
    rows = []
    for length, times in ((64, 40), (3, 6), (5, 6), (130, 6), (1, 3)):
        for _ in range(times):
            base = rng.normal(size=length)
            rows += [(len(rows) + x, (base * (x + 1)).tolist(), 1) for x in range(2)]
    rows = [(i, v, c) for i, (_, v, c) in enumerate(rows)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in q.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for i, v, _ in rows:
        equal = [j for j, w, _ in rows if len(w) == len(v) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98]
        assert got[i] == (len(equal) - 1, equal[0]), (i, len(v))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert q.near_duplicates(df).collect() == []
    df = spark.createDataFrame([(1, None, 1), (1, None, None)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in q.near_duplicates(df).collect()] == [(1, 0, 1, True)] * 2
