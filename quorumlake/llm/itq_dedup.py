"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

*Codes.*  On a bounded sample, principal axes and then a rotation are learned by iterative
quantisation (Gong & Lazebnik, 2011): signs of the rotated sample and the rotation that
brings it nearest to them, in turn.  Directions are balanced by the rotation, and
thresholds are zero because cosine is compared.  Every vector gets 64 bits; what axes there are too few
for, and vectors of other lengths than most, take from seeded rotations.

*Tables.*  A code is cut into p parts; each table is keyed by the label, the length and c of the parts, so any
pair with at most ``p - c = 7`` different bits meets in a table.  (p, c) follow from the number
of vectors, which keeps buckets short: (8, 1), (9, 2) or (10, 3).  A pair is retrieved in the first table where it meets,
if its codes are at most ``RADIUS`` bits apart.

*Rerank.*  Vectors of which a bucket retrieves some pair are sent there, and its retrieved pairs, and
no others, are compared by cosine in double precision.

Equal vectors with equal labels are one class with a multiplicity.  Buckets
of more than ``BLOCK`` rows are cut and their cuts meet in pairs; pairs of rows never
leave a task, only counts of links and the edges of spanning forests.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, partitions
from .graph import connected_components

#: Vectors the rotation is learned from, about; chosen by hash.
SAMPLE = 4000
ROUNDS = 30
BITS = 64
RADIUS = 12
#: Rows of a class that share a row where classes meet their counts, and keys of large buckets that are broadcast at most.
SPREAD, BROADCAST = 64, 200_000
#: Rows of a bucket that are compared at once.
BLOCK = 2048


@dataclass
class ItqModel:
    rotation: np.ndarray  # (dimensions, bits)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, one byte for each bit."""
        return (unit @ self.rotation > 0).astype(np.uint8)


def fit_rotation(sample: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> ItqModel:
    """Axes and rotation from unit vectors; a seeded rotation if there are too few; seeded rotations more where there are under ``BITS`` axes."""
    d = sample.shape[1]
    bits, rng = min(d, BITS), np.random.default_rng(seed)
    r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    axes = np.eye(d)[:, :bits] if len(sample) >= 2 * d else np.linalg.qr(rng.normal(size=(d, bits)))[0]
    if len(sample) >= 2 * d:
        axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :bits]
        v = sample @ axes
        for _ in range(rounds):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, wt = np.linalg.svd(v.T @ b)
            r = u @ wt
    planes = [axes @ r]
    while sum(x.shape[1] for x in planes) < BITS:
        planes.append(np.linalg.qr(rng.normal(size=(d, d)))[0])
    return ItqModel(np.concatenate(planes, 1)[:, :BITS])


@functools.lru_cache(64)
def seeded_rotation(width: int) -> ItqModel:
    """For lengths that nothing is learned for."""
    return fit_rotation(np.empty((0, width)))


def unit_rows(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors as doubles, whether each is usable): not null, of the width, finite throughout, not zero."""
    ok = np.array([v is not None and len(v) == width and width > 0 and None not in v for v in vectors], bool)
    x = np.zeros((len(vectors), width))
    for i in np.flatnonzero(ok):
        x[i] = vectors[i]
    ok &= np.isfinite(x).all(1)
    x[~ok] = 0
    top = np.abs(x).max(1, initial=0, keepdims=True)
    x = np.divide(x, top, out=np.zeros_like(x), where=top > 0)  # squares neither overflow nor vanish
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    ok &= norm[:, 0] > 0
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0), ok


def tables_for(n: int) -> tuple[int, int]:
    """(parts, parts in a key) for so many vectors."""
    return (8, 1) if n <= 1_000_000 else (9, 2) if n <= 100_000_000 else (10, 3)


def table_keys(codes: np.ndarray, parts: int, chosen: int) -> np.ndarray:
    """(rows, tables): the hashed key of each code in each table."""
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    cut = [np.flatnonzero(np.arange(codes.shape[1]) * parts // codes.shape[1] == p) for p in range(parts)]
    value = np.stack([(codes[:, c] * weights[: len(c)]).sum(1, dtype=np.uint64) for c in cut], 1)
    keys = []
    for t, some in enumerate(combinations(range(parts), chosen)):
        key = np.full(len(codes), t + 1, np.uint64)
        for p in some:
            key = mix64(key + value[:, p])
        keys.append(key)
    return np.stack(keys, 1).view(np.int64)


# ---------------------------------------------------------------- stages on executors


def _facts(batches: Iterator[pa.RecordBatch], width: int, model: ItqModel, parts: int, chosen: int) -> Iterator[pa.RecordBatch]:
    """Usable rows (vec_id, label, vector), by length: digest of the vector, code, keys and vector as doubles of length one."""
    for batch in batches:
        vectors = batch.column(2).to_pylist()
        named = [x is not None and i is not None for x, i in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
        of_length: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            if v and named[i]:
                of_length.setdefault(len(v), []).append(i)
        for length, at in of_length.items():
            unit, ok = unit_rows([vectors[i] for i in at], length)
            unit = unit[ok] + 0.0
            codes = (model if length == width else seeded_rotation(length)).codes(unit)
            rows = pa.array(np.array(at, np.int64)[ok], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array([length] * len(unit), pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(u.tobytes()) for u in unit], pa.binary()),
                    pa.array([c.tobytes() for c in np.packbits(codes, axis=1)], pa.binary()),
                    pa.array(list(table_keys(codes, parts, chosen)), pa.list_(pa.int64())),
                    pa.array([u.tobytes() for u in unit], pa.binary()),
                ],
                ["vec_id", "label", "width", "digest", "code", "keys", "unit"],
            )


FACTS = "vec_id long, label long, width int, digest binary, code binary, keys array<long>, unit binary"


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a bipartite relation between two lists of ids."""
    rows, cols = near.any(1), near.any(0)
    near, left, right = near[rows][:, cols], left[rows], right[cols]
    if not len(left):
        return []
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:  # least id spreads until nothing changes
        b2 = np.minimum(b, np.where(near, a[:, None], top).min(0))
        a2 = np.minimum(a, np.where(near, b2[None, :], top).min(1))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    pairs = np.concatenate([np.stack([left, a], 1), np.stack([right, b], 1)])
    return [tuple(p) for p in np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0).tolist()]


def _cuts(rows: DataFrame, salt: str, scratch: Scratch) -> DataFrame:
    """Rows with a task ``k, i, j`` and side: a key's rows go to one task, or, if there are more than
    ``BLOCK``, to a task for each pair of their cuts."""
    big = scratch.save(rows.groupBy("k").count().where(F.col("count") > BLOCK).select("k", F.ceil(F.col("count") / BLOCK).cast("int").alias("cuts")), "big")
    sized = rows.join(F.broadcast(big) if big.count() <= BROADCAST else big, "k", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64(salt, F.lit("cut")), F.col("cuts")).cast("int")
    sized = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return sized.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "cuts")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows sorted by (k, i, j), group by group."""
    task, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["k"], row["i"], row["j"])
            if now != task:
                if rows:
                    yield task, rows
                task, rows = now, []
            rows.append(row)
    if rows:
        yield task, rows


def _sides(task: tuple, rows: list[dict]) -> tuple[list[dict], list[dict]]:
    _, i, j = task
    return [r for r in rows if r["own"] == i], [r for r in rows if r["own"] == j]


def _ids(rows: list[dict]) -> np.ndarray:
    return np.array([r["vec_id"] for r in rows], np.int64)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], ["a", "b"])


class Retrieval:
    """Which pairs of a bucket of table t are retrieved there: codes near, and no table before t where they meet."""

    def __init__(self, parts: int, chosen: int):
        of_part = np.arange(BITS) * parts // BITS
        self.masks = [np.uint64(sum(1 << BITS - 1 - int(b) for b in np.flatnonzero(of_part == p))) for p in range(parts)]
        self.first = np.full(1 << parts, -1, np.int16)  # the first table of pairs that agree in a set of parts
        tables = [sum(1 << p for p in some) for some in combinations(range(parts), chosen)]
        for agree in range(1 << parts):
            self.first[agree] = next((t for t, need in enumerate(tables) if agree & need == need), -1)

    def pairs(self, table: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = a[:, None] ^ b[None, :]
        agree = np.zeros(apart.shape, np.int16)
        for p, mask in enumerate(self.masks):
            agree |= ((apart & mask) == 0).astype(np.int16) << p
        return (np.bitwise_count(apart) <= RADIUS) & (self.first[agree] == table)


def _codes(rows: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["code"] for r in rows), ">u8").astype(np.uint64)


CANDIDATE = "k long, i int, j int, own int, t int, vec_id long, code binary"


def _retrieved(batches: Iterator[pa.RecordBatch], scheme: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The rows of each task that are in a retrieved pair."""
    choice, names = Retrieval(*scheme), [x.split()[0] for x in CANDIDATE.split(", ")]
    for task, rows in _grouped(batches):
        left, right = _sides(task, rows)
        if len(rows) < 2 or not left or not right:
            continue
        a, b, ia, ib = _codes(left), _codes(right), _ids(left), _ids(right)
        hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for at in range(0, len(a), 512):
            found = choice.pairs(rows[0]["t"], a[at : at + 512], b) & (ia[at : at + 512, None] != ib[None, :])
            hit_a[at : at + 512] |= found.any(1)
            hit_b |= found.any(0)
        kept = [r for r, hit in zip(left, hit_a, strict=True) if hit]
        if task[1] != task[2]:
            kept += [r for r, hit in zip(right, hit_b, strict=True) if hit]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in kept], t) for x, t in zip(names, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names)


def _rerank(batches: Iterator[pa.RecordBatch], scheme: tuple[int, int], cosine: float) -> Iterator[pa.RecordBatch]:
    """(vec_id, links, to): links counted in this task, or, with ``to``, an edge."""
    choice = Retrieval(*scheme)
    for task, rows in _grouped(batches):
        left, right = _sides(task, rows)
        if len(rows) < 2 or not left or not right:
            continue
        a, b = (np.frombuffer(b"".join(r["unit"] for r in side), np.float64).reshape(len(side), -1) for side in (left, right))
        ia, ib, codes_a, codes_b = _ids(left), _ids(right), _codes(left), _codes(right)
        na, nb = (np.array([r["copies"] for r in side], np.int64) for side in (left, right))
        ca, cb, edges = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), []
        for at in range(0, len(a), 512):
            part = slice(at, at + 512)
            linked = (a[part] @ b.T >= cosine) & (ia[part, None] != ib[None, :])
            linked &= choice.pairs(rows[0]["t"], codes_a[part], codes_b)
            ca[part] += linked @ nb
            if task[1] != task[2]:
                cb += na[part] @ linked
            edges += _forest(linked, ia[part], ib)
        ids, counts = (np.r_[ia, ib], np.r_[ca, cb]) if task[1] != task[2] else (ia, ca)
        some = counts > 0
        ids, counts = ids[some].tolist(), counts[some].tolist()
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids + [x for x, _ in edges], pa.int64()), pa.array(counts + [0] * len(edges), pa.int64()), pa.array([None] * len(ids) + [y for _, y in edges], pa.int64())],
                ["vec_id", "links", "to"],
            )


# ---------------------------------------------------------------- the operator


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors link when their labels are equal and not null, their lengths are equal, and their cosine is at least
    ``cosine``.  A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing, as does a row with a null label or id.
    ``n_links`` counts the other vectors linked directly, ``component_id`` is
    the smallest id that links reach, ``kept`` whether it is the row's own.
    Rows with equal ids are one node of the link graph and show its sum of links.
    An empty table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    n = v.count()
    chance = F.pmod(F.xxhash64("vec_id", F.lit("itq")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    sample = [r.vector for r in v.where(F.size("vector") > 0).where(chance).select("vector").limit(2 * SAMPLE).collect()]
    widths = [len(x) for x in sample]
    width = max(sorted(set(widths)), key=widths.count) if widths else 0  # the rotation is learned for the commonest length
    unit, ok = unit_rows(sample, width)
    model, scheme = fit_rotation(unit[ok]) if width else None, tables_for(n)

    spread = F.pmod(F.xxhash64("vec_id", F.lit("spread")), F.lit(SPREAD)).cast("int").alias("spread")
    facts = scratch.save(v.mapInArrow(lambda it: _facts(it, width, model, *scheme), FACTS).select("*", spread), "facts")
    parts = scratch.save(facts.groupBy("label", "digest", "spread").agg(F.min("vec_id").alias("lead"), F.count("*").alias("copies")), "parts")
    classes = parts.groupBy("label", "digest").agg(F.min("lead").alias("lead"), F.sum("copies").alias("copies"))
    classes = scratch.save(classes, "classes")
    parts = parts.select("label", "digest", "spread").join(classes, ["label", "digest"])  # SPREAD rows of a class at most
    firsts = facts.join(classes.select("label", "digest", F.col("lead").alias("vec_id"), "copies"), ["label", "digest", "vec_id"]).dropDuplicates(["label", "digest"])
    leads = scratch.save(firsts.select("vec_id", "label", "width", "copies", "code", "keys", "unit"), "leads")
    coded = leads.select("vec_id", "label", "width", "code", F.posexplode("keys").alias("t", "key"))
    buckets = _cuts(coded.select(F.xxhash64("label", "width", "t", "key").alias("k"), "t", "vec_id", "code"), "vec_id", scratch).select("k", "i", "j", "own", "t", "vec_id", "code")
    dealt = lambda rows: rows.repartition(partitions(spark), "k", "i", "j").sortWithinPartitions("k", "i", "j")
    near = scratch.save(dealt(buckets).mapInArrow(lambda it: _retrieved(it, scheme), CANDIDATE), "near")
    shipped = near.join(leads.select("vec_id", "copies", "unit"), "vec_id").select("k", "i", "j", "own", "t", "vec_id", "code", "copies", "unit")
    found = scratch.save(dealt(shipped).mapInArrow(lambda it: _rerank(it, scheme, cosine), "vec_id long, links long, to long"), "found")

    counts = found.where("to is null").groupBy(F.col("vec_id").alias("lead")).agg(F.sum("links").alias("links"))
    parts = parts.join(counts, "lead", "left").select("label", "digest", "spread", "lead", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    members = scratch.save(facts.select("vec_id", "label", "digest", "spread").join(parts, ["label", "digest", "spread"]).select("vec_id", "lead", "links"), "members")
    copies = members.where("vec_id <> lead").select(F.col("vec_id").alias("a"), F.col("lead").alias("b"))
    linked = connected_components(found.where("to is not null").select(F.col("vec_id").alias("a"), F.col("to").alias("b")).union(copies), scratch, "links")
    totals = members.groupBy("vec_id").agg(F.sum("links").alias("links"))
    out = v.select("vec_id").join(totals, "vec_id", "left").join(linked.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
