"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

A document's set holds the 64-bit hashes of its distinct k-word shingles.  Two
documents link when ``100 * |r & s| >= percent * |r | s|``, |r & s| > 0.

1. *Survey, exact.*  In the order of their hashes, a set of n elements sends its first
   ``n - T + l`` ones, where ``T = ceil(percent * n / 100)`` is the least overlap with any partner.  Two sets
   that overlap in T elements share l of the ones they send, so a document of whose elements sent
   fewer than l are in another document too is linked with nothing and leaves the search.
   What is shared inside a batch is settled there; other elements are dealt by hash to buckets of a
   bounded size, twelve bytes each.
2. *Blocking, exact.*  |r| <= |s| that link differ in at most
   ``H = (100 - percent) * (|r| + |s|) / (100 + percent)`` elements.  Deal all
   elements by hash into ``k = H + 1 + spare`` parts: at least ``1 + spare`` parts
   are equal in both.  Parts of under two elements (under one, where two would ask for
   too many parts) are weak; a document with at
   most ``spare`` weak parts sends a signature for each strong part only, since
   one equal part must then be strong; any other document sends all its parts.
   ``k`` and ``spare`` follow from a band of set sizes alone, and a document also
   sends signatures for the next band if a partner may be there, so no link is
   lost.  Shingles that very many documents share are left out of the parts, which keeps
   unlike documents with a common passage apart.  Equal signatures make blocks; blocks that share documents are merged.
3. *T-occurrence search.*  Inside a merged block an inverted list per shingle
   names the documents holding it.  A query needs ``T`` occurrences at least.  Lists that name the query
   alone can't bring it any; if fewer than T others are left, it ends there.  DivideSkip sets the L longest lists aside, merges
   the short ones on a heap that skips ahead to documents which can still reach
   ``T - L``, and probes the long ones by binary search.  The exact overlap
   and union decide.
4. Queries run only for documents that no search has yet put in the component of
   the block's leader: a component needs no second proof.  Blocks of more than
   ``BLOCK`` set elements are blocked anew by what is hot among their documents; those
   still too large are cut by bands of set sizes and hash; members that are not in the block's largest component after
   that query the cuts of the bands in which partners can be.

Documents with equal sets are one class, and the one of least id stands for it from step 2 on.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, ascii_words, give_back, mix64, partitions, shingle_hashes, slices
from .graph import connected_components

#: Set elements that one search holds at once.
BLOCK = 2_000_000
#: Ratio of neighbouring bands of set sizes and how many deviations of weak parts are spared: narrow bands ask for more
#: signatures, but can do with parts of two elements, which unlike documents hardly share.
WIDE, NARROW = (1.5, 5.0), (1.1, 2.5)


# ---------------------------------------------------------------- sets and parts


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; empty without words."""
    return np.unique(shingle_hashes(hashes.of(ascii_words(text)), k))


def band_of(n: int, ratio: float) -> int:
    return int(math.log(n) / math.log(ratio) + 1e-9)


def scheme(band: int, percent: int, bands: tuple[float, float] = WIDE) -> tuple[int, int, int]:
    """(parts, spare, strong) of a band: enough parts that ``1 + spare`` are equal in any linked pair
    whose larger set lies in the band; parts of ``strong`` elements or more aren't weak."""
    ratio, deviations = bands
    lo, hi = max(1, math.floor(ratio**band)), math.floor(ratio ** (band + 1)) + 1
    differ = (100 - percent) * 2 * hi // (100 + percent)
    for strong in (2, 1):
        spare = 0
        for _ in range(40):
            k = differ + 1 + spare
            mean = lo / k
            weak = k * math.exp(-mean) * (1 + mean if strong == 2 else 1)
            wanted = math.ceil(weak + deviations * math.sqrt(weak) + 1)
            if wanted <= spare or spare > differ + 1:
                break
            spare = wanted
        if spare <= differ + 1:  # else parts would be so small that most are weak
            break
    return differ + 1 + spare, spare, strong


def signatures(values: np.ndarray, percent: int, schemes: dict[int, tuple[int, int, int]], hot: np.ndarray, bands: tuple[float, float] = WIDE) -> np.ndarray:
    """Signatures of a set under its own band's scheme and, if a partner may be there, the next's.

    Parts are made of the elements that aren't hot: taking the same elements out of two sets brings them
    no further apart.  A set with too many weak parts sends those of all its elements as well;
    if those are weak too, the weak and empty ones also.
    """
    n = len(values)
    own, out = band_of(n, bands[0]), []
    bare = values[~found_in(hot, values)]
    for band in range(own, band_of(max(n, n * 100 // percent + 1), bands[0]) + 1):
        if band not in schemes:
            schemes[band] = scheme(band, percent, bands)
        parts, spare, least = schemes[band]
        for tag, elements in ((0, bare), (1, values)):
            scattered = mix64(elements)
            part = (scattered >> np.uint64(32)).astype(np.int64) * parts >> 32
            order = np.argsort(part, kind="stable")
            counts = np.bincount(part, minlength=parts)
            which = np.flatnonzero(counts)
            # sums of scrambled elements name a part's content; part, band and tag are mixed in
            sums = np.add.reduceat(mix64(scattered[order] + np.uint64(2 * band + tag + 1)), np.r_[0, np.cumsum(counts[which])[:-1]]) if len(which) else np.empty(0, np.uint64)
            enough = (counts < least).sum() <= spare
            if enough or not tag:
                strong = counts[which] >= least
                which, sums = which[strong], sums[strong]
            else:
                empty = np.flatnonzero(counts == 0)
                which, sums = np.r_[which, empty], np.r_[sums, np.zeros(len(empty), np.uint64)]
            out.append(mix64(mix64(sums + which.astype(np.uint64)) + np.uint64(0x1F123BB5) * np.uint64(2 * band + tag + 1)))
            if enough:
                break
    return np.concatenate(out)


def found_in(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


# ---------------------------------------------------------------- T-occurrence


#: Occurrences of each member in a query's short lists, on average, from which they are merged by counting.
DENSE = 4
#: Candidates known to be in the leader's component that are probed before all others.
LIKELIEST = 64


class InvertedIndex:
    """Lists of members by shingle, over the sets of one block."""

    #: Weighs the cost of probing against merging when lists are divided.
    MU = 0.0085

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        values, self.members = values[order], owner[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
        self.keys, self.starts = values[first], first
        self.ends = np.r_[first[1:], len(values)] if len(values) else first

    def hopeful(self, percent: int) -> np.ndarray:
        """Members that share as many elements with all others together as a link with one of them takes."""
        lengths = self.ends - self.starts
        shared = np.bincount(self.members[np.repeat(lengths > 1, lengths)], minlength=len(self.sizes))
        return shared >= np.maximum(1, -(-percent * self.sizes // 100))

    def search(self, query: np.ndarray, percent: int, member: bool = False, joined: np.ndarray | None = None) -> np.ndarray:
        """Members that link with the query, ascending; whether a query that is a ``member`` finds itself is open.

        If one of the likeliest of the ``joined`` members links, it is all that comes back."""
        at = np.searchsorted(self.keys, query)
        inside = at < len(self.keys)
        at, asked = at[inside], query[inside]
        at = at[self.keys[at] == asked]
        need = max(1, -(-percent * len(query) // 100))  # no member with fewer in common can link
        if len(at) < need:
            return np.empty(0, np.int64)
        starts, ends = self.starts[at], self.ends[at]
        lengths = ends - starts
        if member:  # lists that name the query alone bring no one else
            others = lengths > 1
            starts, ends, lengths = starts[others], ends[others], lengths[others]
            if len(lengths) < need:
                return np.empty(0, np.int64)
        order = np.argsort(-lengths, kind="stable")
        spans = list(zip(lengths[order].tolist(), starts[order].tolist(), ends[order].tolist(), strict=True))
        longest = spans[0][0]
        apart = min(int(need / (self.MU * math.log2(longest + 1) + 1)), need - 1) if longest > 1 else need - 1
        long, short = spans[:apart], spans[apart:]
        found = self._merge_skip([(s, e) for _, s, e in short], need - apart)
        if not found:
            return np.empty(0, np.int64)
        who = np.array([m for m, _ in found], np.int64)
        overlap = np.array([n for _, n in found], np.int64)
        if joined is not None:
            near = np.flatnonzero(joined[who])
            near = np.sort(near[np.argsort(-overlap[near], kind="stable")[:LIKELIEST]])
            if 2 * len(near) < len(who) and len(hit := self._probe(len(query), who[near], overlap[near], long, need, percent)):
                return hit[:1]
        return self._probe(len(query), who, overlap, long, need, percent)

    def _probe(self, size: int, who: np.ndarray, overlap: np.ndarray, long: list[tuple[int, int, int]], need: int, percent: int) -> np.ndarray:
        """Of the candidates, those that link with a query of that size once the long lists are probed."""
        for done, (_, s, e) in enumerate(long):
            alive = overlap + (len(long) - done) >= need
            if not alive.all():
                who, overlap = who[alive], overlap[alive]
                if not len(who):
                    return who
            run = self.members[s:e]
            place = np.minimum(np.searchsorted(run, who), len(run) - 1)
            overlap = overlap + (run[place] == who)
        union = size + self.sizes[who] - overlap
        return who[(overlap > 0) & (100 * overlap >= percent * union)]

    def _merge_skip(self, lists: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
        """(member, occurrences) for members in at least ``least`` of the lists.  Where the lists are so dense
        that the heap has next to nothing to skip, they are merged by counting."""
        members, found = self.members, []
        if sum(e - s for s, e in lists) > DENSE * len(self.sizes):
            times = np.bincount(np.concatenate([members[s:e] for s, e in lists]), minlength=len(self.sizes))
            who = np.flatnonzero(times >= least)
            return list(zip(who.tolist(), times[who].tolist(), strict=True))
        heap = [(int(members[s]), s, e) for s, e in lists]
        heapq.heapify(heap)
        while len(heap) >= least:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heapq.heappop(heap))
            if len(popped) >= least:
                found.append((top, len(popped)))
                for _, s, e in popped:
                    if s + 1 < e:
                        heapq.heappush(heap, (int(members[s + 1]), s + 1, e))
                continue
            while heap and len(popped) < least - 1:  # nothing up to the next value can reach it
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = heap[0][0]
            for _, s, e in popped:
                s += int(np.searchsorted(members[s:e], target))
                if s < e:
                    heapq.heappush(heap, (int(members[s]), s, e))
        return found


class Forest:
    """Union-find over positions; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def block_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of one block."""
    index, forest, links = InvertedIndex(sets), Forest(len(ids)), []
    hopeful = index.hopeful(percent)
    if not hopeful.any():
        return links
    searched, joined = ~hopeful, np.zeros(len(ids), bool)

    def query(i: int) -> None:
        # once it holds most members, one link into the leader's component is enough: others make queries of their own
        searched[i] = True
        found = index.search(sets[i], percent, member=True, joined=joined if 10 * joined.sum() > 7 * len(ids) else None)
        for j in found.tolist():
            if forest.join(i, j):
                links.append((ids[i], ids[j]))
        if forest.root(i) == forest.root(lead):
            joined[i] = True
            joined[found] = True

    able = np.flatnonzero(hopeful)
    lead = int(able[np.argsort(index.sizes[able], kind="stable")[len(able) // 2]])
    query(lead)
    for i in able.tolist():
        if not searched[i] and forest.root(i) != forest.root(lead):
            query(i)
    return links


# ---------------------------------------------------------------- the survey

#: Elements sent that a bucket of the survey is to hold, about.
BUCKET = 1_000_000
_FACT = np.dtype([("id", "<i8"), ("n", "<i8"), ("shared", "<i8"), ("high", "<u8"), ("low", "<u8"), ("known", "?")])


def sent_and_slack(n: int, percent: int) -> tuple[int, int]:
    """How many elements a set of n sends, and how many of them any partner that sends as many or more has sent too."""
    need = max(1, -(-percent * n // 100))
    slack = max(1, min(need, n * (100 - percent) // 200))
    return min(n, n - need + slack), slack


def least_shared(n: int, percent: int) -> int:
    """Elements sent by a set of n that some partner, which has ``percent`` of n elements at least, has sent too."""
    return sent_and_slack(max(1, -(-percent * n // 100)), percent)[1]


def _survey(batches: Iterator[pa.RecordBatch], k: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each batch (doc_id, text) a row with the facts of its documents, and a row for each bucket with
    the elements sent there: their hashes (four bytes; ``buckets`` fixes more) and their sets' digests, 0 if the batch has settled them."""
    hashes, bits = WordHashes(), np.uint64(buckets.bit_length() - 1)
    for number, batch in enumerate(slices(batches)):
        facts, first, sent, digests = np.zeros(batch.num_rows, _FACT), {}, [], []
        for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            values = shingle_set(text.as_py(), k, hashes)
            facts[i] = (doc or 0, len(values), 0, 0, 0, doc is not None)
            if not len(values):
                continue
            digest = xxhash.xxh3_128_intdigest(values.tobytes())
            facts[i]["high"], facts[i]["low"] = digest >> 64, max(1, digest & (1 << 64) - 1)
            if doc is not None and digest not in first:
                first[digest] = i
                sent.append(values[: sent_and_slack(len(values), percent)[0]])
                digests.append(i)
        lengths = np.array([len(x) for x in sent], np.int64)
        values = np.concatenate(sent) if sent else np.empty(0, np.uint64)
        owner = np.repeat(np.array(digests, np.int64), lengths)
        # by bucket (the low bits), then by what else is kept of the hash
        values = (values & np.uint64(buckets - 1)) << np.uint64(32) | values >> bits & np.uint64(0xFFFFFFFF)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
        count = np.diff(np.r_[start, len(values)])
        facts["shared"] = np.bincount(owner[np.repeat(count > 1, count)], minlength=len(facts))
        values, who = values[start], np.where(count > 1, np.uint64(0), facts["low"][owner[start]])
        bucket = (values >> np.uint64(32)).astype(np.int64)
        which, at = np.unique(bucket, return_index=True)
        ends = np.r_[at[1:], len(bucket)][: len(which)]
        kept = values.astype("<u4")
        rows = [(-1 - number, facts.tobytes(), b"")] + [(int(x), kept[a:b].tobytes(), who[a:b].tobytes()) for x, a, b in zip(which, at, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "a", "b"])


SURVEY = "doc_id long, n_shingles long, digest binary, low long, shared long"


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, a, b), sorted by bucket: facts a document a row; rows with ``low`` and ``shared`` alone say
    how many elements of a bucket the set of that digest shares with other sets."""

    def counts(parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        values = np.concatenate([np.frombuffer(a, "<u4") for a, _ in parts])
        who = np.concatenate([np.frombuffer(b, "<u8") for _, b in parts])
        order = np.lexsort((who, values))
        values, who = values[order], who[order]
        new = np.r_[True, (values[1:] != values[:-1]) | (who[1:] != who[:-1])]  # copies in several batches count once
        values, who = values[new], who[new]
        start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        several = np.repeat(np.diff(np.r_[start, len(values)]) > 1, np.diff(np.r_[start, len(values)]))
        low, n = np.unique(who[several & (who != 0)], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.nulls(len(low), pa.int64()), pa.nulls(len(low), pa.int64()), pa.nulls(len(low), pa.binary()), pa.array(low.view(np.int64)), pa.array(n.astype(np.int64))], names)

    names = [x.split()[0] for x in SURVEY.split(", ")]
    bucket, parts = None, []
    for batch in batches:
        for now, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if now != bucket and parts:
                yield counts(parts)
                parts = []
            bucket = now
            if now >= 0:
                parts.append((a.as_py(), b.as_py()))
                continue
            f = np.frombuffer(a.as_py(), _FACT)
            full = f["n"] > 0
            digest = np.stack([f["high"], f["low"]], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(f["id"], mask=~f["known"]), pa.array(f["n"]), pa.array([d.tobytes() if ok else None for d, ok in zip(digest, full, strict=True)], pa.binary()), pa.array(f["low"].view(np.int64), mask=~full), pa.array(f["shared"])],
                names,
            )
    if parts:
        yield counts(parts)
    parts = []
    give_back()


def survey(texts: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, digest, low, shared`` for every document, and rows of counts alone (null size)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = size / 5 * (sent_and_slack(1000, percent)[0] / 1000)  # words have some five bytes
    buckets = 1 << max(4, min(20, math.ceil(math.log2(max(1, sent / BUCKET)))))
    rows = texts.mapInArrow(lambda it: _survey(it, k, percent, buckets), "bucket int, a binary, b binary")
    rows = rows.repartition(partitions(texts.sparkSession), "bucket").sortWithinPartitions("bucket")
    return scratch.save(rows.mapInArrow(_settled, SURVEY), "survey")


# ---------------------------------------------------------------- stages on executors

FACTS = "doc_id long, n_shingles long, digest binary, sigs array<long>, near array<long>"

#: A shingle is hot if it is in this share of the documents, and in this many, at least; so many at most are kept out of the parts.
HOT_SHARE, HOT_LEAST, HOT_MOST = 0.001, 50, 500_000
#: How often blocks too large for one search are blocked anew, by what is hot among their documents.
REFINE, REFINE_LEAST = 3, 8


def _sets_of(column: pa.Array, k: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sets of a column of texts, or of sets packed before."""
    if pa.types.is_binary(column.type):
        return [np.frombuffer(x.as_py(), np.uint64) for x in column]
    return [shingle_set(t.as_py(), k, hashes) for t in column]


def _frequent(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(shingle, n) of each batch's frequent shingles, and its number of documents under null."""
    hashes = WordHashes()
    for batch in slices(batches):
        sets = _sets_of(batch.column(1), k, hashes)
        values, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
        often = n >= max(3, HOT_SHARE * len(sets))
        yield pa.RecordBatch.from_arrays([pa.array([None, *values[often].view(np.int64).tolist()], pa.int64()), pa.array([len(sets), *n[often].tolist()], pa.int64())], ["shingle", "n"])


def hot_shingles(docs: DataFrame, k: int, scratch: Scratch, least: int) -> np.ndarray:
    """Sorted hashes of the hot shingles, the ``HOT_MOST`` most frequent ones at most.

    Results don't depend on it, only how many documents share blocks.
    """
    counts = docs.mapInArrow(lambda it: _frequent(it, k), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts.where(F.col("shingle").isNull() | (F.col("n") >= least)), "frequent")
    total = sum(r.n for r in counts.where("shingle is null").collect())
    found = [r.shingle for r in counts.where(F.col("shingle").isNotNull() & (F.col("n") >= total * HOT_SHARE)).orderBy(F.col("n").desc(), "shingle").limit(HOT_MOST).select("shingle").collect()]
    scratch.drop("frequent")
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _facts(batches: Iterator[pa.RecordBatch], k: int, percent: int, hot: np.ndarray, bands: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Per document its set size and digest; once for equal sets of a batch, its signatures;
    of documents of a batch with equal signatures only the first sends them, the others name it in ``near``."""
    hashes, schemes = WordHashes(), {}
    for batch in slices(batches):
        ids, sizes, digests, sigs, seen = batch.column(0).to_pylist(), [], [], [], set()
        for i, values in zip(ids, _sets_of(batch.column(1), k, hashes), strict=True):
            digest = xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None
            sizes.append(len(values))
            digests.append(digest)
            if i is None or digest is None or digest in seen:
                sigs.append(np.empty(0, np.uint64))
            else:
                seen.add(digest)
                sigs.append(signatures(values, percent, schemes, hot, bands))
        lengths = np.array([len(x) for x in sigs], np.int64)
        every = np.concatenate(sigs) if sigs else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sigs)), lengths)
        _, at, group = np.unique(every, return_index=True, return_inverse=True)
        lead = owner[at][group]
        sent = lead == owner
        pairs = spanning(np.stack([owner[~sent], lead[~sent]], 1))
        known = np.array([-1 if i is None else i for i in ids], np.int64)
        offsets = lambda who: pa.array(np.r_[0, np.cumsum(np.bincount(who, minlength=len(ids)))], pa.int32())
        kept = pa.ListArray.from_arrays(offsets(owner[sent]), pa.array(every[sent].view(np.int64)))
        near = pa.ListArray.from_arrays(offsets(pairs[:, 0]), pa.array(known[pairs[:, 1]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), kept, near], ["doc_id", "n_shingles", "digest", "sigs", "near"])


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Of the pairs, as many as span the components they make; sorted by the first end."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kept = []
    for a, b in np.unique(pairs, axis=0).tolist():
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


#: Edges after which a task's spanning edges are handed on.
EDGES = 200_000


def _star_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, doc_id), sorted: edges from documents to the first one of their signature, reduced to
    those that span the components seen by the task."""
    sig, first, held, n = None, None, [], 0

    def reduced() -> pa.RecordBatch:
        nonlocal held, n
        held = [spanning(np.concatenate(held))]
        n = len(held[0])
        return pa.RecordBatch.from_arrays([pa.array(held[0][:, 0]), pa.array(held[0][:, 1])], ["a", "b"])

    for batch in batches:
        s = batch.column(0).to_numpy(zero_copy_only=False)
        d = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(s):
            continue
        new = np.r_[sig is None or s[0] != sig, s[1:] != s[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        lead = np.where(at >= 0, d[np.maximum(at, 0)], 0 if first is None else first)
        sig, first = s[-1], lead[-1]
        keep = lead != d
        if keep.any():
            held.append(np.stack([d[keep], lead[keep]], 1))
            n += int(keep.sum())
            if n > EDGES:
                out = reduced()
                if n > EDGES // 2:  # little left to reduce
                    yield out
                    held, n = [], 0
    if held:
        yield reduced()
    held = []
    give_back()


def _search_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, packed), sorted by block: the links that span each block."""

    def done(ids: list[int], packed: list[bytes]) -> pa.RecordBatch | None:
        if len(ids) < 2:
            return None
        links = block_links(ids, [np.frombuffer(x, np.uint64) for x in packed], percent)
        return _edges(links)

    block, ids, packed = None, [], []
    for batch in batches:
        for b, i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if b != block:
                if (out := done(ids, packed)) is not None:
                    yield out
                block, ids, packed = b, [], []
            ids.append(i)
            packed.append(x.as_py())
    if (out := done(ids, packed)) is not None:
        yield out
    ids, packed = [], []
    give_back()


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def _search_cuts(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (cut, is_query, doc_id, packed), sorted with a cut's members before its queries: of the links
    that a cut's queries find, as many as span the components they make."""
    cut, ids, sets, index, up = None, [], [], None, {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for batch in batches:
        links = []
        for c, q, i, x in zip(*(batch.column(n).to_pylist() for n in range(3)), batch.column(3), strict=True):
            if c != cut:
                cut, ids, sets, index, up = c, [], [], None, {}
            values = np.frombuffer(x.as_py(), np.uint64)
            if not q:
                ids.append(i)
                sets.append(values)
                continue
            if index is None:
                index, sets = InvertedIndex(sets), []
            for j in index.search(values, percent).tolist():
                a, b = root(i), root(ids[j])
                if a != b:
                    up[max(a, b)] = min(a, b)
                    links.append((i, ids[j]))
        if links:
            yield _edges(links)
    ids, sets, index, up = [], [], None, {}
    give_back()


# ---------------------------------------------------------------- the join


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included.
    A null, empty or wordless text has an empty set (size 0) and is linked
    with nothing.  Texts of under k words have one shingle.  Whole texts count,
    however long.  Rows with equal ids all come back, as one node of the link graph;
    a row with a null id comes back with a null component, linked with nothing.
    An empty table gives an empty table.  Other columns of ``docs`` are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = survey(texts, scratch, k, percent)
    facts = found.where("n_shingles is not null")
    known = facts.where("digest is not null and doc_id is not null")

    # classes of equal sets; a class of very many documents is spread over rows of its own
    spread = F.pmod(F.xxhash64("doc_id", F.lit("spread")), F.lit(SPREAD)).cast("int")
    parts = known.groupBy("digest", "low", spread.alias("spread")).agg(F.min("doc_id").alias("lead"), F.max("n_shingles").alias("n"), F.max("shared").alias("shared"))
    parts = scratch.save(parts, "parts")
    classes = scratch.save(parts.groupBy("digest", "low").agg(F.min("lead").alias("lead"), F.max("n").alias("n"), F.max("shared").alias("shared")), "classes")
    counted = found.where("n_shingles is null").groupBy("low").agg(F.sum("shared").alias("elsewhere"))
    shared = F.col("shared") + F.coalesce("elsewhere", F.lit(0))
    # at least least_shared(n), by the same integers
    need = F.greatest(F.lit(1), F.expr(f"({percent} * n + 99) div 100"))
    wanted = F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), F.expr(f"({percent} * need + 99) div 100")), F.expr(f"(need * {100 - percent}) div 200")))
    hopeful = classes.join(counted, "low", "left").withColumn("need", need).where(shared >= wanted).select(F.col("lead").alias("doc_id")).distinct()
    # one plan at every size: neither side of a join with texts is taken to be small
    base = texts.where("doc_id is not null").hint("merge").join(hopeful, "doc_id", "left_semi").mapInArrow(lambda it: _packed(it, k), "doc_id long, packed binary")
    members = scratch.save(base, "base")
    scratch.release()

    # blocks small enough are searched whole, by one task each; others are blocked anew
    links, held, large = [], None, None
    for i in range(REFINE + 1):
        blocks = _blocks(members, scratch, k, percent, REFINE_LEAST if i else HOT_LEAST, NARROW if i else WIDE, str(i))
        sizes = members.select("doc_id", (F.length("packed") / 8).cast("long").alias("n"))
        placed = scratch.save(blocks.select(F.col("component").alias("block"), F.col("id").alias("doc_id")).join(sizes, "doc_id"), "placed")
        sets = scratch.save(members.hint("merge").join(_sized(placed), "doc_id").select("block", "doc_id", "elements", "packed"), f"sets-{i}")
        scratch.drop(f"sets-{i - 1}" if i else "base")
        scratch.drop("placed")
        scratch.drop(f"members-{i}")
        links.append(_searched(sets, scratch, percent, f"links-{i}"))
        scratch.release()
        large = sets.where(F.col("elements") > BLOCK)
        now = large.count()
        if not now or now == held:
            break
        held, members = now, large.select("doc_id", "packed")
    if now:
        links.append(_large_blocks(large, scratch, percent))

    # an id with several sets joins their classes
    repeated = known.groupBy("doc_id").agg(F.min("low").alias("x"), F.max("low").alias("y")).where("x <> y").select("doc_id")
    edges = known.select("doc_id", "digest").join(repeated, "doc_id").join(classes.select("digest", "lead"), "digest").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    for part in links:
        edges = edges.union(part)
    joined = connected_components(edges, scratch, "linked")
    for name in (f"sets-{i}", "cuts", "own", "led", "rest", *(f"links-{j}" for j in range(i + 1))):
        scratch.drop(name)
    component = classes.select("digest", "lead").join(joined.withColumnRenamed("id", "lead"), "lead", "left").select("digest", F.coalesce("component", "lead").alias("component_id"))
    component = parts.select("digest", "spread").join(component, "digest")  # SPREAD rows of a class at most
    linked = known.withColumn("spread", spread).join(component, ["digest", "spread"]).select("doc_id", "n_shingles", "component_id")
    alone = facts.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)


#: Rows that a class of equal sets, or a block, is spread over where it meets what is known of it.
SPREAD = 64


def _packed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sets of a batch (doc_id, text), packed; equal rows of a batch once."""
    hashes = WordHashes()
    for batch in slices(batches):
        sets = dict.fromkeys((i, shingle_set(t.as_py(), k, hashes).tobytes()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        sets = [x for x in sets if x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets], pa.int64()), pa.array([x for _, x in sets], pa.binary())], ["doc_id", "packed"])


def _blocks(docs: DataFrame, scratch: Scratch, k: int, percent: int, least: int, bands: tuple[float, float], tag: str) -> DataFrame:
    """``id, component`` of the documents (doc_id, packed set) that share signatures."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_shingles(docs, k, scratch, least))
    sent = scratch.save(docs.mapInArrow(lambda it: _facts(it, k, percent, hot.value, bands), FACTS).select("doc_id", "sigs", "near"), f"sent-{tag}")
    rows = sent.select(F.explode("sigs").alias("sig"), "doc_id")
    stars = rows.repartition(partitions(spark), "sig").sortWithinPartitions("sig", "doc_id").mapInArrow(_star_edges, "a long, b long")
    near = sent.select(F.col("doc_id").alias("a"), F.explode("near").alias("b"))
    blocks = scratch.save(connected_components(stars.union(near), scratch, f"blocks-{tag}"), f"members-{tag}")
    scratch.drop(f"sent-{tag}")
    hot.destroy()
    return blocks


def _searched(sets: DataFrame, scratch: Scratch, percent: int, name: str) -> DataFrame:
    """Links of the blocks that one task can hold."""
    rows = sets.where(F.col("elements") <= BLOCK).select("block", "doc_id", "packed")
    rows = rows.repartition(partitions(sets.sparkSession), "block").sortWithinPartitions("block", "doc_id")
    return scratch.save(rows.mapInArrow(lambda it: _search_blocks(it, percent), "a long, b long"), name)


def _sized(placed: DataFrame) -> DataFrame:
    """``block, doc_id, n`` with the elements of each block."""
    placed = placed.withColumn("spread", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int"))
    parts = placed.groupBy("block", "spread").agg(F.sum("n").alias("elements"))
    whole = parts.groupBy("block").agg(F.sum("elements").alias("elements"))
    return placed.join(parts.select("block", "spread").join(whole, "block"), ["block", "spread"]).drop("spread")


#: Members of a cut's largest component, about, that query the other cuts.
GLUE = 8


def _large_blocks(large: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links of blocks that don't fit one task.

    Cuts hold sets of one band of sizes, of a ratio of ``100 / percent``: a partner lies in the same
    band or the next on either side.  First each cut is searched on its own, as a block is; then some members of each cut's
    largest component query the other cuts, which joins the components of cuts; then every member outside the
    block's largest component queries the cuts.  Members of the largest component need no query of
    their own: their links to other members are found from the other side, or lie within it.
    """
    spark = large.sparkSession
    size = F.length("packed") / 8
    band = F.floor(F.log(size) / math.log(100 / percent)).cast("int") if percent < 100 else size.cast("int")
    members = large.select("block", "doc_id", band.alias("band"), "packed")
    cuts = members.groupBy("block", "band").agg(F.ceil(F.sum(F.length("packed")) / F.lit(8 * BLOCK)).cast("int").alias("cuts"))
    cuts = scratch.save(cuts, "bands")  # a row for each band of each block; few blocks are large
    members = members.join(cuts, ["block", "band"])
    cut = lambda part: F.struct("block", "band", part.cast("int").alias("part"))
    members = scratch.save(members.select(cut(F.pmod(F.xxhash64("doc_id"), "cuts")).alias("cut"), "block", "doc_id", "band", "packed"), "cuts")

    def searched(queries: DataFrame, name: str) -> DataFrame:
        """Every query against the cuts of its block in which partners can be."""
        q = queries.select("block", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"), "doc_id", "packed").join(cuts, ["block", "band"])
        q = q.select("block", "band", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"), "doc_id", "packed")
        q = q.select(cut(F.col("part")).alias("cut"), F.lit(True).alias("q"), "doc_id", "packed")
        m = members.select("cut", F.lit(False).alias("q"), "doc_id", "packed")
        both = m.union(q).repartition(partitions(spark), "cut").sortWithinPartitions("cut", "q", "doc_id")
        return scratch.save(both.mapInArrow(lambda it: _search_cuts(it, percent), "a long, b long"), name)

    def largest(edges: DataFrame, per: str, tag: str) -> DataFrame:
        """``doc_id`` of each member and whether it is in the largest component of its ``per``."""
        found = connected_components(edges, scratch, tag).select(F.col("id").alias("doc_id"), "component")
        placed = members.select(per, "doc_id").join(found, "doc_id", "left").select(per, "doc_id", F.coalesce("component", "doc_id").alias("component"))
        placed = scratch.save(placed, f"{tag}-placed")
        sizes = placed.groupBy(per, "component").agg(F.count("*").alias("n")).groupBy(per).agg(F.max(F.struct("n", "component")).alias("top"))
        return placed.join(sizes, per).select("doc_id", (F.col("component") == F.col("top.component")).alias("inside"))

    own = members.select("cut", "doc_id", "packed").repartition(partitions(spark), "cut").sortWithinPartitions("cut", "doc_id")
    own = scratch.save(own.mapInArrow(lambda it: _search_blocks(it, percent), "a long, b long"), "own")
    inside = members.join(largest(own, "cut", "near").where("inside").select("doc_id").distinct(), "doc_id")
    sizes = inside.groupBy("cut").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    glue = inside.join(sizes, "cut").where((F.col("doc_id") == F.col("first")) | (F.pmod(F.xxhash64("doc_id", F.lit("glue")), F.col("n")) < GLUE))
    led = searched(glue, "led")
    outside = largest(own.union(led), "block", "joined").where("not inside").select("doc_id")
    return own.union(led).union(searched(members.join(outside, "doc_id", "left_semi"), "rest"))
