"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Compilation.  A sequence of tokens is the BPE encoding of its bytes exactly when every
token encodes to itself and every pair of neighbours encodes to that pair.  So the encoding
of a prefix of n bytes ends with the one token t that spells its last bytes and is compatible
with the last token of the prefix before it.  That makes a nondeterministic transducer:
a thread for every place where a token may still be open, each a node of the vocabulary's
trie with the last token before it.

Determinisation.  A state is the set of live threads.  Transitions, each with the token that
ends at its byte, are computed the first time they are needed and kept.  A thread dies within the
longest token's length, so every live thread starts within that many bytes.  What the paths of all
of them have in common is settled: these tokens are emitted, every ``WINDOW`` bytes, and forgotten.
States, transitions and known neighbours are dropped when there are too many, inside a piece as well, and built anew.

Decoding.  Ids come in blocks; a UTF-8 machine steps over tokens, holds back the bytes of a
character that a block leaves unfinished and notices whatever is no UTF-8.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class State(dict):
    """From a byte to (next state, last token of the prefix that ends there); filled when asked."""

    __slots__ = ("machine", "threads")

    def __init__(self, machine: BpeTransducer, threads: tuple[int, ...]):
        self.machine, self.threads = machine, threads

    def __missing__(self, byte: int) -> tuple[State, int]:
        return self.machine.move(self, byte)


class BpeTransducer:
    """Encodes the bytes of one piece; see the module's text."""

    #: States and known pairs of neighbours that are kept.
    MAX_STATES, MAX_FITS = 150_000, 500_000
    #: Bytes after which settled tokens are handed on.
    WINDOW = 256

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelling = {i: t for t, i in ranks.items()}
        self.width = {i: len(t) for t, i in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for single bytes {missing[:5]}")
        # trie: edges by node * 256 + byte; token of a node, -1 if none ends there
        self.edges: dict[int, int] = {}
        self.token, self.inner, self.depth = [-1], [True], [0]
        for spelling, i in ranks.items():
            node = 0
            for byte in spelling:
                self.inner[node] = True
                key = node << 8 | byte
                nxt = self.edges.get(key)
                if nxt is None:
                    nxt = self.edges[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token[node] = i
        self.spines: dict[int, tuple | None] = {}
        self.fits: dict[int, bool] = {}
        self.held = 0  # the longest run of bytes that waited to be settled, for tests
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state((0,))
        if len(self.fits) > self.MAX_FITS:
            self.fits.clear()

    def _state(self, threads: tuple[int, ...]) -> State:
        found = self.states.get(threads)
        if found is None:
            found = self.states[threads] = State(self, threads)
        return found

    def merge(self, data: bytes, down_to: int = 1) -> list[int]:
        """Plain BPE: the merge of least rank first, of equal ones the leftmost.  For compiling."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int) -> tuple | None:
        """How BPE builds the token at its left and its right edge: lists of (part, rank of the merge that takes the
        part), smallest first; None if BPE doesn't build it.  Whether every merge ranks after its parts comes third."""
        if token not in self.spines:
            self.spines[token] = None
            if self.width[token] == 1:
                self.spines[token] = [(token, _NEVER)], [(token, _NEVER)], True
            elif self.merge(self.spelling[token]) == [token]:
                left, right = self.merge(self.spelling[token], down_to=2)
                (ll, _, a), (_, rr, b) = self.spine(left), self.spine(right)
                ordered = a and b and left < token and right < token
                self.spines[token] = [*ll[:-1], (left, token), (token, _NEVER)], [*rr[:-1], (right, token), (token, _NEVER)], ordered
        return self.spines[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether b encodes to itself after a; a is -1 at the start.

        Merges go by rank, so parts at a's right edge and b's left edge stand side by side until either is taken
        by a merge of its own; a merge of the two that ranks before that would join them (of equal
        ranks the left one comes first).
        """
        known = self._side_by_side(a, b)
        self.fits[a + 1 << 32 | b] = known
        return known

    def _side_by_side(self, a: int, b: int) -> bool:
        right = self.spine(b)
        if right is None or a < 0:
            return right is not None
        left = self.spine(a)
        if left is None or not (left[2] and right[2]):
            return self.merge(self.spelling[a] + self.spelling[b]) == [a, b]
        edge, start, rank, spelling = left[1], right[0], self.ranks.get, self.spelling
        i = j = 0
        while True:
            (x, taken_x), (y, taken_y) = edge[i], start[j]
            joined = rank(spelling[x] + spelling[y])
            if joined is not None and joined < taken_x and joined <= taken_y:
                return False
            if taken_x <= taken_y:
                if taken_x == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def move(self, state: State, byte: int) -> tuple[State, int]:
        """The next state, and the last token of the prefix that ends with the byte."""
        live, ended, edge, fits, tokens, inner = [], -1, self.edges.get, self.fits.get, self.token, self.inner
        for thread in state.threads:  # node of the trie, last token before it (from 1) above
            last = thread >> 32
            nxt = edge((thread & 0xFFFFFFFF) << 8 | byte)
            if nxt is None:
                continue
            if ended < 0 and (token := tokens[nxt]) >= 0:
                fit = fits(last << 32 | token)
                if self.compatible(last - 1, token) if fit is None else fit:
                    ended = token
            if inner[nxt]:
                live.append(last << 32 | nxt)
        live.append(ended + 1 << 32)
        found = state[byte] = self._state(tuple(live)), ended
        return found

    def last_token(self, state: State, byte: int) -> int:
        """The last token of the prefix that ends with the byte, without the next state."""
        for thread in state.threads:
            nxt = self.edges.get((thread & 0xFFFFFFFF) << 8 | byte)
            if nxt is not None and (token := self.token[nxt]) >= 0:
                last = thread >> 32
                fit = self.fits.get(last << 32 | token)
                if self.compatible(last - 1, token) if fit is None else fit:
                    return token
        return -1

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece; one that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > self.WINDOW:
            return [i for part in self.stream(piece) for i in part]
        if len(self.states) > self.MAX_STATES or len(self.fits) > self.MAX_FITS:
            self._reset()
        state, ends = self.start, []
        for byte in piece[:-1]:
            state, token = state[byte]
            ends.append(token)
        if piece:  # what the last byte ends is all that is asked of it
            known = state.get(piece[-1])
            ends.append(known[1] if known is not None else self.last_token(state, piece[-1]))
        return self._settle(ends)

    def stream(self, piece: bytes) -> Iterator[list[int]]:
        """Ids of a piece in runs, each as soon as all live threads agree on it; what waits to be settled is bounded."""
        if len(self.states) > self.MAX_STATES or len(self.fits) > self.MAX_FITS:
            self._reset()
        state, ends = self.start, []
        for at in range(0, len(piece), self.WINDOW):
            for byte in piece[at : at + self.WINDOW]:
                state, token = state[byte]
                ends.append(token)
            if at + self.WINDOW < len(piece):
                self.held = max(self.held, len(ends))
                settled = self._agreed(state, ends)
                if settled:
                    yield self._settle(ends[:settled])
                    del ends[:settled]
                if len(self.states) > self.MAX_STATES or len(self.fits) > self.MAX_FITS:
                    threads = state.threads
                    self._reset()
                    state = self._state(threads)
        yield self._settle(ends)

    def _agreed(self, state: State, ends: list[int]) -> int:
        """Bytes up to the last place that the paths of all live threads pass."""
        places = {len(ends) - self.depth[thread & 0xFFFFFFFF] for thread in state.threads}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.width[ends[last - 1]])
        return max(0, places.pop())

    def _settle(self, ends: list[int]) -> list[int]:
        """Tokens of a settled run, found from its end: each names where the one before it ended."""
        at, found, width = len(ends), [], self.width
        while at > 0:
            found.append(ends[at - 1])
            at -= width[ends[at - 1]]
        found.reverse()
        return found


#: Rank of a merge that doesn't take place.
_NEVER = 1 << 62


# The usual pattern of byte-level vocabularies, and the letters and numbers below U+0250.
_USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"


class PieceEncoder(dict):
    """Ids of a piece as little-endian u32; pieces seen lately are kept, up to a bound.

    Texts without characters from U+0250 on (and without those that the two libraries' white space tells apart) are split by the
    standard library's expressions, which spell out the letters and numbers of the usual pattern; any other text or pattern by the pattern itself.
    """

    LIMIT = 300_000

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import regex

        self.pieces, self.older = regex.compile(pattern).findall, {}
        self.machine = BpeTransducer(load_ranks(path))
        if pattern == _USUAL:
            plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+").findall
            other, whole = re.compile("[\x1c-\x1f\u0250-\U0010ffff]").search, self.pieces
            self.pieces = lambda text: whole(text) if other(text) else plain(text)

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            value = array("I", self.machine.encode(piece.encode("utf-8", "replace"))).tobytes()
        self[piece] = value
        return value

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; each match of the pattern is encoded by itself."""
        if len(self) > self.LIMIT:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.pieces(text or "")))

    def rest(self) -> None:
        """Forgets pieces between tasks, as a worker keeps its memory while it waits."""
        self.clear()
        self.older = {}
        give_back()


# ---------------------------------------------------------------- decoding

# States of the UTF-8 machine: 0 between characters, 1-3 that many continuation bytes to come,
# 4-7 the same with a restricted next byte (after E0, ED, F0, F4), 8 broken.
_BROKEN = 8
_NEXT = {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


def utf8_step(state: int, byte: int) -> int:
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(byte, 3)
        return _BROKEN
    if state in _NEXT:
        low, high, then = _NEXT[state]
        return then if low <= byte <= high else _BROKEN
    return state - 1 if state < 4 and 0x80 <= byte <= 0xBF else _BROKEN


class StreamDecoder:
    """Turns ids into text as they come: whole characters only; what is unfinished waits.

    Bytes that can't be UTF-8 become U+FFFD, one for each maximal broken part.
    """

    def __init__(self, spelling: dict[int, bytes]):
        self.spelling, self.state, self.waiting = spelling, 0, b""

    def feed(self, ids: Iterable[int]) -> str:
        out = []
        for i in ids:
            for byte in self.spelling[i]:
                out.append(self._byte(byte))
        return "".join(out)

    def _byte(self, byte: int) -> str:
        nxt = utf8_step(self.state, byte)
        if nxt == _BROKEN:
            lost = "�" if self.state else ""
            restart = utf8_step(0, byte)
            if restart == _BROKEN:
                self.state, self.waiting = 0, b""
                return lost + "�"
            self.state, self.waiting = restart, bytes([byte])
            if restart == 0:
                self.waiting = b""
                return lost + chr(byte)
            return lost
        self.waiting += bytes([byte])
        self.state = nxt
        if nxt:
            return ""
        char, self.waiting = self.waiting.decode(), b""
        return char

    def finish(self) -> str:
        left, self.state, self.waiting = "�" if self.waiting else "", 0, b""
        return left


class ByteDecoder:
    """Bytes of whole documents in blocks of whole characters, checked by the UTF-8 machine token by token."""

    #: Ids that a block holds.
    BLOCK = 8192

    def __init__(self, spelling: dict[int, bytes]):
        self.spelling = spelling
        self.after: dict[tuple[int, int], int] = {}
        self.closed = np.zeros(max(spelling) + 1, bool)  # tokens of whole characters
        for i, s in spelling.items():
            self.closed[i] = self._after(0, s) == 0
        spelled = [spelling.get(i, b"") for i in range(len(self.closed))]
        self.bytes, self.width = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.width) - self.width

    @staticmethod
    def _after(state: int, data: bytes) -> int:
        if state == 0 and data.isascii():
            return 0
        for byte in data:
            state = utf8_step(state, byte)
        return state

    def blocks(self, ids: np.ndarray) -> Iterator[tuple[bytes, bool]]:
        """(bytes, whether all so far is valid UTF-8); an unfinished character waits for the next block, at the end it comes as it is."""
        state, waiting = 0, b""
        for at in range(0, len(ids), self.BLOCK):
            part = ids[at : at + self.BLOCK]
            state = self._run(state, part)
            data, waiting = waiting + self._spelled(part), b""
            if state not in (0, _BROKEN):
                lead = len(data) - next(n for n in range(1, 4) if data[-n] & 0xC0 != 0x80)
                data, waiting = data[:lead], data[lead:]
            yield data, state != _BROKEN
        if waiting:
            yield waiting, False

    def _run(self, state: int, part: np.ndarray) -> int:
        """The machine's state after the tokens; between characters, tokens of whole characters leave it there."""
        opens = np.flatnonzero(~self.closed[part]).tolist()
        if not opens and not state:
            return 0
        listed, at, n = part.tolist(), 0, len(part)
        while state != _BROKEN:
            if not state:
                k = bisect_left(opens, at)
                if k == len(opens):
                    break
                at = opens[k]
            if at == n:
                break
            key = state, listed[at]
            state = self.after.get(key, -1)
            if state < 0:
                state = self.after[key] = self._after(key[0], self.spelling[listed[at]])
            at += 1
        return state

    def _spelled(self, part: np.ndarray) -> bytes:
        """All bytes of the tokens, gathered from one table."""
        width = self.width[part]
        ends = np.cumsum(width)
        return self.bytes[np.arange(ends[-1] if len(part) else 0) + np.repeat(self.start[part] - (ends - width), width)].tobytes()

    def decode(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """(bytes, whether they are whole valid UTF-8)."""
        found = list(self.blocks(ids))
        return b"".join(data for data, _ in found), all(ok for _, ok in found)


# ---------------------------------------------------------------- DataFrame operators


@functools.cache
def _encoder(path: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(path, pattern)


@functools.cache
def _decoder(path: str) -> ByteDecoder:
    return ByteDecoder({i: t for t, i in load_ranks(path).items()})


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, pattern)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.encode(t.as_py()) for t in batch.column(1)], pa.binary())], ["doc_id", "ids"])
    encoder.rest()


def _digested(batches: Iterator[pa.RecordBatch], path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    decoder = _decoder(path)
    for batch in batches:
        n, of_ids, of_bytes, valid = [], [], [], []
        for x in batch.column(1):
            raw = x.as_py() or b""
            digest, ok = hashlib.sha256(), True
            for data, whole in decoder.blocks(np.frombuffer(raw, "<u4")):
                digest.update(data)
                ok &= whole
            n.append(len(raw) // 4)
            of_ids.append(hashlib.sha256(raw).hexdigest())
            of_bytes.append(digest.hexdigest())
            valid.append(ok)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), pa.array(valid, pa.bool_()), batch.column(1)]
        yield pa.RecordBatch.from_arrays(columns[: len(names)], names)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of each whole text as little-endian 32-bit integers.

    A null or empty text has no ids.  Equal ids stay separate rows; an empty table gives an
    empty table.  There is no shuffle: one pass over the texts, one text in memory at a time beside its batch.
    """
    return _texts(docs, id_col, text_col).mapInArrow(lambda it: _encoded(it, ranks_path, pattern), "doc_id long, ids binary")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean"


def decode_digest(encoded: DataFrame, ranks_path: str, *, with_ids: bool = False) -> DataFrame:
    """From ``doc_id, ids``: counts and hashes of the ids and of the bytes they decode to; null ids count as none."""
    schema = DIGEST + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _digested(it, ranks_path, names), schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``decode_digest`` of ``encode_documents`` in one pass, so that ids don't travel between two workers."""
    schema = DIGEST + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return _texts(docs, id_col, text_col).mapInArrow(lambda it: _digested(_encoded(it, ranks_path, pattern), ranks_path, names), schema)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``, through the streaming decoder; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = _decoder(ranks_path).spelling
        for batch in batches:
            texts = []
            for x in batch.column(1):
                raw = x.as_py()
                stream = StreamDecoder(spelling)
                texts.append(None if raw is None else stream.feed(np.frombuffer(raw, "<u4").tolist()) + stream.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
