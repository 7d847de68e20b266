"""Token shards as wavelet matrices.

A shard file numbers its distinct tokens by falling frequency and holds these numbers as
bit-planes, the most significant first (which then are nearly empty); each plane's successor lists the ids whose bit is 0, then those
whose bit is 1, both in order.  Planes are cut into chunks that are compressed one by
one, and the number of ones before each chunk is stored, so that ``access``, ``rank`` and
``select`` read a few chunks of the compressed file.

Layout, little-endian::

    magic  b"QWM1"
    header u32 planes, u32 chunk bits, u64 tokens, u64 documents, u64 symbols
    u64 token of each number [symbols]
    i64 doc ids [documents], u64 starts [documents + 1]
    for each plane: u64 zeros, u64 ones before each chunk [chunks], u64 chunk offsets [chunks + 1]
    zstd chunks
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

MAGIC = b"QWM1"
CHUNK_BITS = 1 << 16
#: A shard ends with the document that brings it to this many tokens.
SHARD_TOKENS = 2_000_000
END_ID = 1

_HEADER = struct.Struct("<4sIIQQQ")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build(ids: np.ndarray, doc_ids: Iterable[int], starts: Iterable[int]) -> bytes:
    """The shard file of ``ids``; document i has ``ids[starts[i]:starts[i + 1]]``."""
    doc_ids, starts = np.asarray(doc_ids, "<i8"), np.asarray(starts, "<u8")
    often = np.bincount(ids) if len(ids) else np.empty(0, np.int64)
    symbols = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
    planes = max(1, int(len(symbols) - 1).bit_length()) if len(symbols) else 1
    number = np.zeros(len(often), np.uint16 if planes <= 16 else np.uint32)
    number[symbols] = np.arange(len(symbols))
    values = number.take(ids)
    n, step = len(values), CHUNK_BITS // 8
    chunks = -(-n // CHUNK_BITS)
    pack = zstandard.ZstdCompressor(level=1).compress
    tables, bodies, at = [], [], 0
    for plane in range(planes - 1, -1, -1):
        ones = (values >> plane) & 1 == 1
        bits = np.packbits(ones)
        counts = np.add.reduceat(_ONES[bits], np.arange(0, len(bits), step), dtype=np.uint64) if n else np.empty(0, np.uint64)
        body = [pack(bits[i : i + step].tobytes()) for i in range(0, len(bits), step)]
        offsets = at + np.r_[0, np.cumsum([len(b) for b in body])].astype(np.int64)
        at = int(offsets[-1])
        before = np.r_[0, np.cumsum(counts)[:-1]] if chunks else np.empty(0)
        tables.append(struct.pack("<Q", n - int(counts.sum())) + before.astype("<u8").tobytes() + offsets.astype("<u8").tobytes())
        bodies += body
        values = np.concatenate([values.take(np.flatnonzero(~ones)), values.take(np.flatnonzero(ones))])
    return b"".join([_HEADER.pack(MAGIC, planes, CHUNK_BITS, n, len(doc_ids), len(symbols)), symbols.astype("<u8").tobytes(), doc_ids.tobytes(), starts.tobytes(), *tables, *bodies])


class WaveletShard:
    """Reads a shard file (bytes, or a memory map of it); chunks are decompressed when needed."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.planes, self.chunk_bits, self.n, self.n_docs, n_symbols = _HEADER.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = _HEADER.size

        def column(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(self.data, kind, count, at)
            at += 8 * count
            return found

        self.symbols = column("<u8", n_symbols).astype(np.int64)
        self.doc_ids = column("<i8", self.n_docs)
        self.starts = column("<u8", self.n_docs + 1).astype(np.int64)
        chunks = -(-self.n // self.chunk_bits)
        self.zeros, self.before, self.offsets = [], [], []
        for _ in range(self.planes):
            self.zeros.append(int(column("<u8", 1)[0]))
            self.before.append(column("<u8", chunks).astype(np.int64))
            self.offsets.append(column("<u8", chunks + 1).astype(np.int64))
        self.body = at
        self._chunk = functools.lru_cache(256)(self._read_chunk)

    @functools.cached_property
    def number(self) -> dict[int, int]:
        return {int(t): i for i, t in enumerate(self.symbols)}

    def _read_chunk(self, plane: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's bytes, and the ones before each of them."""
        a, b = (self.body + int(self.offsets[plane][chunk + i]) for i in (0, 1))
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[a:b], max_output_size=self.chunk_bits // 8), np.uint8)
        return raw, np.r_[0, np.cumsum(_ONES[raw], dtype=np.int64)]

    def _bit(self, plane: int, i: int) -> int:
        raw, _ = self._chunk(plane, i // self.chunk_bits)
        i %= self.chunk_bits
        return int(raw[i >> 3]) >> (7 - (i & 7)) & 1

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        chunk, i = divmod(i, self.chunk_bits)
        raw, ones = self._chunk(plane, chunk)
        part = bin(int(raw[i >> 3]) >> (8 - (i & 7))).count("1") if i & 7 else 0
        return int(self.before[plane][chunk]) + int(ones[i >> 3]) + part

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.planes):
            bit, ones = self._bit(plane, i), self._rank1(plane, i)
            value = value << 1 | bit
            i = self.zeros[plane] + ones if bit else i - ones
        return int(self.symbols[value])

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before position i."""
        lo, hi = self._range(token, 0, min(i, self.n))
        return hi - lo

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of the token from start to before end."""
        lo, hi = self._range(token, start, self.n if end is None else min(end, self.n))
        return max(0, hi - lo)

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        token = self.number.get(token, -1)
        if token < 0:
            return 0, 0
        for plane in range(self.planes):
            a, b = self._rank1(plane, lo), self._rank1(plane, hi)
            lo, hi = (self.zeros[plane] + a, self.zeros[plane] + b) if token >> (self.planes - 1 - plane) & 1 else (lo - a, hi - b)
        return lo, hi

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th (from 0) occurrence; -1 if there is none."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i, token = lo + k, self.number[token]
        for plane in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - plane) & 1
            i = self._select(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the shard."""
        return np.array([self.access(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        values = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        unpack = zstandard.ZstdDecompressor().decompress
        for plane in range(self.planes - 1, -1, -1):
            at = self.offsets[plane] + self.body
            raw = b"".join(unpack(self.data[a:b], max_output_size=self.chunk_bits // 8) for a, b in zip(at[:-1], at[1:], strict=True))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            upper, z = np.empty_like(values), self.zeros[plane]
            upper[np.flatnonzero(~ones)] = values[:z]
            upper[np.flatnonzero(ones)] = values[z:] | values.dtype.type(1 << (self.planes - 1 - plane))
            values = upper
        return self.symbols.astype(np.uint32)[values] if self.n else values.astype(np.uint32)


#: A-Z in lower case, white space as spaces.
_PLAIN = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Letters and digits, space, full stop and comma, anything else.
_KINDS = bytes(ord("a" if chr(i).isalnum() and i < 128 else " " if i == 32 else "p" if chr(i) in ".," else "q") for i in range(256))


# How byte-level vocabularies spell bytes. Printable ones stand for themselves, the others follow from U+0100.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: b if b in _PRINTABLE else 0x100 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}


# The steps before the merges for which runs of text can be encoded one by one.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRETOKENIZER = [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


class WordEncoder(dict):
    """Ids (little-endian u16) of texts, by the tokenizers library.

    Where the tokenizer's file names the steps above, its normalizer and splitter work inside runs without ASCII white
    space only (white space ends every piece) and lower-case everything, so a text's ids are those of its
    runs in order; runs seen lately are kept, up to a bound.  A full stop or comma after an ASCII letter or digit is
    a piece of its own, so it may be set apart.  A run of letters up to U+024F that the normalizer leaves
    alone is split here and its pieces go straight to the library's BPE.  Any other tokenizer gets whole texts.
    """

    LIMIT = 400_000

    def __init__(self, path: str):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        self.model, self.pieces = self.tokenizer.model, regex.compile(_SPLIT).findall
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("a vocabulary of at most 65,536 ids is needed")
        steps = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in steps["added_tokens"]]
        listed = lambda step, name: (steps[step] or {}).get(name)
        self.by_runs = listed("normalizer", "normalizers") == _NORMALIZER and listed("pre_tokenizer", "pretokenizers") == _PRETOKENIZER and all(t.startswith("<|") for t in special)

    def __missing__(self, run: bytes) -> bytes:
        value = self.older.get(run)
        if value is None:
            word = run.decode("utf-8", "replace")
            if word and max(word) < "\u0250" and word.lower() == word and "<|" not in word and unicodedata.is_normalized("NFC", word):
                pieces = [word] if word.isalpha() else self.pieces(word)
                if pieces == [word]:  # as the byte-level step spells it
                    value = array("H", [t.id for t in self.model.tokenize(run.decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
                else:
                    value = b"".join([self[x.encode()] for x in pieces])
            else:
                value = array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[run] = value
        return value

    def encode(self, text: str | bytes | None) -> np.ndarray:
        """Ids of a text, given as a string or as UTF-8."""
        runs = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
        if not self.by_runs:
            return np.array(self.tokenizer.encode(runs.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u2")
        if len(self) > self.LIMIT:
            self.older = dict(self)
            self.clear()
        if b"<|" not in runs and b"\xcc" not in runs:  # special tokens and combining marks are told apart by case
            runs = runs.translate(_PLAIN) + b" "
            kinds = runs.translate(_KINDS)
            if b"pp" not in kinds and b"qp" not in kinds:
                runs = runs.replace(b". ", b" . ").replace(b", ", b" , ")
        return np.frombuffer(b"".join(map(self.__getitem__, runs.split())), "<u2")


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """One for each worker, so that later tasks find the runs of earlier ones."""
    return WordEncoder(path)


def _write_shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, folder: str) -> Iterator[pa.RecordBatch]:
    encoder, parts, docs, starts, total, shard, part = _encoder(path), [], [], [0], 0, 0, None
    store, root = FileSystem.from_uri(folder)
    end = np.array([end_id], "<u2")

    def flush() -> pa.RecordBatch:
        """Writes the shard under a name of this attempt, then gives it its own: whoever sees that sees a whole file."""
        file = f"part-{part:05d}-{shard:05d}.qwm"
        attempt = f"{root}/.{file}-{uuid.uuid4().hex}"
        with store.open_output_stream(attempt) as out:
            out.write(build(np.concatenate(parts), docs, starts))
        store.move(attempt, f"{root}/{file}")
        names = ["part", "shard", "n_tokens", "n_docs", "file"]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([total], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([f"{folder}/{file}"])], names)

    for batch in batches:
        for doc, text, p in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            part = p
            ids = encoder.encode(text.as_py())
            parts += [ids, end]
            total += len(ids) + 1
            docs.append(NO_ID if doc is None else doc)
            starts.append(total)
            if total >= SHARD_TOKENS:
                yield flush()
                parts, docs, starts, total, shard = [], [], [0], 0, shard + 1
    if docs:
        yield flush()


#: Stands for a null id in a shard file.
NO_ID = -(1 << 63)


def write_shards(docs: DataFrame, tokenizer_path: str, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, name: str = "shards", folder: str | None = None) -> DataFrame:
    """Writes shard files in ascending order of id and returns their list ``part, shard, n_tokens, n_docs, file``.

    They go to ``folder``, in a store that pyarrow's file systems reach from every executor, and stay there; without one,
    to the scratch folder, for as long as the session lasts.  The list is kept beside them (``manifest``, Parquet).
    A file gets its name once it is whole, and a repeated task replaces it by an equal one.  ``(part, shard)`` order is
    id order.  A null text is empty; null ids come first; rows with equal ids are ordered by text.
    An empty table gives no files.
    """
    spark, folder = docs.sparkSession, (folder or f"{scratch.root}/{name}").rstrip("/")
    store, root = FileSystem.from_uri(f"{folder}/files")
    store.create_dir(root, recursive=True)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"), F.spark_partition_id().alias("part"))
    listed = d.mapInArrow(lambda it: _write_shards(it, tokenizer_path, end_id, f"{folder}/files"), MANIFEST)
    listed.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


MANIFEST = "part int, shard int, n_tokens long, n_docs long, file string"


def open_shard(file: str) -> WaveletShard:
    """A shard by its place; a local file is mapped, so that only the chunks that are asked for are read."""
    store, path = FileSystem.from_uri(file)
    if isinstance(store, LocalFileSystem):
        return WaveletShard(pa.memory_map(path).read_buffer())
    with store.open_input_file(path) as f:
        return WaveletShard(f.read_buffer())


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, base): the documents of each file, ``base`` ids after all others."""
    for batch in batches:
        for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = open_shard(file)
            ids, starts = w.decode(), w.starts
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(w.doc_ids, mask=w.doc_ids == NO_ID), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def shard_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it.  Prefix sums go over the shards of each
    part and then over the parts, one row each.
    """
    sizes = shards.select("part", "shard", "n_tokens")
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_base"))
    base = F.col("part_base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    # a row for each file, of two million ids or more; the files are dealt anew, a few to a task
    files = shards.select("part", "shard", "n_tokens", "file").join(parts, "part").select("file", base.alias("base")).repartition(partitions(shards.sparkSession), "file")
    return files.mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")
