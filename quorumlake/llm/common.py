"""Helpers that the operators of this subpackage share.

Conventions kept by every operator here:

* an input frame is narrowed to the columns an operator names before anything
  else happens, so further columns (clashing names included) can't interfere;
* a null text counts as the empty text;
* rows with equal ids are kept as separate rows unless an operator's docstring
  says otherwise;
* intermediate tables that are read more than once are written to the shared
  folder named by ``spark.checkpoint.dir`` and reread, so a lost executor costs
  the tasks it ran and no more.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java and Python character class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share.  Where none is set, a local one, which only a master of one machine can use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
        root = _local_root()
    return root.rstrip("/")


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quorumlake-")


class Scratch:
    """Tables of one job in the shared folder, written by Spark and reread."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/job-{uuid.uuid4().hex}"
        atexit.register(self._quietly_drop, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now: it does so once nothing refers to
        them any more, which collectors would find out much later."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        path = f"{self.root}/{name}".rstrip("/")
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _quietly_drop(self, path: str) -> None:
        try:
            self.drop()
        except Exception:  # the session has ended already
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")


def id_crc(name: str) -> Column:
    """crc32 of an id's decimal text, which deals rows into folds."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


class WordHashes(dict):
    """64-bit hash of a word (bytes), kept for words seen before; bounded."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased; bytes.split knows 0x20 and 0x09-0x0D only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, of so many rows or bytes on average, where a step holds several times a batch's size."""
    for batch in batches:
        step = min(rows, max(1, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back()


def give_back() -> None:
    """Returns a worker's freed memory to the machine: the worker waits for its next task, and an
    executor's other processes need the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order; fewer words than k make one run,
    none make none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(k, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : n - width + 1 + i])
    return acc
