"""Shared helpers: tables, shared scratch space, hashing of words and shingles."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set by setCheckpointDir.

    A local session without one gets a temporary folder. On a cluster executors couldn't see it, so there it is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linkloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores after it while a column of that name (in any case) is there."""
    known = {c.lower() for c in taken}
    while wanted.lower() in known:
        wanted += "_"
    return wanted


class Scratch:
    """Intermediate tables as Parquet in the shared folder, so that a lost executor costs a re-read and no recomputation.

    The folder goes when the driver's JVM ends; ``drop`` removes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def narrow_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of ``rows`` rows at most for the jobs run inside: whole texts are wide, and a batch is held by the JVM
    and by the Python worker of every task. The session's own limit comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(own)) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def give_back() -> None:
    """Return freed memory to the system; Python workers outlive their tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function over batches that gives its memory back at its end."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def to_signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 4096, 2 * len(_powers["up"]))
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[key] = np.cumprod(step, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads the low-entropy low bits of a polynomial hash."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(text: str | None) -> list[bytes]:
    """The runs of bytes other than 0x20 and 0x09-0x0D (what bytes.split() splits at)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Prefix:
    """Polynomial prefix sums over word hashes; gives hashes of word ranges."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        self.up, down = _power_table(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * down[: self.n], dtype=np.uint64, out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Hash of each k consecutive words; length n - k + 1 or 0."""
        m = self.n - k + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        return mix64((self.sums[k : k + m] - self.sums[:m]) * self.up[:m] + np.uint64(k))

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))
