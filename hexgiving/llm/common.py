"""Shared helpers: written intermediate tables, document folds, word hashes."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexgiving.session import shared_dir

CACHE_ENTRIES = 300_000     # bound of each half of a per-worker word cache; results do not depend on it


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back.

    Cuts the lineage with files every executor can reach, so a lost executor
    costs a re-read and not a re-run, and gives the planner real sizes.
    """
    path = shared_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_column: str | Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts`` (null id: null)."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(c.cast("string").cast("binary")) % parts


def slices(batches, rows: int = 500):
    """The batches in pieces of at most ``rows``: a worker holds the Python objects of one piece at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordCache(dict):
    """Word -> value, computed once while the word stays in use.

    When full, the entries become the old half and replace the former one;
    words met again move back. So frequent words stay and memory is bounded.
    """

    def __init__(self, compute, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, word):
        if len(self) >= self.entries:
            self.old = self.copy()
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        self[word] = value
        return value

    def empty(self) -> None:
        self.clear()
        self.old = {}


WORD_HASHES = WordCache(xxhash.xxh3_64_intdigest, 100_000)


def release() -> None:
    """Empty the shared word cache and give freed memory back to the system.

    A Python worker outlives its task and serves later stages; what its
    allocators still hold would count beside theirs.
    """
    WORD_HASHES.empty()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def lean(run):
    """``run`` (batches to batches) that releases its worker's memory at the end of each partition."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs of bytes outside \\x20 and \\x09-\\x0D, with A-Z lower-cased."""
    return (text or b"").lower().split()


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hash of each word of the whole text (null: no words)."""
    w = words(text)
    return np.fromiter(map(WORD_HASHES.__getitem__, w), np.uint64, len(w))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(columns: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive 64-bit hash of parallel arrays."""
    h = np.full(len(columns[0]), 0x243F6A8885A308D3, np.uint64)
    for c in columns:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` word hashes, in order."""
    return chain([h[i:len(h) - n + 1 + i] for i in range(n)])
