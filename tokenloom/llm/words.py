"""Words as the operators of this package see them, and their 64-bit hashes.

A word is a run of bytes other than space and the five ASCII control spaces, with A-Z
lower-cased. On UTF-8 bytes that is exactly ``bytes.lower().split()``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import SparkSession

#: The same words as a regular expression, for SQL functions.
WORD = r"[^\x20\x09-\x0D]+"



def _odd(i: int) -> np.uint64:
    """The odd multiplier of the i-th word of a gram."""
    return np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1))


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close ones apart."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """One hash for the words at ``offsets`` from every position where all of them exist.

    ``offsets`` start at 0 and rise. Each set of offsets has hashes of its own.
    """
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    seed = 0
    for offset in offsets:
        seed = seed * 31 + offset + 1
    total = np.full(n, seed, np.uint64)
    for i, offset in enumerate(offsets):
        total += hashes[offset:offset + n] * _odd(i)
    return mixed(total)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a whole text.

    A text of fewer words counts as one shingle; one without words has none.
    """
    hashes = word_hashes(words(text))
    if not len(hashes):
        return hashes
    return np.unique(gram_hashes(hashes, tuple(range(min(size, len(hashes))))))


def small_batches(spark: SparkSession, size: int = 8 << 20, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once: texts can be very long, so bytes count too."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
